"""Token counts, byte-level BPE and media columns against the libraries."""

import base64
import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import bpe, media, token_fst

ODD = [None, "", "a", "don't  I'll 's", "''s 's\t's\n's \n 's", "  x  ", "a<|endoftext|>  b <|endoftext|>", "x" * 1000 + " " + "é" * 999 + "　 z", "'llama 'tis can'tve we'Re", "日本語テキスト 123456 ⅷ ٣٤", "\n\n\n a\n\n", " " * 700 + "b", "=" * 3000, "a's's't'llx'", "🎉🎊 x🎉", "long words and text " * 8000]
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "null id", "x", 1), (3, ODD[3], "x", 1), (3, "same id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, block int").repartition(3)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(odd, library):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, token_fst.token_counts(odd, JSON).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), library(t), library(t) > 512) for i, t in rows), key=str)
    assert got == want
    assert token_fst.token_counts(odd.limit(0), JSON).count() == 0


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(list("ab' \n\tsltrevdm1é.,!<|日 ")), max_size=450), min_size=1, max_size=4))
def test_counts_of_any_text(library, texts):
    n_bytes, n_tokens = token_fst.count_texts(texts, token_fst.compiled(JSON), 1)
    assert n_tokens.tolist() == [library(t) for t in texts] and n_bytes.tolist() == [len(t.encode()) for t in texts]


@pytest.mark.parametrize("bits,segment,guesses", [(21, 1 << 20, 24), (9, 1000, 24), (12, 5000, 2)])
def test_counts_of_long_runs(library, monkeypatch, bits, segment, guesses):
    """Texts without a boundary, texts that repeat, texts that need more transitions than the table first holds, and small segments."""
    rng = random.Random(4)
    letters = lambda some, n: "".join(rng.choices(some, k=n))
    long = 5 if segment > 5000 else 1
    texts = ["a" * 20_000 * long, "ab" * 10_000, "abc" * 9_999, letters("abcdefg", 700) * 30, letters("abc", 20_000), letters("abcdefghijklmnopqrstuvwxyz", 10_000 * long), " " * 9_000 + "x", "的一是不了人我在有他" * 2_000, base64.b64encode(rng.randbytes(20_000 * long)).decode(), "a" * 400 + " b" + "=" * 1000]
    monkeypatch.setattr(token_fst.CountTransducer, "BITS", bits)
    monkeypatch.setattr(token_fst, "SEGMENT", segment)
    monkeypatch.setattr(token_fst, "MOST_GUESSES", guesses)
    token_fst._machines.clear()
    assert token_fst.count_texts(texts, token_fst.compiled(JSON), 5)[1].tolist() == [library(t) for t in texts]
    token_fst._machines.clear()


def test_reset_keeps_counts(library):
    machine = token_fst.CountTransducer(*(token_fst.compiled(JSON)[k] for k in ("tokens", "merges")))
    token_fst._machines.clear()
    token_fst._machines[2] = machine
    for k in range(3):
        assert token_fst.count_texts([ODD[7]], token_fst.compiled(JSON), 2)[1].tolist() == [library(ODD[7])]
        machine.reset()


def test_bpe_equals_the_library_and_returns(odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN, block_bytes=20_000), RANKS).collect()
    want = []
    for r in odd.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), (r.text or "").encode()))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)
    once = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, got))
    assert bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_scans_are_stable_and_others_are_not(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert bpe.stable(scan.select("doc_id", "text").filter("doc_id > 0")).inputFiles() == scan.inputFiles()
    assert bpe.stable(scan.distinct()).inputFiles() != scan.inputFiles()


def test_all_lists_with_a_word_meet_in_one_bucket(odd):
    texts = odd.select("doc_id", "text").na.fill("", ["text"])
    homes: dict[bytes, set[int]] = {}
    for r in bpe.blocks_of(texts, public_tokenizers.PATTERN, 7, 1, True).collect():
        raw = zstandard.ZstdDecompressor().decompress(bytes(r.packed))
        count = int.from_bytes(raw[:4], "little")
        at = 4 + 4 * count
        for n in np.frombuffer(raw, "<u4", count, 4).tolist():
            homes.setdefault(raw[at : at + n], set()).add(r.bucket)
            at += n
    assert len(homes) > 30 and all(len(h) == 1 for h in homes.values())


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_sniffing_corrects_and_carves(spark):
    wav = media.wav_of(b"\x80" * 64)
    rows = [(1, png(), "image/gif"), (2, b"text " + png() + b" more " + zipped() + GIF, "text/plain"), (3, png()[:-1], "image/png"), (4, b"", "x"), (5, None, None), (6, wav, "audio/wav"), (7, zlib.compress(b"x" * 50, wbits=31), None), (8, b"BM" * 40, "image/bmp"), (9, media.wav_of(b"ab" + GIF + b"\0" * (64 - len(GIF) - 2 + 64)), "audio/wav")]
    df = spark.createDataFrame(rows, "doc_id long, content binary, declared string").repartition(2)
    found = media.sniff(df)
    got = {r.doc_id: (r.detected, r.corrected, [(m.type, m.offset, m.length) for m in r.media]) for r in found.collect()}
    assert got[1] == ("image/png", True, []) and got[3] == (None, False, []) and got[4] == got[5] == (None, False, [])
    n = len(png())
    assert got[2] == (None, False, [("image/png", 5, n), ("application/zip", 11 + n, len(zipped())), ("image/gif", 11 + n + len(zipped()), len(GIF))])
    assert got[6][:2] == ("audio/wav", False) and got[7][0] == "application/gzip" and got[8] == (None, False, [])
    assert got[9] == ("audio/wav", False, [("image/gif", 46, len(GIF))])
    assert {(r.doc_id, r.type, bytes(r.bytes)) for r in media.carved(found).collect()} >= {(2, "image/gif", GIF), (2, "image/png", png()), (9, "image/gif", GIF)}
    assert media.sniff(df.limit(0)).count() == 0


def test_long_values_of_magic_bytes_alone():
    machine = media.automaton()
    for mark in (b"%PDF-", b"PK\x03\x04", b"OggS" + bytes(23), b"PK\x03\x04" + bytes(2) + b"\x08" + bytes(23), b"\x1f\x8b\x08", b"MThd", b"BM", b"RIFF"):
        assert media.carve(mark * 100_000, machine) == []
    whole = b"%PDF-1.4 x startxref 0 %%EOF"
    assert media.carve(b"%PDF-" * 3 + whole + b"%PDF-" + whole, machine) == [("application/pdf", 15, len(whole)), ("application/pdf", 20 + len(whole), len(whole))]
    page = lambda last: b"OggS\0" + bytes([4 * last]) + bytes(20) + b"\1\3abc"
    assert media.carve(b"x" + page(0) + page(0) + page(1) + page(0), machine) == [("audio/ogg", 1, 3 * len(page(0)))]


def test_crafted_values_take_linear_time():
    """A megabyte for each validator in which every walk runs far, and most run into others."""
    import time

    machine = media.automaton()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    nested = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"teXt", b"x" * 20)
    values = {
        "gif": b"GIF89aAAAAAAA!" * 75_000,
        "gif blocks": b"GIF89a\0\0\0\0\0\0\0!\xf9" * 70_000,
        "gif images": b"GIF89a\0\0\0\0\0\0\0,\0\0\0\0\0\0\0\0\0\2" * 42_000,
        "riff": (b"RIFF\x00\x00\x08\x00WAVE" + bytes(8)) * 52_000,
        "riff zeros": b"RIFF\x00\x00\x08\x00WAVE" * 1_000 + bytes(1_000_000),
        "midi": b"MThd\0\0\0\6\0\0\xff\xff\0\0" * 1_000 + b"MTrk\0\0\0\0" * 120_000,
        "png": nested * 10_000,
        "jpeg": b"\xff\xd8\xff\xe0\0\4ab" * 120_000,
        "jpeg scan": b"\xff\xd8\xff\xda\0\2" + b"ab" * 20 + b"\xff\xd8\xff\xda\0\2" * 150_000,
        "ogg": (b"OggS\0" + bytes(21) + b"\0") * 37_000,
        "pdf": b"%PDF-startxref" * 72_000,
        "zip": (b"PK\x03\x04" + bytes(2) + b"\x08" + bytes(23)) * 33_000,
        "bmp": b"BM" * 500_000,
        "gzip": b"\x1f\x8b\x08\0" * 250_000,
    }
    for name, value in values.items():
        began = time.process_time()
        media.carve(value, machine)
        assert time.process_time() - began < 8, name  # seconds apart from hours, on a busy machine


def test_far_links_equal_steps():
    rng = random.Random(8)
    step = {p: p + rng.choice([1, 1, 2, 3, 7]) for p in range(400)}
    walk = media.Links(lambda p: step[p] if p < 400 else None, lambda p: p % 2 == 0)
    for _ in range(2000):
        p = rng.randrange(400)
        way = [p]
        while way[-1] < 400:
            way.append(step[way[-1]])
        goal, k = rng.randrange(p, 420), rng.randrange(200)
        assert walk.walk(p) == (way[-1], sum(q % 2 == 0 for q in way[:-1]))
        assert walk.reaches(p, goal) == (goal in way) and walk.ahead(p, k) == (way[k] if k < len(way) else None)


def test_texts_survive_storage(odd):
    stored = media.store_texts(odd)
    for r in stored.collect():
        with wave.open(io.BytesIO(bytes(r.content))) as w:
            assert w.getsampwidth() == 1 and w.getnframes() % 64 == 0 and w.getnframes() >= 64
    whole = sorted(map(str, media.text_features(odd).collect()))
    assert whole == sorted(map(str, media.features(media.sniff(stored, keep=("n_bytes",)), keep=("n_bytes",)).collect()))
    got = sorted(map(tuple, media.features(media.sniff(stored, keep=("n_bytes",)), keep=("n_bytes",)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes").collect()), key=str)
    want = []
    for r in odd.collect():
        b = (r.text or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44))
    assert got == sorted(want, key=str)
