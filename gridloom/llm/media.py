"""Media columns: signature sniffing, correction of declared types, carving of embedded media.

An Aho-Corasick automaton over the magic bytes of all known formats finds every place where a format may begin, in one pass
over a value. A validator of that format then walks its structure from there (chunk lengths, checksums, end markers) and gives
the length, or refuses; what a walk has found of a value is kept for the next. The format that validates at offset 0 is the value's true type; those that validate further in, and
outside what has been carved before, are embedded media.

Defined results: null and empty values have no type (null) and nothing embedded; equal values give equal results; rows
with the same id stay separate rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import sliced, texts, trimmed

BATCH_BYTES = 4_000_000
UNIT = 64
RATE = 8000
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


class Links:
    """Where ``step`` leads from a place, again and again until it gives None. Each place is stepped from once, however many walks run into it;
    it keeps its next place, how many steps are left and how many of them count, and one far link, by which any place
    further on is found in a logarithm of the steps (each far link spans as much as two equal ones that follow, or one step)."""

    def __init__(self, step: Callable[[int], int | None], counts: Callable[[int], bool] = lambda p: True):
        self.step, self.counts = step, counts
        self.known: dict[int, tuple[int, int, int, int, int]] = {}  # end, steps left, counted, next, far

    def walk(self, p: int) -> tuple[int, int]:
        """The end of the walk from ``p`` and the number of steps that count."""
        path, known = [], self.known
        while p not in known:
            nxt = self.step(p)
            if nxt is None:
                known[p] = (p, 0, 0, p, p)
            else:
                path.append(p)
                p = nxt
        for q in reversed(path):
            end, left, n, _, far = known[p]
            two = known[far]
            known[q] = (end, left + 1, n + self.counts(q), p, two[4] if left - two[1] == two[1] - known[two[4]][1] else p)
            p = q
        end, _, n, _, _ = known[p]
        return end, n

    def reaches(self, p: int, goal: int) -> bool:
        """Whether ``goal`` is on the walk from ``p``; places only grow."""
        self.walk(p)
        while p < goal:
            _, left, _, nxt, far = self.known[p]
            if not left:
                return False
            p = far if far <= goal else nxt
        return p == goal

    def ahead(self, p: int, steps: int) -> int | None:
        """The place that many steps on; None where the walk ends before."""
        self.walk(p)
        goal = self.known[p][1] - steps
        while goal >= 0 and self.known[p][1] > goal:
            _, _, _, nxt, far = self.known[p]
            p = far if self.known[far][1] >= goal else nxt
        return p if goal >= 0 else None


def links(seen: dict, name: str, step: Callable[[int], int | None], counts: Callable[[int], bool] = lambda p: True) -> Links:
    """The links of a value by that name, made once."""
    if name not in seen:
        seen[name] = Links(step, counts)
    return seen[name]


def png(b: bytes, at: int, seen: dict) -> int | None:
    def chunk(p: int) -> int | None:
        """The end of a chunk whose checksum is right."""
        if p + 12 > len(b):
            return None
        end = p + 12 + struct.unpack_from(">I", b, p)[0]
        return end if end <= len(b) and zlib.crc32(b[p + 4 : end - 4]) == struct.unpack_from(">I", b, end - 4)[0] else None

    first = at + 8
    if b[first : first + 8] != b"\0\0\0\rIHDR":
        return None
    last, _ = links(seen, "png", lambda p: None if b[p + 4 : p + 8] == b"IEND" else chunk(p)).walk(first)
    end = chunk(last) if b[last + 4 : last + 8] == b"IEND" else None
    return end and end - at


def gif(b: bytes, at: int, seen: dict) -> int | None:
    data = links(seen, "gif data", lambda p: p + b[p] + 1 if p < len(b) and b[p] else None)

    def block(p: int) -> int | None:
        if p + 2 <= len(b) and b[p] == 0x21:
            return data.walk(p + 2)[0] + 1
        if p + 10 <= len(b) and b[p] == 0x2C:
            return data.walk(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))[0] + 1
        return None

    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    end, images = links(seen, "gif", block, lambda p: b[p] == 0x2C).walk(at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
    return end + 1 - at if images and b[end : end + 1] == b"\x3b" else None


def jpeg(b: bytes, at: int, seen: dict) -> int | None:
    def segment(p: int) -> int | None:
        if p + 4 > len(b) or b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            return p + 1
        n = struct.unpack_from(">H", b, p + 2)[0]
        if kind in (0x00, 0xD8, 0xD9) or n < 2:
            return None
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data ends at a marker that is neither stuffing nor a restart
            found = MARKER.search(b, p)
            p = found.start() if found else len(b)
        return p

    frame = lambda p: 0xC0 <= b[p + 1] <= 0xCF and b[p + 1] not in (0xC4, 0xC8, 0xCC)
    end, frames = links(seen, "jpeg", segment, frame).walk(at + 2)
    return end + 2 - at if frames and b[end : end + 2] == b"\xff\xd9" else None


def bmp(b: bytes, at: int, seen: dict) -> int | None:
    if at + 30 > len(b):
        return None
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= start <= n
    return n if ok and zero == 0 and at + n <= len(b) else None


def riff(b: bytes, at: int, seen: dict) -> int | None:
    if at + 12 > len(b):
        return None
    n = struct.unpack_from("<I", b, at + 4)[0] + 8
    if n < 12 or at + n > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    chunks = links(seen, "riff", lambda p: p + 8 + (size := struct.unpack_from("<I", b, p + 4)[0]) + (size & 1) if p + 8 <= len(b) else None)
    start, end = at + 12, at + n  # an odd length may leave out the last chunk's padding
    whole = chunks.reaches(start, end) or bool(n & 1) and chunks.reaches(start, end + 1) and not chunks.reaches(start, end - 7)
    return n if n > 12 and whole else None


def gzip(b: bytes, at: int, seen: dict) -> int | None:
    d, whole, p = zlib.decompressobj(31), memoryview(b), at
    try:
        while p < len(b) and not d.eof:
            data = whole[p : p + 65_536]
            p += len(data)
            while len(data) and not d.eof:
                d.decompress(data, 1 << 20)
                data = d.unconsumed_tail
    except zlib.error:
        return None
    return p - at - len(d.unused_data) if d.eof else None


def places(b: bytes, mark: bytes, seen: dict) -> list[int]:
    """Where the mark begins, in order; looked for once a value."""
    if mark not in seen:
        seen[mark] = [m.start() for m in re.finditer(re.escape(mark), b)]
    return seen[mark]


def after(b: bytes, mark: bytes, at: int, seen: dict) -> int:
    """The first place of the mark from ``at`` on, or -1."""
    every = places(b, mark, seen)
    k = bisect_left(every, at)
    return every[k] if k < len(every) else -1


def zip_(b: bytes, at: int, seen: dict) -> int | None:
    def entry(p: int) -> int | None:
        if b[p : p + 4] != b"PK\x03\x04" or p + 30 > len(b):
            return None
        flags, size, name, extra = struct.unpack_from("<6xH10xI4xHH", b, p)
        if flags & 8:  # the size is not told: the entry ends at the next header
            nxt = [x for x in (after(b, mark, p + 30 + name + extra, seen) for mark in (b"PK\x03\x04", b"PK\x01\x02")) if x >= 0]
            return min(nxt, default=None)
        return p + 30 + name + extra + size

    def listed(p: int) -> int | None:
        if b[p : p + 4] != b"PK\x01\x02" or p + 46 > len(b):
            return None
        return p + 46 + sum(struct.unpack_from("<28xHHH", b, p))

    p, entries = links(seen, "entry", entry).walk(at)
    p, rows = links(seen, "listed", listed).walk(p)
    if entries != rows or b[p : p + 4] != b"PK\x05\x06" or p + 22 > len(b):
        return None
    end = p + 22 + struct.unpack_from("<20xH", b, p)[0]
    return end - at if end <= len(b) else None


def pdf(b: bytes, at: int, seen: dict) -> int | None:
    start, nxt = after(b, b"startxref", at, seen), after(b, b"%PDF-", at + 5, seen)
    ends = places(b, b"%%EOF", seen)
    k = bisect_left(ends, nxt - 4 if nxt > 0 else len(b)) - 1
    return ends[k] + 5 - at if k >= 0 and 0 < start < ends[k] else None


def ogg(b: bytes, at: int, seen: dict) -> int | None:
    def page(p: int) -> int | None:
        if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4] or b[p + 5] & 4:
            return None
        n = 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        return p + n if p + n <= len(b) else None

    p, _ = links(seen, "page", page).walk(at)
    if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4] or not b[p + 5] & 4:
        return None
    end = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
    return end - at if end <= len(b) else None


def midi(b: bytes, at: int, seen: dict) -> int | None:
    if b[at + 4 : at + 8] != b"\0\0\0\6" or at + 14 > len(b):
        return None
    tracks = links(seen, "track", lambda p: p + 8 + struct.unpack_from(">I", b, p + 4)[0] if b[p : p + 4] == b"MTrk" and p + 8 <= len(b) else None)
    end = tracks.ahead(at + 14, struct.unpack_from(">H", b, at + 10)[0])
    return end - at if end is not None and at + 14 < end <= len(b) else None


#: Magic bytes, what stands for the type (or the rule that gives it), the validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, dict], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"RIFF", "riff", riff),
    (b"\x1f\x8b\x08", "application/gzip", gzip),
    (b"PK\x03\x04", "application/zip", zip_),
    (b"%PDF-", "application/pdf", pdf),
    (b"OggS", "audio/ogg", ogg),
    (b"MThd", "audio/midi", midi),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), k)
    out.make_automaton()
    return out


def carve(b: bytes, machine) -> list[tuple[str, int, int]]:
    """``(type, offset, length)`` of every valid piece of media, in order of offset; pieces inside others are left out but for
    those inside a piece that spans the whole value."""
    out, free, seen = [], 0, {}
    hits = sorted((end + 1 - len(FORMATS[k][0]), k) for end, k in machine.iter(b.decode("latin-1")))
    for at, k in hits:
        if at < free:
            continue
        _, kind, length_of = FORMATS[k]
        length = length_of(b, at, seen)
        if length:
            if kind == "riff":
                kind = RIFF_TYPES[b[at + 8 : at + 12]]
            out.append((kind, at, length))
            if at or length < len(b):
                free = at + length
    return out


PIECE = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
FOUND = "detected string, corrected boolean, media array<struct<type:string,offset:long,length:long>>"


def sniffed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``content`` and ``declared``, and what was found beside them."""
    machine = automaton()
    for part in sliced(batches, "content", BATCH_BYTES):
        detected, corrected, media = [], [], []
        for value, declared in zip(part.column("content").to_pylist(), part.column("declared").to_pylist(), strict=True):
            found = carve(value or b"", machine)
            whole = next((k for k, at, _ in found if at == 0), None)
            detected.append(whole)
            corrected.append(whole is not None and whole != declared)
            media.append([{"type": k, "offset": at, "length": n} for k, at, n in found if at])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(detected, pa.string()), pa.array(corrected, pa.bool_()), pa.array(media, pa.list_(PIECE))], [*part.schema.names, "detected", "corrected", "media"])


def sniff(df: DataFrame, content_col: str = "content", declared_col: str = "declared", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, content, declared, detected, corrected, media``: the true type of each value, whether that corrects the declared one,
    and the embedded pieces as ``array<struct<type, offset, length>>``. keep: more columns of ``df`` to carry along."""
    source = df.select(df[id_col].alias("doc_id"), df[content_col].cast("binary").alias("content"), df[declared_col].cast("string").alias("declared"), *(df[c] for c in keep))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(trimmed(sniffed), f"{fields}, {FOUND}")


def carved(sniffed: DataFrame) -> DataFrame:
    """One row per embedded piece: ``doc_id, type, offset, bytes``."""
    return sniffed.selectExpr("doc_id", "content", "explode(media) as m").selectExpr("doc_id", "m.type", "m.offset", "substring(content, cast(m.offset + 1 as int), cast(m.length as int)) as bytes")


def wav_of(payload: bytes) -> bytes:
    """A mono file of unsigned 8-bit samples."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples_of(stored: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a file of unsigned 8-bit samples, by walking its chunks."""
    p, rate = 12, 0
    while p + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, p)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", stored, p + 12)[0]
        elif name == b"data":
            return rate, stored[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``doc_id`` and ``text`` as ``doc_id, n_bytes, content, declared``."""
    for part in sliced(batches, "text", BATCH_BYTES):
        raw = [t.encode() for t in part.column("text").to_pylist()]
        waves = [wav_of(b + b"\0" * (-len(b) % UNIT if b else UNIT)) for b in raw]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(waves, pa.binary()), pa.array(["application/octet-stream"] * len(raw))], ["doc_id", "n_bytes", "content", "declared"])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, content, declared``: each text's bytes, padded by 0 to a positive multiple of 64, as audio samples."""
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(trimmed(stored), f"doc_id {kind}, n_bytes long, content binary, declared string")


DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
DIGEST_TYPES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digested(batches: Iterable[pa.RecordBatch], front: list[str]) -> Iterator[pa.RecordBatch]:
    """Sniffed batches of stored audio as the columns ``front`` and the digests."""
    for part in sliced(batches, "content", BATCH_BYTES):
        cols: list[list] = [[] for _ in DIGESTS]
        for value, detected, media in zip(part.column("content").to_pylist(), part.column("detected").to_pylist(), part.column("media").to_pylist(), strict=True):
            rate, payload = samples_of(value)
            x = np.frombuffer(payload, np.uint8)
            wave = x.astype(np.int16) - 128
            said = f"{detected};rate={rate};bits=8;channels=1;samples={len(x)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};energy={int((wave.astype(np.int64) ** 2).sum())};crossings={int(((wave[1:] < 0) != (wave[:-1] < 0)).sum())};embedded={len(media)}"
            for col, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(value), hashlib.sha256(value).hexdigest(), said), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in front), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*front, *DIGESTS])


def features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Digests and features of stored audio that has been sniffed, from the stored bytes: ``doc_id``, the kept columns, and ``DIGESTS``."""
    front = ["doc_id", *keep]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in front)
    return df.mapInArrow(trimmed(lambda batches: digested(batches, front)), f"{fields}, {DIGEST_TYPES}")


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``store_texts``, ``sniff`` and ``features`` one after another, in one worker instead of three: ``doc_id, n_bytes`` and ``DIGESTS``."""
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(trimmed(lambda batches: digested(sniffed(stored(batches)), ["doc_id", "n_bytes"])), f"doc_id {kind}, n_bytes long, {DIGEST_TYPES}")
