"""Byte-level BPE encoding and decoding with one encoding of each distinct word.

1. Each task splits its documents by the vocabulary's pattern into words with their positions, a block of documents at a time. Words
   repeat, so a block keeps its own list of distinct words: a document is a sequence of places in that list (packed, in order of
   position).
2. The lists of all blocks are shuffled by the hash of the word: all occurrences of a word in lists meet in one bucket, and there each
   distinct word of the corpus is encoded once. There are so many buckets that each holds about ``BUCKET_BYTES`` of text's words,
   however large the corpus. A word reaches its bucket once a block, however often it occurs, so frequent words are no hot keys.
3. The ids are joined back to the blocks: a block's part of a bucket keeps its places in the block's list, and goes back with them.
4. Blocks are reassembled: each position looks up the ids of its word.

Words travel packed by block and bucket, not a row each: one row for each distinct word of a block takes more disk than the texts.

Decoding joins each id with the token-byte table, a broadcast index join: the table has a row for each id of the vocabulary and no more.

Defined results: null and empty texts give no ids and no bytes; rows with the same id stay separate rows; other columns are
ignored; long texts make larger blocks, one text at least.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import sliced, texts, trim, trimmed, written

BLOCK_BYTES = 5_000_000
BUCKET_BYTES = 4_000_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file; a token's rank is its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


_encoders: dict[str, object] = {}


def encoder(pattern: str, ranks: dict[bytes, int]):
    """This process's encoder for a vocabulary."""
    if pattern not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[pattern]


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed byte plane by byte plane: small values leave the upper planes empty."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` of those starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself if it only scans, projects and filters, so that each run has the same partitions; else a written copy."""
    todo = [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if not node.nodeName().startswith(("Project", "Filter", "Scan", "LocalTableScan", "Range")):
            return written(df, "bpe-documents")
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return df


def blocks_of(documents: DataFrame, pattern: str, buckets: int, block_bytes: int, words_wanted: bool) -> DataFrame:
    """Either the words of each block by bucket, or each block's documents with their positions.

    A block's words are numbered by falling frequency, so that most positions take one byte. Both forms number them alike: splitting
    the texts a second time costs less than keeping the positions on disk until the words are encoded."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = "block long, bucket int, packed binary, places binary" if words_wanted else f"block long, doc_ids array<{kind}>, counts binary, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        split = regex.compile(pattern).findall
        names = ["block", "bucket", "packed", "places"] if words_wanted else ["block", "doc_ids", "counts", "packed"]
        block = TaskContext.get().partitionId() << 24
        words: dict[str, int] = {}
        found: list[np.ndarray] = []
        ids: list[pa.Array] = []
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            doc_ids = pa.concat_arrays(ids)
            counts = np.array([len(x) for x in found], "<u4")
            seen = np.concatenate(found)
            order = np.argsort(-np.bincount(seen, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            if not words_wanted:
                whole = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), whole, pa.array([pack(counts)], pa.binary()), pa.array([pack(rank[seen])], pa.binary())], names=names)
                return
            listed = list(words)
            spelled = [listed[i].encode() for i in order.tolist()]
            home = np.fromiter((crc32(w) for w in spelled), np.uint32, len(spelled)) % buckets
            by_home = np.argsort(home, kind="stable")
            groups = [g for g in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1) if len(g)]
            packed, places = [], []
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for g in groups:
                own = [spelled[i] for i in g.tolist()]
                sizes = np.array([len(w) for w in own], "<u4")
                packed.append(squeeze(len(own).to_bytes(4, "little") + sizes.tobytes() + b"".join(own)))
                places.append(pack(np.diff(g, prepend=0)))
            n = len(groups)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([int(home[g[0]]) for g in groups], pa.int32()), pa.array(packed, pa.binary()), pa.array(places, pa.binary())], names=names)

        for part in sliced(batches, "text", block_bytes // 8):
            for text in part.column("text").to_pylist():
                known = words.setdefault
                found.append(np.array([known(w, len(words)) for w in split(text)], "<u4"))
                held += len(text)
            ids.append(part.column("doc_id"))
            if held >= block_bytes:
                yield from closed()
                block, held = block + 1, 0
                words, found, ids = {}, [], []
        if found:
            yield from closed()
            words, found, ids = {}, [], []

    return documents.mapInArrow(trimmed(run), schema)


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table, indexed by id: all bytes, and where each token's begin and how many they are."""
    sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8), np.cumsum(sizes) - sizes, sizes


def spelled_out(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    flat, starts, sizes = table
    return gathered(flat, starts[ids], sizes[ids]).tobytes()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row; ids as little-endian unsigned 32-bit integers in one binary value. With ``decoded`` also the
    bytes of those ids, as ``decode`` gives them, without a worker of its own."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    documents = stable(texts(df, id_col, text_col))
    kind = documents.schema["doc_id"].dataType.simpleString()
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    words = blocks_of(documents, pattern, buckets, block_bytes, words_wanted=True)

    def encode_words(lists: pa.Table) -> pa.Table:
        # a word is a match of the pattern already and is not split again
        whole = encoder(pattern, ranks.value)._encode_single_piece
        known: dict[bytes, bytes] = {}
        open_, out = zstandard.ZstdDecompressor(), []
        for data in lists.column("packed"):
            raw = open_.decompress(data.as_py())
            count = int.from_bytes(raw[:4], "little")
            ends = np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64) + 4 + 4 * count
            ids, sizes, start = [], [], 4 + 4 * count
            for end in ends.tolist():
                word = raw[start:end]
                start = end
                own = known.get(word)
                if own is None:
                    own = known[word] = np.array(whole(word), "<u4").tobytes()
                ids.append(own)
                sizes.append(len(own) >> 2)
            out.append(pack(np.concatenate([np.array([count, *sizes], "<u4"), np.frombuffer(b"".join(ids), "<u4")])))
        trim()
        return pa.table({"block": lists.column("block"), "places": lists.column("places"), "coded": pa.array(out, pa.binary())})

    coded = words.groupBy("bucket").applyInArrow(encode_words, "block long, places binary, coded binary")

    def reassemble(own: pa.Table, lists: pa.Table) -> pa.Table:
        flat, sizes_of, at_of, base = [], [], [], 0
        for places, data in zip(lists.column("places").to_pylist(), lists.column("coded").to_pylist(), strict=True):
            values = unpack(data)
            count = int(values[0])
            sizes = values[1 : 1 + count].astype(np.int64)
            flat.append(values[1 + count :])
            at_of.append(np.cumsum(unpack(places), dtype=np.int64))
            sizes_of.append(np.stack([base + np.cumsum(sizes) - sizes, sizes]))
            base += int(sizes.sum())
        table = np.zeros((2, sum(map(len, at_of))), np.int64)
        if at_of:
            table[:, np.concatenate(at_of)] = np.concatenate(sizes_of, axis=1)
        ids = np.concatenate([*flat, np.zeros(0, "<u4")])
        doc_ids, out, n_ids, back = own.column("doc_ids").combine_chunks().flatten(), [], [], []
        bytes_of = token_bytes(ranks.value) if decoded else None
        for counts, data in zip(own.column("counts").to_pylist(), own.column("packed").to_pylist(), strict=True):
            every, at = unpack(data), 0
            for n_words in unpack(counts).tolist():
                own_ids = gathered(ids, *table[:, every[at : at + n_words]])
                at += n_words
                n_ids.append(len(own_ids))
                out.append(own_ids.tobytes())
                if bytes_of:
                    back.append(spelled_out(np.frombuffer(out[-1], "<u4"), bytes_of))
        trim()
        columns = {"doc_id": doc_ids, "n_tokens": pa.array(n_ids, pa.int64()), "ids": pa.array(out, pa.binary())}
        return pa.table(columns | ({"decoded": pa.array(back, pa.binary())} if decoded else {}))

    positions = blocks_of(documents, pattern, buckets, block_bytes, words_wanted=False)
    return positions.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(reassemble, f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes of each row's ids, none for a null."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = df.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks.value)
        for part in sliced(batches, ids_col, 2_000_000):
            done = [spelled_out(np.frombuffer(ids or b"", "<u4"), table) for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], [*part.schema.names, "decoded"])

    return df.mapInArrow(trimmed(run), schema)
