"""Repeated substrings by merging the Burrows-Wheeler transforms of shards, for as many texts as one task holds.

A shard's transform is the symbol before each of its suffixes, in the order of its suffixes. The merge refines an interleave of the shards:
after h rounds suffixes are ordered by their first h symbols, and a round moves each to where the suffix that begins one symbol
earlier belongs (a stable sort of the symbols of the transforms as the present interleave reads them). An interval of suffixes
that agree in h symbols is split where their transforms' symbols or their present intervals differ; the round in which two neighbours part
is their common prefix. An interval of one suffix is settled: what precedes it is of one suffix too, so it leaves the refinement.
No suffix is sorted again.

``repeats`` uses other means on a cluster: every round is a shuffle of all that is not settled, and passages that many documents
share stay for as many rounds as strings are long. The README has measured figures. The tests hold both against each other.

Defined results: an end mark that equals no other ends each text, so nothing crosses texts; empty texts have no suffixes.
"""

from __future__ import annotations

import numpy as np


def shard_order(raw: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a shard ordered by their first ``depth`` symbols, by doubling."""
    rank = raw.astype(np.int64)
    n, size = len(raw), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - size, 0)] = rank[size:]
        order = np.lexsort((after, rank))
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)])) if n else 0
        rank, size = new, size * 2
        if size >= depth or not n or rank.max() == n - 1:
            return order


def merged(shards: list[list[bytes]], depth: int) -> tuple[list[list[np.ndarray]], int, int]:
    """For each shard and text the starts whose string of ``depth`` bytes also starts elsewhere; the rounds; and the suffixes that were moved
    in all rounds together."""
    marks = sum(map(len, shards))
    symbols, orders, base, ends = [], [], [0], []
    mark = 0
    for texts in shards:
        parts = []
        for t in texts:
            parts += [np.frombuffer(t, np.uint8).astype(np.int64) + marks, np.array([mark])]  # end marks come before all symbols, each its own
            mark += 1
        raw = np.concatenate([*parts, np.zeros(0, np.int64)])
        symbols.append(raw)
        orders.append(shard_order(raw, depth) + base[-1])
        base.append(base[-1] + len(raw))
        ends.append(np.cumsum([len(t) + 1 for t in texts]))
    whole = np.concatenate([*symbols, np.zeros(0, np.int64)])
    before = np.concatenate([[-1], whole[:-1]])  # the transform's symbol by suffix; a text's first suffix has the end mark before it
    # the interleave by the first symbol: shards are merged stably
    every = np.concatenate([*orders, np.zeros(0, np.int64)])
    now = every[np.argsort(whole[every], kind="stable")]
    now = now[whole[now] >= marks]
    part = np.concatenate([[0], np.cumsum(np.diff(whole[now]) != 0)]) if len(now) else np.zeros(0, np.int64)
    rounds = moved = 0
    for _ in range(depth):
        # settled intervals leave
        size = np.bincount(part, minlength=1)
        keep = size[part] > 1
        now, part = now[keep], part[keep]
        if rounds == depth - 1 or not len(now):
            break
        symbol = before[now]
        inner = symbol >= marks
        now, part, symbol = now[inner], part[inner], symbol[inner]
        order = np.argsort((symbol - marks).astype(np.uint8), kind="stable")
        now, part, symbol = now[order] - 1, part[order], symbol[order]
        moved, rounds = moved + len(now), rounds + 1
        part = np.concatenate([[0], np.cumsum((np.diff(symbol) != 0) | (np.diff(part) != 0))]) if len(now) else part
    out = []
    starts = np.sort(now)
    for k, texts in enumerate(shards):
        own = starts[(starts >= base[k]) & (starts < base[k + 1])] - base[k]
        which = np.searchsorted(ends[k], own, side="right")
        first = ends[k] - np.array([len(t) + 1 for t in texts], np.int64) if len(texts) else ends[k]
        out.append([own[which == i] - first[i] for i in range(len(texts))])
    return out, rounds, moved
