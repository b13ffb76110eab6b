"""Token counts by compiled finite-state transducers.

Two transducers are compiled from a byte-level BPE tokenizer file:

* a boundary transducer over character classes marks where the pre-tokens begin (its states are the class of the previous
  character and of the one before, with one character of look-ahead for the white-space rule);
* a count transducer over bytes, reset at each boundary, whose transitions are annotated with the number of tokens by which
  the encoding grows. Its states are the longest suffix that may still grow into a token, with the last token of the
  encoding at each place where such a token could begin. Whether a token may follow another is a fixed relation
  of the merge table, so a state and a byte fix the next state: the transducer is deterministic. It is made on demand.

A text is cut into chunks of equal length. Each chunk's state map is a constant after its first boundary, so all chunks run
in step (one numpy operation for the n-th byte of every chunk). A chunk without a boundary has a map from entry states to exit
states; it is tabulated for the states that the chunks before it reach from the start state, and the maps of a run of such chunks are
composed by a parallel prefix scan in a logarithmic number of steps. Where a run leaves the tabulated states, it is tabulated
for more, at last chunk by chunk. Then every chunk knows its entry state, and the bytes before its first boundary are run from there. Counts add up.

Chunks are worked on a segment at a time, and the state at a segment's end enters the next. Between segments the table of
transitions may be emptied, so it stays small however long a text is.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows with the same id stay separate rows; other columns are
ignored; texts may be of any length, as a chunk is the unit of work.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import sliced, texts, trimmed

LETTER, NUMBER, OTHER, SPACE, BLANK = 0, 1, 2, 3, 4
CHUNK = 192
BATCH_BYTES = 3_000_000
MAX_STATES = 400_000
#: Bytes that are worked on at a time. The table has room for a transition at each.
SEGMENT = 1 << 20
#: So many entry states of each chunk are tabulated at once.
MOST_GUESSES = 8


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level tokenizer files use for bytes, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def class_table(tokenizer) -> np.ndarray:
    """Character class by code point, as the tokenizer's own pre-tokenizer has it (its Unicode version need not be ours)."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern, mate in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1")):
        found = regex.findall(pattern, every)
        for i in range(0, len(found), 20_000):
            part = found[i : i + 20_000]
            starts = {at[0] for _, at in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"{mate}{c}{mate}\n" for c in part))}
            out[[ord(c) for k, c in enumerate(part) if 4 * k + 1 not in starts and 4 * k + 2 not in starts]] = kind
    out[[ord(c) for c in regex.findall(r"\s", every)]] = SPACE
    out[0x20] = BLANK
    return out


@lru_cache(maxsize=4)
def compiled(path: str) -> dict:
    """The parts of a tokenizer file that the transducers are made of; their size is that of the vocabulary."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    spelled = lambda token: bytes(alphabet[c] for c in token)
    special = [x["content"] for x in spec["added_tokens"]]
    vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return {
        "tokens": {i: spelled(token) for token, i in vocab.items()},
        "merges": {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)},
        "classes": class_table(Tokenizer.from_file(path)),
        "special": special,
    }


def boundaries(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. codes: code points of all texts; kind: their classes; first: True at each text's start."""
    n = len(codes)
    last = np.empty(n, bool)
    last[:-1], last[-1:] = first[1:], True
    white = kind >= SPACE
    before = np.empty(n, np.uint8)
    before[0:1], before[1:] = SPACE, kind[:-1]
    before[first] = SPACE
    after_white = np.empty(n, bool)  # the next character of the same text is white space, or there is none
    after_white[:-1], after_white[-1:] = white[1:], True
    after_white[last] = True
    same = before == kind
    word = ~white & ~same & (before != BLANK)
    gap = white & ((before < SPACE) | ~after_white)
    out = word | gap | first
    # contractions: an apostrophe that begins a pre-token takes 's 't 'm 'd or 're 've 'll with it
    quote = np.flatnonzero((codes == 0x27) & ((before != OTHER) & (before != BLANK) | first) & ~last)
    if len(quote):
        c1 = codes[quote + 1]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        inner = np.flatnonzero(~last[quote + 1])
        c2 = codes[quote[inner] + 2]
        two[inner] = ((c1[inner] == ord("r")) | (c1[inner] == ord("v"))) & (c2 == ord("e")) | (c1[inner] == ord("l")) & (c2 == ord("l"))
        out[quote[one | two] + 1] = False
        out[quote[two] + 2] = False
        end = np.concatenate([quote[one] + 2, quote[two] + 3])
        out[end[end < n]] = True
        # white space after it begins or not by its own rule; a letter that was joined to the contraction begins a pre-token
    return out


class CountTransducer:
    """Deterministic transducer over bytes; transitions are made when first met and kept in an open-addressing table."""

    BITS = 21

    def __init__(self, tokens: dict[int, bytes], merges: dict[tuple[int, int], tuple[int, int]]):
        self.tokens, self.merges = tokens, merges
        self.single = {t[0]: i for i, t in tokens.items() if len(t) == 1}
        self.child: dict[int, int] = {}
        self.depth, self.token = [0], [-1]
        for i, t in tokens.items():
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = i
        self.fail = [0] * len(self.depth)
        for key, node in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            parent, b = key >> 8, key & 255
            if parent:
                self.fail[node] = self.step(self.fail[parent], b)
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def step(self, node: int, b: int) -> int:
        while True:
            nxt = self.child.get(node << 8 | b)
            if nxt is not None:
                return nxt
            if not node:
                return 0
            node = self.fail[node]

    def reset(self) -> None:
        start = array("i", [0, -1, 0]).tobytes()
        self.states, self.index = [start], {start: 0}
        self.bits = self.BITS
        self.empty()
        self.held = 0

    def empty(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.gain = np.zeros(1 << self.bits, np.int32)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes together are encoded as just these two tokens."""
        if a < 0:
            return True
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 400_000:
                self.follows.clear()
            known = self.follows[a, b] = self.encode(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def encode(self, word: bytes) -> list[int]:
        parts, merges = [self.single[b] for b in word], self.merges
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = merges.get((parts[k], parts[k + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, k
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def follow(self, state: int, b: int) -> tuple[int, int]:
        """The next state and the growth of the count, by the definition."""
        node, *rest = array("i", self.states[state])
        at: dict[int, tuple[int, int]] = {}  # by distance: last token there, count relative to the present one
        walk, k = node, 0
        while True:
            at[self.depth[walk]] = (rest[k], rest[k + 1])
            k += 2
            if not walk:
                break
            walk = self.fail[walk]
        nxt = self.step(node, b)
        walk = nxt
        while True:
            t = self.token[walk]
            if t >= 0:
                prev, rel = at[self.depth[walk] - 1]
                if self.may_follow(prev, t):
                    gain = rel + 1
                    break
            walk = self.fail[walk]
        out, walk = [nxt], nxt
        while True:
            d = self.depth[walk]
            out += [t, 0] if d == 0 else [at[d - 1][0], at[d - 1][1] - gain]
            if not walk:
                break
            walk = self.fail[walk]
        key = array("i", out).tobytes()
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.states)
            self.states.append(key)
        return found, gain

    def place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def advance(self, states: np.ndarray, octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of all chunks: next states and gains."""
        keys = states.astype(np.int64) << 8 | octets
        bits = 0
        while True:
            if bits != self.bits:  # the table has grown
                bits, mask, slot = self.bits, (1 << self.bits) - 1, self.place(keys)
            there = self.keys[slot]
            wrong = np.flatnonzero(there != keys)
            if not len(wrong):
                return self.to[slot], self.gain[slot]
            vacant, taken = wrong[there[wrong] == -1], wrong[there[wrong] != -1]
            slot[taken] = (slot[taken] + 1) & mask
            for key in np.unique(keys[vacant]).tolist():
                self.add(key)
            if bits == self.bits:
                slot[vacant] = self.place(keys[vacant])  # probe again from the start: others may have been placed meanwhile

    def add(self, key: int) -> None:
        if self.held * 2 > len(self.keys):
            self.grow()
        mask = (1 << self.bits) - 1
        s = int(self.place(np.array([key]))[0])
        while self.keys[s] != -1 and self.keys[s] != key:
            s = (s + 1) & mask
        if self.keys[s] == key:
            return
        self.to[s], self.gain[s] = self.follow(key >> 8, key & 255)
        self.keys[s] = key
        self.held += 1

    def grow(self) -> None:
        """A table of twice the size, with the same transitions."""
        held = np.flatnonzero(self.keys >= 0)
        keys, to, gain = self.keys[held], self.to[held], self.gain[held]
        self.bits += 1
        self.empty()
        mask = (1 << self.bits) - 1
        slot, left = self.place(keys), np.arange(len(keys))
        while len(left):
            vacant = left[self.keys[slot[left]] == -1]
            self.keys[slot[vacant]] = keys[vacant]  # one of those that meet here wins
            self.to[slot[vacant]], self.gain[slot[vacant]] = to[vacant], gain[vacant]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & mask
        own = np.flatnonzero(self.keys[slot] == keys)
        self.to[slot[own]], self.gain[slot[own]] = to[own], gain[own]

    def known(self, key: bytes) -> int:
        """The number of a state, which is made if it is not there."""
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.states)
            self.states.append(key)
        return found


def composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each chunk the column that its entry state has, -1 if it has none. maps: from the columns of the chunk before to its own;
    first: whose maps are constant. An inclusive scan that composes maps over spans of doubling length."""
    out, fixed, span = maps.copy(), first.copy(), 1
    while span < len(out):
        left, right = out[:-span], out[span:]
        both = np.where(left < 0, -1, np.take_along_axis(right, np.maximum(left, 0), 1))
        done = np.where(fixed[span:, None], right, both)
        fixed = np.concatenate([fixed[:span], fixed[span:] | fixed[:-span]])
        out = np.concatenate([out[:span], done])
        span *= 2
    return out[:, 0]


def entry_states(machine: CountTransducer, padded: np.ndarray, chunks: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The entry state of each of the chunks without a boundary. before: the exit state of the chunk before, -1 where that has no
    boundary either."""
    first = before >= 0
    if first.all():
        return before
    content = np.unique(np.ascontiguousarray(padded[:, chunks].T).view(f"V{CHUNK}").ravel(), return_inverse=True)[1].astype(np.int64)

    def through(entry: np.ndarray) -> np.ndarray:
        _, one, back = np.unique(content << 32 | entry, return_index=True, return_inverse=True)
        state = entry[one]
        for k in range(CHUNK):
            state, _ = machine.advance(state, padded[k, chunks[one]])
        return state[back]

    each = np.arange(len(chunks))
    guess = np.where(first, before, 0).astype(np.int64)
    entries, exits = [guess], [through(guess).astype(np.int64)]
    while True:
        c, x = np.stack(entries, 1), np.stack(exits, 1)
        maps = np.zeros(c.shape, np.int64)
        for k in range(c.shape[1]):
            same = x[:-1, k : k + 1] == c[1:]
            maps[1:, k] = np.where(same.any(axis=1), same.argmax(axis=1), -1)
        maps[first] = 0
        column = composed(maps, first)
        if (column >= 0).all():
            return c[each, column]
        if len(entries) == MOST_GUESSES:
            break
        # what the chunks before reach from the start state, one chunk further back than the last time
        guess = np.where(first, before, np.concatenate([[0], x[:-1, -1]]))
        entries.append(guess)
        exits.append(through(guess).astype(np.int64))
    # a run that keeps leaving the tabulated states is walked; equal chunks with equal entry states are tabulated once
    known = dict(zip(zip(np.repeat(content, len(entries)).tolist(), c.ravel().tolist(), strict=True), x.ravel().tolist(), strict=True))
    out, last = before.copy(), 0
    for i, own in enumerate(content.tolist()):
        if not first[i]:
            out[i] = last
        key = own, int(out[i])
        if key not in known:
            state = out[i : i + 1]
            for k in range(CHUNK):
                state, _ = machine.advance(state, padded[k, chunks[i : i + 1]])
            known[key] = int(state[0])
        last = known[key]
    return out


def run_chunks(machine: CountTransducer, octets: np.ndarray, starts: np.ndarray, enter: int = 0) -> tuple[np.ndarray, int]:
    """The growth of the count at each byte, and the last state. starts: where pre-tokens begin; enter: the state before byte 0."""
    n = len(octets)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint8)
    padded[:n] = octets
    flag = np.zeros(rows * CHUNK, bool)
    flag[:n] = starts
    padded, flag = np.ascontiguousarray(padded.reshape(rows, CHUNK).T), np.ascontiguousarray(flag.reshape(rows, CHUNK).T)
    out = np.zeros((CHUNK, rows), np.int32)
    length = np.full(rows, CHUNK)
    length[-1] = n - (rows - 1) * CHUNK
    constant = flag.any(axis=0)
    head = np.where(constant, flag.argmax(axis=0), length)
    # the constant part of every map: from the first boundary on
    state = np.zeros(rows, np.int32)
    for k in range(CHUNK):
        run = np.flatnonzero((head <= k) & (k < length))
        if len(run):
            entry = np.where(flag[k, run], 0, state[run])
            state[run], out[k, run] = machine.advance(entry, padded[k, run])
    before = np.concatenate([[enter], state[:-1]]).astype(np.int64)
    without = np.flatnonzero(~constant)
    if len(without):
        known = np.concatenate([[True], constant[:-1]])
        before[without] = entry_states(machine, padded, without, np.where(known[without], before[without], -1))
    # chunks without a boundary first, as the others' entry states come from them
    for some in (without, np.flatnonzero(constant & (head > 0))):
        if some is not without:
            before[1:] = np.where(constant[:-1], before[1:], state[:-1])
        entry = before[some].astype(np.int32)
        for k in range(int(head[some].max(initial=0))):
            run = np.flatnonzero(head[some] > k)
            entry[run], out[k, some[run]] = machine.advance(entry[run], padded[k, some[run]])
        state[some] = np.where(constant[some], state[some], entry)
    return out.T.reshape(-1)[:n], int(state[-1])


def run_segments(machine: CountTransducer, octets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The growth of the count at each byte. starts: where pre-tokens begin; byte 0 of each text is one of them."""
    gains, entry = np.zeros(len(octets), np.int32), machine.states[0]
    for at in range(0, len(octets), SEGMENT):
        if len(machine.states) > MAX_STATES or machine.held > (1 << machine.BITS) // 4:
            machine.reset()
        part = slice(at, at + SEGMENT)
        gains[part], last = run_chunks(machine, octets[part], starts[part], machine.known(entry))
        entry = machine.states[last]
    return gains


_machines: dict[int, CountTransducer] = {}


def count_texts(values: list[str], spec: dict, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 length and token count of each text."""
    machine = _machines.get(key)
    if machine is None:
        _machines.clear()
        machine = _machines[key] = CountTransducer(spec["tokens"], spec["merges"])
    pieces, owner, special = [], [], np.zeros(len(values), np.int64)
    lengths = np.zeros(len(values), np.int64)
    for i, text in enumerate(values):
        parts = [text]
        for mark in spec["special"]:
            if mark in text:
                parts = [x for p in parts for x in p.split(mark)]
                n = text.count(mark)
                special[i] += n
                lengths[i] += n * len(mark.encode())
        for p in parts:
            if p:
                pieces.append(p)
                owner.append(i)
    if not pieces:
        return lengths, special
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.array([len(p) for p in pieces])
    first = np.zeros(len(codes), bool)
    first[np.concatenate([[0], np.cumsum(chars)[:-1]])] = True
    begins = boundaries(codes, spec["classes"][codes], first)
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])
    octets = np.frombuffer("".join(pieces).encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.zeros(len(octets), bool)
    starts[at[:-1][begins]] = True
    gains = run_segments(machine, octets, starts)
    total = np.concatenate([[0], np.cumsum(gains, dtype=np.int64)])
    ends = at[np.cumsum(chars)]
    froms = np.concatenate([[0], ends[:-1]])
    np.add.at(lengths, owner, ends - froms)
    np.add.at(special, owner, total[ends] - total[froms])
    return lengths, special


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, as the tokenizer's library counts; special strings count as one."""
    spec = df.sparkSession.sparkContext.broadcast(compiled(tokenizer_path))
    key = hash(tokenizer_path)
    source = texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            n_bytes, n_tokens = count_texts(part.column("text").to_pylist(), spec.value, key)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(trimmed(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
