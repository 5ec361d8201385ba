"""Byte-level BPE by vectorised pre-tokenisation, cached pair merging, and decoding by retained offsets.

Pre-tokenisation uses no regular expression.  Code points become classes by a table; what the pattern looks ahead for
(whether white space is followed by more of it, which letters follow an apostrophe) is folded into the class of the
character itself.  What remains is a machine of seven states.  A character is then a function from states to states; the
functions of each block are composed side by side for all blocks, block functions are combined by a doubling scan, and a
second pass, again over all blocks at once, marks where tokens start.  Each row begins with a reset.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

# Classes: letter, number, blank (U+0020 before a non-space), other white space, other characters, and apostrophes that
# open a two or a three character contraction where a token may start.
L, N, SP, WS, O, A2, A3 = range(7)
# States: a token starts next; in letters, numbers or others; after a leading blank; one or two letters of a contraction left.
S0, SL, SN, SO, SB, C1, C2 = range(7)
RESET, WIDTH = 8, 8
BLOCK = 64
#: Slices in a worker's cache of merged pieces; a full one falls back to those met first, which are the frequent ones.
CACHE, KEEP = 400_000, 150_000


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here) for symbol * WIDTH + state; symbol + RESET is a row's first character."""
    step, start = np.zeros((2 * RESET, WIDTH), np.uint8), np.zeros((2 * RESET, WIDTH), bool)
    run = {L: SL, N: SN, O: SO, A2: SO, A3: SO}
    for c in range(7):
        for s in range(7):
            if c == SP:
                to, new = SB, True
            elif c == WS:
                to, new = S0, True  # starts of white space are marked apart
            elif c == L and s in (C1, C2):
                to, new = (S0 if s == C1 else C1), False
            elif run[c] == s:
                to, new = s, False
            elif s == SB:
                to, new = run[c], False
            else:
                to, new = (C1 if c == A2 else C2 if c == A3 else run[c]), True
            step[c, s], start[c, s] = to, new
        step[c + RESET, :], start[c + RESET, :] = step[c, S0], True
    return step.ravel(), start.ravel()


_STEP, _START = _machine()


@lru_cache(1)
def _class_table() -> np.ndarray:
    """The class of every code point, in the Unicode version of the tiktoken library, whose tables differ from Python's.

    An encoding of single bytes whose pattern is one class drops all else, so that what comes back is the class.
    """
    import tiktoken

    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, O, np.uint8)
    for pattern, kind in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", WS)):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(own.encode_ordinary(text)).decode("utf-8").encode("utf-32-le"), np.uint32)] = kind
    return table


def token_starts(cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indexes of the code points that start a token; ``rows`` are the row offsets in code points."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _class_table()[cp]
    heads = rows[:-1][np.diff(rows) > 0]
    lasts = rows[1:][np.diff(rows) > 0] - 1
    ahead = np.zeros((2, n), np.uint32)  # the next two code points of the row, 0 beyond its end
    ahead[0, :-1] = cp[1:]
    ahead[1, :-2] = cp[2:]
    ahead[0, lasts] = 0
    ahead[1, lasts] = 0
    ahead[1, np.maximum(lasts - 1, 0)] = 0
    white = kind == WS
    more = np.zeros(n, bool)  # white space that more white space follows, or nothing
    more[:-1] = white[1:]
    more[lasts] = True
    kind[(cp == 32) & ~more] = SP
    quote = np.flatnonzero(cp == 39)
    a, b = ahead[0, quote], ahead[1, quote]
    two = np.isin(a, [ord(c) for c in "stmd"])
    three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    kind[quote[two]] = A2
    kind[quote[three]] = A3
    symbol = kind.copy()
    symbol[heads] += RESET
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint16)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * WIDTH
    f = np.broadcast_to(np.arange(WIDTH, dtype=np.uint8), (blocks, WIDTH)).copy()
    for j in range(BLOCK):
        f = _STEP[grid[j][:, None] + f]
    reach = 1
    while reach < blocks:  # f[i] becomes the composition of all blocks up to i
        f[reach:] = np.take_along_axis(f[reach:], f[:-reach].astype(np.int64), axis=1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = f[:-1, S0]
    new = np.zeros((BLOCK, blocks), bool)
    for j in range(BLOCK):
        at = grid[j] + state
        new[j] = _START[at]
        state = _STEP[at]
    new = np.ascontiguousarray(new.T).ravel()[:n]
    # a run of white space is one token, but for its last character where something follows
    inner = np.zeros(n, bool)
    inner[1:] = white[1:] & white[:-1] & more[1:]
    inner[heads] = False
    return np.flatnonzero(new & ~inner)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, pairs: dict[int, int], first: list[int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank first, the leftmost of equals, by a heap of pairs and a linked list."""
    ids, n = [first[c] for c in piece], len(piece)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j >= n or ids[i] != a or ids[j] != b:
            continue  # a part has merged since
        ids[i], ids[j], right[i] = rank, -1, right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (r := pairs.get(ids[x] << 32 | ids[y])) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


class Merger:
    """Pair merging of many slices side by side.

    ``keys`` are all pairs of tokens whose joined bytes are a token, sorted, and ``values`` their ranks.  A round finds for
    each slice its pair of lowest rank, the leftmost of equals, merges it in all slices and closes the gaps; slices without
    such a pair are done.  Slices above ``LONG`` bytes go through the heap, in n log n.
    """

    LONG = 48
    ROWS = 1 << 18

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.first = [ranks[bytes([i])] for i in range(256)]
        # most adjacent tokens are no pair; a table of hashes answers for these without a search
        self.mask = (1 << 22) - 1
        self.maybe = np.zeros(self.mask + 1, bool)
        self.maybe[self._hash(self.keys)] = True

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> 29)) * 0x9E3779B1 >> 7) & self.mask

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        out = np.full(len(key), 1 << 40, np.int64)
        some = np.flatnonzero(self.maybe[self._hash(key)])
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        real = self.keys[at] == key[some]
        out[some[real]] = self.values[at[real]]
        return out

    def merged(self, slices: list[bytes]) -> list[np.ndarray]:
        """Ids of each slice."""
        out: list[np.ndarray | None] = [None] * len(slices)
        short = [i for i, s in enumerate(slices) if len(s) <= self.LONG]
        for i, s in enumerate(slices):
            if len(s) > self.LONG:
                out[i] = np.array(merge(s, self.pairs, self.first), np.int64)
        first = np.array(self.first, np.int64)
        for c in range(0, len(short), self.ROWS // 8):
            own = short[c : c + self.ROWS // 8]
            n = np.array([len(slices[i]) for i in own])
            ids = first[np.frombuffer(b"".join([slices[i] for i in own]), np.uint8)]
            row = np.repeat(np.arange(len(own)), n)
            while len(ids):
                rank = np.full(len(ids), 1 << 40, np.int64)
                rank[:-1] = self._ranks(ids[:-1], ids[1:])
                rank[:-1][row[1:] != row[:-1]] = 1 << 40
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                size = np.diff(np.append(heads, len(ids)))
                least = np.minimum.reduceat(rank, heads)
                best = rank == np.repeat(least, size)
                done = least == 1 << 40
                for h, m in zip(heads[done].tolist(), size[done].tolist(), strict=True):
                    out[own[row[h]]] = ids[h : h + m]
                live = ~np.repeat(done, size)
                best &= live
                at = np.flatnonzero(best)
                at = at[np.append(True, row[at[1:]] != row[at[:-1]])] if len(at) else at  # the leftmost of a slice
                ids[at] = rank[at]
                live[at + 1] = False
                ids, row = ids[live], row[live]
        return out


class Codec:
    """Encoder and decoder of one vocabulary, with the cache of its merged slices."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.merger = Merger(self.ranks)
        self.ids: dict[bytes, bytes] = {}
        self.text: dict[bytes, bytes] = {}
        size = max(self.ranks.values(), default=0) + 1
        lens = np.zeros(size + 1, np.int64)
        for token, rank in self.ranks.items():
            lens[rank + 1] = len(token)
        self.at = np.cumsum(lens)
        self.len = lens[1:]
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)

    def slices(self, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(token slices, first slice of each row, byte offset of each slice)."""
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(cp) == len(data):
            s = token_starts(cp, off)
        else:
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            s = at[token_starts(cp, np.searchsorted(at, off))]
        ends = np.append(s, len(data))[1:]
        return [raw[a:b] for a, b in zip(s.tolist(), ends.tolist(), strict=True)], np.searchsorted(s, off), s

    def learn(self, tokens: list[bytes]) -> None:
        """Merge the slices that the cache has not."""
        distinct = set(tokens)
        if len(self.ids) > CACHE:
            self.ids, self.text = (dict(islice(d.items(), KEEP)) for d in (self.ids, self.text))
        new = list(distinct.difference(self.ids))
        for t, ids in zip(new, self.merger.merged(new), strict=True):
            self.ids[t] = ids.astype("<u4").tobytes()
            self.text[t] = b"".join([b"%d," % i for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, by their places in the table of all tokens' bytes."""
        n = self.len[ids]
        end = np.cumsum(n)
        return self.bytes[np.repeat(self.at[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        tokens, _, _ = self.slices(data, np.array([0, len(data)]))
        self.learn(tokens)
        return np.frombuffer(b"".join([self.ids[t] for t in tokens]), "<u4").tolist()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data, off = textkit.buffers(b.column(1))
            for lo, hi in textkit.chunks(off):
                part, rows = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                tokens, first, at = c.slices(part, rows)
                c.learn(tokens)
                raw = [c.ids[t] for t in tokens]
                count = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                end = np.append(0, np.cumsum(count))
                ends = np.repeat(at - np.repeat(rows[:-1], np.diff(first)), count) + _inner(c, ids, count)
                lists = [pa.ListArray.from_arrays(pa.array(end[first].astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), *lists], names=["doc_id", "ids", "ends"])

    return run


def _inner(c: Codec, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Byte offset of each id's end within its slice."""
    end = np.cumsum(c.len[ids])
    head = np.cumsum(count) - count
    return end - np.repeat((end - c.len[ids])[head] if len(ids) else head, count)


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, ends (byte offset in the text where each id ends) of every row; null text counts as empty."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_encode(path), "doc_id long, ids array<int>, ends array<int>")


def _decode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [c.decode(np.asarray(x.values, np.int64)).tobytes() if x.is_valid else b"" for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return run


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, bytes binary")


def _digests(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data, off = textkit.buffers(b.column(1))
            n, sha, back = [], [], []
            for lo, hi in textkit.chunks(off):
                tokens, first, _ = c.slices(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                c.learn(tokens)
                for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = tokens[a:z]
                    ids = np.frombuffer(b"".join(map(c.ids.__getitem__, own)), "<u4")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(b"".join(map(c.text.__getitem__, own))[:-1]).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids.

    Null text counts as empty: no ids, digests of the empty string.  Rows are independent, so null or repeated ids and
    repeated rows need no rule; an empty table gives an empty result and extra columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
