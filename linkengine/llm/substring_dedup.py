"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  ``COVER`` is a difference cover modulo ``PERIOD``: for any two starts i and j
there is a shift k < PERIOD with (i + k) mod PERIOD and (j + k) mod PERIOD both in the cover.  So two equal windows share an
aligned anchor, the ``ANCHOR`` = WINDOW - PERIOD + 1 words at the same shift, and only the anchors at cover positions (3 of 7)
are hashed and shuffled.  Anchors that occur in two documents are extended: the windows around them, and no others, are
hashed whole, and each looks for its smallest document.

Both meetings use one exchange.  A task first meets its own rows: it answers for what it sees together and sends each
distinct hash on once, with its smallest document.  A passage that a third of all documents hold therefore sends a row per
batch, not a row per document.  Rows of the exchange are packed: one for each task's batch and hash range, and one for each
range and document bucket on the way back.  Anchors travel as 32 bits beside their range, whose number grows with the
partitions; a chance meeting only adds a candidate window, and windows meet by all 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .store import Store, partitions

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Answers that a task holds before they leave.
FLUSH = 2_000_000

_COVERED = np.isin(np.arange(PERIOD), COVER)
_PACKED = "bucket int, answer boolean, hashes binary, docs binary"
U = np.uint64


def _word_batch(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and the first word of each row (one more for the end)."""
    data, off = textkit.buffers(col)
    hashes, firsts, base = [], [np.zeros(1, np.int64)], 0
    for a, b in textkit.chunks(off):
        h, first = textkit.word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        hashes.append(h)
        firsts.append(base + first[1:])
        base += len(h)
    return np.concatenate(hashes or [np.zeros(0, U)]), np.concatenate(firsts)


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its place in its row, and the words left from it on."""
    n = np.diff(first)
    at = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return at, np.repeat(n, n) - at


def _anchor_places(first: np.ndarray, words: int) -> np.ndarray:
    at, left = _places(first)
    ok = _COVERED[at % PERIOD] & (left >= ANCHOR) & (at + left >= WINDOW)
    return np.flatnonzero(ok[: max(0, words - ANCHOR + 1)])


def _meet_local(h: np.ndarray, d: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) pairs -> (hashes and documents answered here, hashes and smallest documents to send on)."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= d[1:] != d[:-1]
    h, d, new_h = h[new], d[new], new_h[new]
    if later:
        hit = ~new_h
    else:
        size = np.diff(np.append(np.flatnonzero(new_h), len(h)))
        hit = np.repeat(size > 1, size)
    return h[hit], d[hit], h[new_h], d[new_h]


def _pack(key: np.ndarray, h: np.ndarray, d: np.ndarray, answer: bool) -> pa.RecordBatch:
    """One row per key; within it documents ascend and are kept as differences in as few bytes as they need."""
    order = np.lexsort((d, key))
    key, h, d = key[order], h[order], d[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    hashes, docs = [], []
    for i, j in zip(at.tolist(), np.append(at, len(key))[1:].tolist(), strict=True):
        step = np.diff(d[i:j]).astype(U)
        size = next(k for k in (1, 2, 4, 8) if int(step.max(initial=0)) < 1 << 8 * k)
        hashes.append(h[i:j].tobytes())
        docs.append(d[i].tobytes() + bytes([size]) + step.astype(f"<u{size}").tobytes())
    return pa.record_batch([pa.array(key[at].astype(np.int32)), pa.array(np.full(len(at), answer)), pa.array(hashes, pa.binary()), pa.array(docs, pa.binary())], names=["bucket", "answer", "hashes", "docs"])


def _unpack(docs: bytes) -> np.ndarray:
    step = np.frombuffer(docs, f"<u{docs[8]}", offset=9).astype(np.int64)
    return np.cumsum(np.append(np.frombuffer(docs, np.int64, 1), step))


def _narrow(h: np.ndarray) -> np.ndarray:
    return (h & U(0xFFFFFFFF)).astype(np.uint32)


def _doc_bucket(d: np.ndarray, buckets: int) -> np.ndarray:
    return (textkit.mix(d.astype(U)) >> U(32)).astype(np.int64) % buckets


def _send(h: np.ndarray, d: np.ndarray, buckets: int, later: bool) -> Iterator[pa.RecordBatch]:
    """What a batch answers itself, by document, and what it sends on, by the range of the hash."""
    hh, hd, sh, sd = _meet_local(h, d, later)
    cut = (lambda x: x) if later else _narrow
    yield _pack(_doc_bucket(hd, buckets), cut(hh), hd, True)
    yield _pack(((sh >> U(32)) * U(buckets) >> U(32)).astype(np.int64), cut(sh), sd, False)


def _anchors(buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, first = _word_batch(b.column(1))
            p = _anchor_places(first, len(words))
            d = np.repeat(b.column(0).to_numpy(), np.diff(first))[p]
            yield from _send(textkit.grams(words, ANCHOR)[p], d, buckets, False)

    return run


def _windows(buckets: int) -> Callable:
    """Windows around shared anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, first = _word_batch(b.column(1))
            p = _anchor_places(first, len(words))
            g = _narrow(textkit.grams(words, ANCHOR)[p])
            at = np.searchsorted(p, first)
            shared = [np.isin(g[at[i] : at[i + 1]], np.frombuffer(x.as_buffer(), np.uint32)) for i, x in enumerate(b.column(2))]
            q = p[np.concatenate(shared or [np.zeros(0, bool)])]
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            lo = np.maximum(q - PERIOD + 1, first[row[q]])
            opened = np.cumsum(np.bincount(lo, minlength=len(words) + 1) - np.bincount(q + 1, minlength=len(words) + 1))[: len(words)]
            w = np.flatnonzero((opened > 0) & (_places(first)[1] >= WINDOW))
            yield from _send(textkit.grams(words, WINDOW)[w], b.column(0).to_numpy()[row[w]], buckets, True)

    return run


def _met(later: bool, buckets: int) -> Callable:
    """Answers, by document bucket, for what met in the exchange; one hash range of the sorted partition is held at a time."""
    kind = U if later else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, last = [], [], None

        def meet() -> None:
            if held:
                h = np.concatenate([np.frombuffer(x, kind) for x, _ in held])
                d = np.concatenate([_unpack(x) for _, x in held])
                held.clear()
                found.append(_meet_local(h, d, later)[:2])

        def answers(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[1]) for x in found) > least:
                d = np.concatenate([x[1] for x in found])
                yield _pack(_doc_bucket(d, buckets), np.concatenate([x[0] for x in found]), d, True)
                found.clear()

        for b in batches:
            own = b.filter(b.column(1))
            if own.num_rows:
                yield own
            sent = b.filter(pc.invert(b.column(1)))
            for bucket, h, d in zip(sent.column(0).to_pylist(), sent.column(2).to_pylist(), sent.column(3).to_pylist(), strict=True):
                if bucket != last:
                    meet()
                    yield from answers(FLUSH)
                    last = bucket
                held.append((h, d))
        meet()
        yield from answers(0)

    return run


def _gather(later: bool) -> Callable:
    """One row per document with its hashes; one document bucket of the sorted partition is held at a time."""
    kind = U if later else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                h = np.concatenate([np.frombuffer(x, kind) for x, _ in held])
                d = np.concatenate([_unpack(x) for _, x in held])
                held.clear()
                order = np.argsort(d, kind="stable")
                h, d = h[order], d[order]
                at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                yield pa.record_batch([pa.array(d[at]), pa.array([h[i:j].tobytes() for i, j in zip(at.tolist(), np.append(at, len(d))[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "hashes"])

        for b in batches:
            for bucket, h, d in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if bucket != last:
                    yield from rows()
                    last = bucket
                held.append((h, d))
        yield from rows()

    return run


def _meet(sent: DataFrame, later: bool, buckets: int) -> DataFrame:
    """Rows (doc_id, hashes): of each document what others share, or what a smaller one has."""
    n = partitions(sent.sparkSession)
    # answers that are ready spread by a number of their own, so that they fill no hash range
    spread = F.when(F.col("answer"), F.xxhash64("docs")).otherwise(F.col("bucket"))
    met = sent.withColumn("spread", spread).repartition(n, "spread").drop("spread").sortWithinPartitions("bucket")
    back = met.mapInArrow(_met(later, buckets), _PACKED).repartition(n, "bucket").sortWithinPartitions("bucket")
    return back.mapInArrow(_gather(later), "doc_id long, hashes binary")


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sha = [], []
        for t in b.column(1).cast(pa.large_binary()):
            words = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "whole"])


def _cut(keep_text: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, first = _word_batch(b.column(1))
            g = textkit.grams(words, WINDOW)
            removed, whole, sha, texts = [], [], [], []
            for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                own = t.as_buffer().to_pybytes().split()
                lo, hi = int(first[i]), int(first[i + 1])
                starts = np.flatnonzero(np.isin(g[lo : max(lo, hi - WINDOW + 1)], np.frombuffer(b.column(2)[i].as_buffer(), U)))
                step = np.zeros(hi - lo + 1, np.int64)
                step[starts] += 1
                step[starts + WINDOW] -= 1
                gone = np.cumsum(step)[:-1] > 0
                kept = b" ".join([w for w, x in zip(own, gone.tolist(), strict=True) if not x])
                removed.append(int(gone.sum()))
                whole.append(hashlib.sha256(b" ".join(own)).hexdigest())
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "replace") if keep_text else None)
            yield pa.record_batch([b.column(0), pa.array(whole, pa.string()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "whole", "n_removed", "sha", "kept_text"])

    return run


def _cuts(docs: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, whole (SHA-256 of all words), n_removed, sha, kept_text of the documents that share a window."""
    store, buckets = Store(docs.sparkSession, "substrings"), partitions(docs.sparkSession)
    known = docs.where("doc_id is not null and text is not null")
    shared = _meet(known.mapInArrow(_anchors(buckets), _PACKED), False, buckets)
    near = store.save(known.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "hashes"), "near")
    gone = _meet(near.mapInArrow(_windows(buckets), _PACKED), True, buckets)
    cuts = near.select("doc_id", "text").join(gone.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "hashes")
    return cuts.mapInArrow(_cut(keep_text), "doc_id long, whole string, n_removed long, sha string, kept_text string").dropDuplicates(["doc_id", "whole"])


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``, with kept_text where any word was removed.

    A word goes when a window that covers it also starts in a document with a smaller id; windows are judged on the
    input.  Null and empty texts have no words, texts of any length are read whole.  Rows with a null id lose nothing and cost
    others nothing.  Rows that repeat an id are one document: they do not remove each other's words.  An empty table gives an
    empty result; extra columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    whole = own.mapInArrow(_whole, "doc_id long, n_words long, whole string")
    return whole.join(_cuts(own, keep_text), ["doc_id", "whole"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"),
        *(["kept_text"] if keep_text else []),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
