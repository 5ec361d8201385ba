"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes and letter n-grams, both as hashed n-grams of the word between two boundary marks, and
its entry in the lexicon, the words that the training texts hold at least ``TIMES`` times; entries have weights of their own
and share none with the n-grams.  Transitions between labels are learned.  Training sequences are spliced from pieces of
documents of different languages, so that switches inside a text are seen; the likelihood's gradient and the labels of a
text come from forward-backward.  A document's language is the one with the largest mean posterior over its words.

The fit uses at most about ``DOCS`` documents for each language, those of smallest hash, and ``PIECES`` pieces of ``PIECE`` words
from all over each of them; every word of every text is labelled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .quality import held_out

#: Bounds of the training sample: documents for each language, pieces of each of them and words of a piece.
DOCS, PIECES, PIECE = 400, 8, 40
#: How often the training texts hold a word of the lexicon.
TIMES = 3
BUCKETS = 1 << 16
STEPS = 240
BATCH = 64
LENGTH = 40
#: Distinct words in a task's cache of emissions; a full one falls back to those met first, which are the frequent ones.
CACHE, KEEP = 250_000, 120_000
UNKNOWN = "und"
#: Bytes of text whose words are labelled at once.
CHUNK = 3 << 20

_MIXED = textkit._GRAM


def lowered(words: list[bytes]) -> list[str]:
    return b"\n".join(words).decode("utf-8", "replace").lower().split("\n") if words else []


def word_features(words: list[bytes], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first feature of each word and their number, which words have a letter).

    Every word without its letters' case has one lexicon feature: its entry, or that of all unknown words.
    """
    low = lowered(words)
    text = "\n" + "\n".join(low) + "\n"
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = cp == 10
    word_of = np.cumsum(mark) - 1  # a mark belongs to the word after it
    letter = _letters()[cp.astype(np.int64)]
    has = np.bincount(word_of[letter], minlength=len(words) + 1)[: len(words)] > 0
    code = np.where(letter | mark, cp, 46) + np.uint64(1)
    ids, owner = [], []
    for n in (2, 3, 4):
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h += code[j : j + m] * _MIXED[j + 8 * n]
        ok = np.ones(m, bool)  # marks may only be the first or the last character
        for j in range(1, n - 1):
            ok &= ~mark[j : j + m]
        if n == 2:
            ok &= ~(mark[:m] & mark[1 : 1 + m])
        if n == 4:
            ok &= mark[:m] | mark[n - 1 : n - 1 + m]
        ids.append(textkit.mix(h[ok]) % np.uint64(BUCKETS))
        owner.append(word_of[:m][ok])
    ids.append(np.fromiter((BUCKETS + lexicon.get(w, 0) for w in low), np.uint64, len(low)))
    owner.append(np.arange(len(words)))
    ids, owner = np.concatenate(ids).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1)), has


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass
class Crf:
    """``weights`` has a row for each n-gram bucket, one for unknown words and one for each entry of ``lexicon`` (from 1 on)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, has a letter) of the words; a word without letters scores nothing."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32), np.zeros(0, bool)
        ids, first, has = word_features(words, self.lexicon)
        e = np.add.reduceat(self.weights[ids], first[:-1], axis=0)
        e[~has] = 0
        return e, has


def _packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows by falling count, rows active at each step, first packed place of each step)."""
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max(initial=0))
    active = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), "right")
    return order, active, np.append(0, np.cumsum(active))


def posteriors(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward for rows of words: the label probabilities of each word, given all of its row."""
    counts = np.diff(first)
    order, active, at = _packed(counts)
    step = np.arange(len(e)) - np.repeat(first[:-1], counts)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = at[step] + np.repeat(rank, counts)
    p = np.empty_like(e)
    p[place] = np.exp(e - e.max(axis=1, keepdims=True, initial=-np.inf))
    a = np.exp(moves - moves.max()).astype(e.dtype)
    alpha = p.copy()
    for t in range(len(active)):
        x = alpha[at[t] : at[t + 1]]
        if t:
            x *= alpha[at[t - 1] : at[t - 1] + active[t]] @ a
        x /= x.sum(axis=1, keepdims=True)
    beta = np.ones((len(order), e.shape[1]), e.dtype)
    back = a.T.copy()
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        lo = at[t]
        b = beta[:n]
        x = alpha[lo : lo + n]
        x *= b
        x /= x.sum(axis=1, keepdims=True)
        b *= p[lo : lo + n]
        b = b @ back
        b /= b.sum(axis=1, keepdims=True)
        beta[:n] = b
    return alpha[place]


def fit(texts: list[str], langs: list[str], seed: int = 42) -> Crf:
    """Fit on labelled texts; no text leaves a model without labels."""
    labels = sorted(set(langs))
    k = len(labels)
    split = [t.encode("utf-8", "replace").split() for t in texts]
    words = sorted({w for s in split for w in s})
    times = Counter(w for s in split for w in lowered(s))
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in times.items() if n >= TIMES), 1)}
    model = Crf(labels, np.zeros((BUCKETS + 1 + len(lexicon), k), np.float32), np.zeros((k, k), np.float32), lexicon)
    if not words or k < 2:
        return model
    number = {w: i for i, w in enumerate(words)}
    ids, first, has = word_features(words, lexicon)
    size = np.diff(first)
    by = [[[number[w] for w in s] for s, y in zip(split, langs, strict=True) if y == lab and s] for lab in labels]
    usable = [j for j in range(k) if by[j]]
    rng = np.random.Generator(np.random.PCG64(seed))
    gw, gm = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)
    for _ in range(STEPS):
        seq, lab = np.zeros((BATCH, LENGTH), np.int64), np.zeros((BATCH, LENGTH), np.int64)
        for r in range(BATCH):
            at = 0
            while at < LENGTH:
                j = usable[rng.integers(len(usable))]
                doc = by[j][rng.integers(len(by[j]))]
                n = int(min(LENGTH - at, rng.integers(4, LENGTH), len(doc)))
                s = int(rng.integers(0, len(doc) - n + 1))
                seq[r, at : at + n], lab[r, at : at + n] = doc[s : s + n], j
                at += n
        flat = seq.ravel()
        n = size[flat]
        which = np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        feats = ids[which]
        row = np.repeat(np.arange(len(flat)), n)
        e = np.stack([np.bincount(row, model.weights[feats, c], len(flat)) for c in range(k)], axis=1)
        e[~has[flat]] = 0
        e = e.reshape(BATCH, LENGTH, k)
        p = np.exp(e - e.max(axis=2, keepdims=True))
        a = np.exp(model.moves - model.moves.max()).astype(float)
        alpha, beta = p.copy(), np.ones_like(p)
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, LENGTH):
            alpha[:, t] *= alpha[:, t - 1] @ a
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        moved = np.zeros((k, k))
        for t in range(LENGTH - 1, 0, -1):
            b = beta[:, t] * p[:, t]
            joint = alpha[:, t - 1][:, :, None] * a[None] * b[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            moved += joint.sum(0)
            b = b @ a.T
            beta[:, t - 1] = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        g = -post.reshape(-1, k)
        g[np.arange(len(flat)), lab.ravel()] += 1
        g[~has[flat]] = 0
        seen, inverse = np.unique(feats, return_inverse=True)
        gf = np.stack([np.bincount(inverse, g[row, c], len(seen)) for c in range(k)], axis=1) / BATCH - 1e-4 * model.weights[seen]
        gw[seen] += gf * gf
        model.weights[seen] += (0.1 * gf / np.sqrt(gw[seen])).astype(np.float32)
        real = np.zeros((k, k))
        np.add.at(real, (lab[:, :-1].ravel(), lab[:, 1:].ravel()), 1)
        gt = (real - moved) / BATCH
        gm += gt * gt
        model.moves += (0.1 * gt / np.sqrt(gm)).astype(np.float32)
    return model


class Labeller:
    """A model with the cache of its words' emissions."""

    def __init__(self, model: Crf):
        self.model = model
        self.number: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)
        self.has = np.zeros(0, bool)

    def learn(self, words: set[bytes]) -> None:
        if len(self.number) > CACHE:
            self.number = dict(islice(self.number.items(), KEEP))
            self.scores, self.has = self.scores[:KEEP].copy(), self.has[:KEEP].copy()
        new = list(words.difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            found = [self.model.emissions(new[a : a + 50_000]) for a in range(0, len(new), 50_000)]
            self.scores = np.concatenate([self.scores, *(f[0] for f in found)])
            self.has = np.concatenate([self.has, *(f[1] for f in found)])

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors of all words, first word of each text and their number, which words have a letter)."""
        cut = [t.split() for t in texts]
        self.learn(set().union(*cut))
        first = np.append(0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))
        number = np.fromiter((n for s in cut for n in map(self.number.__getitem__, s)), np.int64, int(first[-1]))
        return posteriors(self.scores[number], first, self.model.moves), first, self.has[number]


def _texts(col: pa.Array) -> Iterator[list[bytes]]:
    """The column's texts in groups of about ``CHUNK`` bytes; null counts as empty."""
    held, size = [], 0
    for x in col.cast(pa.large_binary()):
        held.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _predict(model: Crf):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(model)
        for b in batches:
            done = 0
            for texts in _texts(b.column(1)):
                n = len(texts)
                if model.labels:
                    post, first, has = lab.label(texts)
                    row = np.repeat(np.arange(n), np.diff(first))[has]
                    mean = np.stack([np.bincount(row, post[has, c], n) for c in range(len(model.labels))], axis=1)
                    count = np.bincount(row, minlength=n)
                    mean = mean / np.maximum(count, 1)[:, None]
                    best = mean.argmax(axis=1)
                    pred = [model.labels[j] if c else UNKNOWN for j, c in zip(best.tolist(), count.tolist(), strict=True)]
                    score = np.where(count > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)
                else:
                    pred, score = [UNKNOWN] * n, np.zeros(n)
                yield pa.record_batch([b.column(0).slice(done, n), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
                done += n

    return run


def train(docs: DataFrame, folds: int = 3, fold: int = 1, per_language: int = DOCS) -> Crf:
    """Fit on the bounded sample: rows with a language, outside the held-out fold, of smallest hash in their language."""
    known = docs.where("lang is not null and text is not null").where(~held_out("doc_id", folds, fold)).withColumn("h", F.xxhash64("doc_id", F.lit(2)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    picked = known.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.element_at(share, F.col("lang")))
    rows = picked.select("h", "doc_id", "lang", pieces("text", "h").alias("pieces")).orderBy("h", "doc_id").limit(2 * per_language * len(counts)).collect()
    return fit([p for r in rows for p in r["pieces"]], [r["lang"] for r in rows for _ in r["pieces"]])


def pieces(text: str, h: str) -> Column:
    """``PIECES`` pieces of ``PIECE`` words, one from each of as many equal parts of a text; a text of no more words whole."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        part = F.size(w) / PIECES
        start = lambda i: F.floor(i * part + F.pmod(F.xxhash64(F.col(h), i), F.lit(1024)) / 1024 * (part - PIECE)).cast("int") + 1
        some = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.array_join(F.slice(w, start(i), PIECE), " "))
        return F.when(F.size(w) > PIECES * PIECE, some).otherwise(F.array(F.array_join(w, " ")))

    return F.element_at(F.transform(F.array(words), cut), 1)


def language_id(docs: DataFrame, model: Crf | None = None, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0.  Rows with a null language, text or id are not learned
    from; a null id is never held out.  Repeated rows are labelled alike, texts of any length whole; of equally probable
    languages the first in order is taken.  Without any language to learn all rows are ``und``.  An empty table gives an
    empty result; extra columns are ignored.
    """
    model = model or train(docs, folds, fold)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id and, for each white-space word of the text, its most probable label (``und`` without a letter)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(model)
        for b in batches:
            done = 0
            for texts in _texts(b.column(1)):
                post, first, has = lab.label(texts)
                names = np.where(has, np.array([*model.labels, UNKNOWN], object)[post.argmax(axis=1)] if len(post) else np.zeros(0, object), UNKNOWN)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(names.tolist(), pa.string()))
                yield pa.record_batch([b.column(0).slice(done, len(texts)), lists], names=["doc_id", "labels"])
                done += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, labels array<string>")


def _known(model: Crf, text: int):
    """Whole rows; ``text`` is the place of the text's column."""
    predict = _predict(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.record_batch([pa.nulls(b.num_rows, pa.int64()), b.column(text)], names=["doc_id", "text"])
            out = pa.Table.from_batches(list(predict([rows])))
            known = pc.not_equal(out["lang_pred"], UNKNOWN).combine_chunks() if b.num_rows else pa.array([], pa.bool_())
            yield b.filter(known)

    return run


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is unknown (null, empty or without a letter); all columns stay, whatever their names.

    No row moves; rows that repeat an id or lack one are judged each by its own text, of any length.  An empty table gives an
    empty result; where no language can be learned every row goes.
    """
    return docs.mapInArrow(_known(train(docs), docs.columns.index("text")), docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
