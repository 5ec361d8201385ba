"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; each feature owns a lookup table over its bins and each chosen pair of features one over its
bin grid.  Boosting visits the features in turn and adds a shallow tree (at most four leaves) of the current gradients to
the feature's table; the pairs with the largest gain on the remaining gradients are then boosted the same way with trees of
one cut on each side.  A score is the logistic of the bins' sum, so scoring is array lookups and additions only.

The fit uses at most ``MAX_ROWS`` labelled rows, those of smallest hash; features and scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .store import Store

#: Bound of the labelled sample that the model is fitted on.
MAX_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
THRESHOLD = 0.7

FEATURES = (
    "words", "chars", "word_length", "upper", "digits", "marks", "odd_marks", "shouts", "distinct_words", "line_words",
    "distinct_lines", "longest_word", "short_words", "distinct_grams", "upper_words", "high_bytes", "marked_words", "common_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_MARK = np.zeros(256, bool)
_MARK[33:128] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT)
_ODD = _MARK.copy()
_ODD[[ord(c) for c in ".,;:!?'\"()-"]] = False
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?")]] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[off])


def _distinct(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, largest count of one value) for each of ``n`` rows; ``rows`` ascends."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, rows[at], np.diff(np.append(at, len(h))))
    return np.bincount(rows[at], minlength=n), top


def features(col: pa.Array) -> np.ndarray:
    """Rows x features of a text column; null counts as empty."""
    data, off = textkit.buffers(col)
    out = []
    for a, b in textkit.chunks(off):
        x, o, n = data[off[a] : off[b]], off[a : b + 1] - off[a], b - a
        s, e, first = textkit.spans(x, o)
        h, _ = textkit.word_hashes(x, o)
        words, chars = np.diff(first), np.diff(o)
        row = np.repeat(np.arange(n), words)
        w1, c1 = np.maximum(words, 1), np.maximum(chars, 1)
        upper, lower = _UPPER[x], _LOWER[x]
        up, lo, high = _sums(upper, o), _sums(lower, o), _sums(_HIGH[x], o)
        letters = np.maximum(up + lo + high, 1)
        length = e - s
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, row, length)
        kinds, top = _distinct(h, row, n)
        g = textkit.grams(h, 3)
        grow = row[: len(g)]
        inside = grow == row[2:] if len(g) else np.zeros(0, bool)
        gkinds, _ = _distinct(g[inside], grow[inside], n)
        lines_at = np.flatnonzero(x == 10)
        line_of = np.searchsorted(lines_at, s) + 0
        key = np.append(True, (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])) if len(s) else np.zeros(0, bool)
        heads = np.flatnonzero(key)
        lines = np.bincount(row[heads], minlength=n)
        place = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h)))) if len(h) else np.zeros(0, int)
        lh = np.add.reduceat(textkit.mix(h + place.astype(np.uint64) * textkit.U(0x9E3779B97F4A7C15)), heads) if len(heads) else h
        lkinds, _ = _distinct(lh, row[heads], n)
        acc_up = np.append(0, np.cumsum(upper))
        acc_mark = np.append(0, np.cumsum(_ODD[x] | _SHOUT[x]))
        shouted = np.bincount(row[(acc_up[e] - acc_up[s] >= length - 2) & (length > 3) & (acc_up[e] - acc_up[s] > 1)], minlength=n)
        marked = np.bincount(row[acc_mark[e] > acc_mark[s]], minlength=n)
        short = np.bincount(row[length <= 2], minlength=n)
        l1 = np.maximum(lines, 1)
        out.append(np.stack([
            np.log1p(words), np.log1p(chars), chars / w1, up / letters, _sums(_DIGIT[x], o) / c1, _sums(_MARK[x], o) / c1, _sums(_ODD[x], o) / c1,
            _sums(_SHOUT[x], o) / w1, kinds / w1, words / l1, lkinds / l1, np.log1p(longest), short / w1,
            gkinds / np.maximum(words - 2, 1), shouted / w1, high / c1, marked / w1, top / w1,
        ], axis=1))
    return np.concatenate(out or [np.zeros((0, len(FEATURES)))])


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            z += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            z += t[bins[:, i], bins[:, j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best (gain, bin) of one cut of the bins lo..hi."""
    a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    if not len(a):
        return 0.0, lo
    ga, hb = g[lo:hi].sum(), h[lo:hi].sum()
    gain = a * a / (b + 1) + (ga - a) ** 2 / (hb - b + 1) - ga * ga / (hb + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a shallow tree over the bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max((*_cut(g, h, lo, hi), k) for k, (lo, hi) in enumerate(parts))
        if gain <= 1e-9:
            break
        lo, hi = parts[k]
        parts[k : k + 1] = [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of the best tree with one cut on each side of a bin grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gs = [cg, cg[:, -1:] - cg, cg[-1:, :] - cg, cg[-1, -1] - cg[:, -1:] - cg[-1:, :] + cg]
    hs = [ch, ch[:, -1:] - ch, ch[-1:, :] - ch, ch[-1, -1] - ch[:, -1:] - ch[-1:, :] + ch]
    gain = sum(a * a / (b + 1) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    v = [a[i, j] / (b[i, j] + 1) for a, b in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit on features and 0/1 labels; one class alone gives its smoothed rate, no rows one half."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(base=float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = model.bins(x)
    width = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(w) for w in width]
    z = np.full(len(y), model.base)

    def step() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, w in enumerate(width):
            g, h = step()
            t = RATE * _tree(np.bincount(bins[:, j], g, w), np.bincount(bins[:, j], h, w))
            model.tables[j] += t
            z += t[bins[:, j]]
    g, h = step()
    grid = {}
    for i in range(len(width)):
        for j in range(i + 1, len(width)):
            cell = bins[:, i] * width[j] + bins[:, j]
            sums = [np.bincount(cell, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (g, h)]
            grid[i, j] = _quadrants(*sums)[0]
    for pair in sorted(grid, key=lambda p: (-grid[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros((width[pair[0]], width[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            g, h = step()
            cell = bins[:, i] * width[j] + bins[:, j]
            t = RATE * _quadrants(*[np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h)])[1]
            table += t
            z += t.ravel()[cell]
    return model


def _featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.record_batch([b.column(0), lists], names=["doc_id", "x"])


def _scored(model: Gam):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def held_out(doc_id, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The model is fitted on labelled rows outside the held-out fold; rows with a null id, a null label or a label other than
    0 and 1 are not learned from, and are scored like any other; repeated labels count once, contradicting ones both.  Null
    texts score as empty ones, texts of any length are read whole.  Repeated rows score alike.  Without labels every score is
    one half.  An empty table gives an empty result; extra columns are ignored.
    """
    store = Store(docs.sparkSession, "quality")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    x = store.save(own.mapInArrow(_featurise, "doc_id long, x array<double>"), "features")
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").where(~held_out("doc_id", folds, fold)).distinct()
    # the hash cut comes first, so that no task sends more than its share to the driver
    share = min(1.0, 1.5 * max_rows / max(known.count(), 1))
    known = known.where(F.xxhash64("doc_id", F.lit(1)).cast("double") / 2.0**64 + 0.5 <= share)
    sample = x.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_rows).select("x", "quality").toPandas()
    model = fit(np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES)), sample["quality"].to_numpy(float))
    scored = x.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
