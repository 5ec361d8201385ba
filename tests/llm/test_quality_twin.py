"""Features, bins and sums of the quality model against plain Python."""

import bisect
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkengine.llm import quality

ODD_TEXTS = [
    None, "", " \n\t ", "x", "One two three. One two three.\nOne two three.", "WOW!!! BUY NOW $$$ <b>x</b>\n\nWOW!!! BUY NOW", "é漢字🙂 été Ünï 12,5 %",
    "a b a b a b a b", "line\r\nline\nline \n line", "ABC ABCD ABc aBCD XY", "trailing line\n", "\n\nleading",
]


def plain(text):
    raw = (text or "").encode()
    words = raw.split()
    lines = [tuple(x.split()) for x in raw.split(b"\n") if x.split()]
    n, chars = len(words), len(raw)
    w1, c1 = max(n, 1), max(chars, 1)
    up, lo, high = (sum(f(c) for c in raw) for f in (lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: c >= 128))
    digit, mark = sum(48 <= c <= 57 for c in raw), [c for c in raw if 33 <= c < 128 and not chr(c).isalnum()]
    odd = [c for c in mark if chr(c) not in ".,;:!?'\"()-"]
    shout = [c for c in raw if chr(c) in "!?"]
    ups = [sum(65 <= c <= 90 for c in w) for w in words]
    shouted = sum(u >= len(w) - 2 and len(w) > 3 and u > 1 for u, w in zip(ups, words, strict=True))
    marked = sum(any(c in odd or c in shout for c in w) for w in words)
    grams = {tuple(words[i : i + 3]) for i in range(n - 2)}
    top = max(Counter(words).values(), default=0)
    l1 = max(len(lines), 1)
    return [
        math.log1p(n), math.log1p(chars), chars / w1, up / max(up + lo + high, 1), digit / c1, len(mark) / c1, len(odd) / c1, len(shout) / w1, len(set(words)) / w1,
        n / l1, len(set(lines)) / l1, math.log1p(max(map(len, words), default=0)), sum(len(w) <= 2 for w in words) / w1, len(grams) / max(n - 2, 1), shouted / w1, high / c1, marked / w1, top / w1,
    ]


def texts():
    rng = random.Random(4)
    pieces = ["the", "The", "LOUD", "x", "a1", "né", "漢", "!", "$%", "word,", "\n", "\n\n", "\t", "  ", "12", "same same"]
    return ODD_TEXTS + ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_features_equal_plain_ones():
    rows = texts()
    got = quality.features(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        assert got[i] == pytest.approx(plain(t), abs=1e-9), (t, dict(zip(quality.FEATURES, zip(got[i], plain(t), strict=True), strict=True)))


def test_a_very_long_text():
    long = "some words and 12 more.\n" * 150_000
    assert quality.features(pa.array([long, "x"]))[0] == pytest.approx(plain(long), abs=1e-9)


def test_scores_equal_plain_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1.5)).astype(float)
    model = quality.fit(x, y)
    got = model.score(x)
    for row, s in zip(x, got, strict=True):
        at = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, row.tolist(), strict=True)]
        z = model.base + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_best_cuts_by_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(50):
        g, h = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, size=(4, 5))
        best = max(
            sum(g[a, b].sum() ** 2 / (h[a, b].sum() + 1) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5)))
            for i in range(1, 5) for j in range(1, 6)
        )
        assert quality._quadrants(g, h)[0] == pytest.approx(best)
        gain, at = quality._cut(g[0], h[0], 0, 5)
        cuts = [g[0, :k].sum() ** 2 / (h[0, :k].sum() + 1) + g[0, k:].sum() ** 2 / (h[0, k:].sum() + 1) - g[0].sum() ** 2 / (h[0].sum() + 1) for k in range(1, 5)]
        assert gain == pytest.approx(max(cuts)) and cuts[at - 1] == pytest.approx(gain)


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, f"good prose number {i} here" if i % 2 else f"BAD!!! {i} $$$") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, labels.unionByName(labels.where("doc_id < 9"))).collect()}
    assert once == pytest.approx(again)
