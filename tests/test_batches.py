"""Scores and alignments of batches equal the plain ones pair by pair; the features' pass is dealt out to many tasks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkengine.functions import batches, strings
from linkengine.functions import text as tx
from linkengine.operators import features, stats
from tests.test_pipeline import made_up

ODD = ["", "a", "a a", "12 12bis 012", "x" * 64, "x" * 65 + " y", "￿￾ ab", "𝒳𝒴 𝒳", "k01kata", "  ", "ab " * 40, "z" * 600]


def texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aehknost") for _ in range(rng.randint(1, 9)))
    words = [word() for _ in range(60)] + ["corp", "corporation", "pvt", "private", "state", "bank", "of", "india", "sbi", "walmart", "wal", "mart", "trust", "trsut", "12", "12b", "012", "k01kata", "kolkata", "съвет", "совет"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 14]))) for _ in range(n)]


@pytest.fixture(scope="module")
def pairs():
    a, b = texts(900, 1), texts(900, 2)
    b[:300] = [x[: len(x) // 2] + x[len(x) // 2 + 1 :] for x in a[:300]]
    return a + [x for x in ODD for _ in ODD], b + [y for _ in ODD for y in ODD]


def test_scores(pairs):
    names = list(strings.SCORERS)
    got = batches.all_scores(*pairs, names)
    for k, (a, b) in enumerate(zip(*pairs, strict=True)):
        for s, want in zip(names, strings.all_scores(a, b, names), strict=True):
            assert got[s][k] == want or (want is None and np.isnan(got[s][k])), (s, a, b)


def test_alignments_and_figures(pairs):
    x, y = [batches.seen(t) for t in pairs[0]], [batches.seen(t) for t in pairs[1]]
    linked = 0
    for a, b, al in zip(x, y, batches.alignments(x, y), strict=True):
        plain = strings.Alignment(a.tokens, b.tokens)
        assert al.rel == plain.rel and [tuple(p) for p in al.links] == [(p.left, p.right, p.relation) for p in plain.links]
        idf, usual = ([1.0 + len(t) for t in a.tokens], [1.0 + len(t) for t in b.tokens]), ([False] * len(a.tokens), [t == "of" for t in b.tokens])
        assert strings.field_figures(al, idf, usual) == strings.field_features(a.tokens, b.tokens, idf, usual)
        linked += len(al.links)
    assert linked > 1000


def test_bounded_damerau():
    for a, b in zip(texts(400, 3), texts(400, 4), strict=True):
        a, b = a[:7], b[:7]
        for most in (1, 2):
            assert strings.within(a, b, most) == (strings.damerau(a, b) <= most)


def test_overlaps(pairs, spark):
    rows = [p for p in zip(*pairs, strict=True) if "￿" not in p[0] + p[1]]
    kept = {"s_landmark": "", "p_landmark": "", "s_postcodes": "", "p_postcodes": "", "s_name_romanized": False, "p_name_romanized": False, "s_norm_addr": "a", "p_norm_addr": "a"}
    df = spark.createDataFrame(rows, "s_norm_name string, p_norm_name string").withColumns({k: F.lit(v) for k, v in kept.items()})
    own = features.overlaps()
    want = df.select("s_norm_name", "p_norm_name", own["name_tok_jacc"].alias("t"), own["name_c3_jacc"].alias("g")).collect()
    a, b = [r.s_norm_name for r in want], [r.p_norm_name for r in want]
    tok = batches.token_jaccard([batches.seen(t) for t in a], [batches.seen(t) for t in b])
    for r, t, g in zip(want, tok, batches.gram_jaccard(a, b), strict=True):
        assert (r.t, r.g) == tuple(None if np.isnan(v) else v for v in (t, g))


def test_scores_are_worked_out_side_by_side(monkeypatch):
    """No pair is scored or aligned on its own, which took 2 ms of each."""

    def alone(*_):
        raise AssertionError("one pair on its own")

    for name in ("all_scores", "field_features", "partial_ratio", "jaro"):
        monkeypatch.setattr(strings, name, alone)
    fields = {f"{p}{f}": ["red rose hill"] * 3 for f, _ in features.SCORES for p in ("s_", "p_")}
    fields["p_norm_name"] = fields["p_fold_name"] = ["rose hill rd", "green house", ""]
    weights = {f"{p}{f}_{w}": [[v] * len(t.split()) for t in fields[p + f]] for f in features.FIELDS.values() for p in ("s_", "p_") for w, v in (("idf", 1.0), ("generic", False))}
    batch = pa.RecordBatch.from_pydict({"s1_id": ["a", "b", "c"]} | fields | weights)
    out = pa.Table.from_batches(features._figures(features.PYTHON, ["s1_id"])([batch])).to_pydict()
    assert out["name_n_exact"] == [2, 0, 0] and out["norm_name_ratio"][2] is None and out["name_idf_jacc"] == [0.5, 0.0, 0.0]


def test_pairs_are_dealt_out(spark):
    """A few MB of pairs are minutes of work, so they must not end in one task."""
    records, truth = made_up(spark, 3)
    rows = tx.normalise_records(records)
    s1, pool = rows.where("source = 'S1'"), rows.where("source <> 'S1'")
    assert features.with_records(truth.coalesce(1), s1, pool).rdd.getNumPartitions() >= features.TASKS * spark.sparkContext.defaultParallelism
    assert features.text_features(features.with_records(truth.coalesce(1), s1, pool), stats.token_stats(rows)).count() == truth.count()
