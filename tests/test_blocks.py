"""Top-k joins of sparse channels by blocks against plain Python; pairs never leave a task."""

import math
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkengine.functions import strings
from linkengine.operators import blocking, features, model

SCHEMA = "id string, grp string, keys array<string>"


def plain(queries, pool, k, max_df):
    both = [(0, *r) for r in queries] + [(1, *r) for r in pool]
    n = Counter(g for _, _, g, _ in both)
    df = Counter((g, f) for _, _, g, keys in both for f in set(keys or ()))
    own = {}
    for side, i, g, keys in both:
        w = {f: (1 + math.log(c)) * (math.log((n[g] + 1) / (df[g, f] + 1)) + 1) for f, c in Counter(keys or ()).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        own[side, i] = g, {f: x / norm for f, x in w.items()}
    out = []
    for _, q, g, _ in [r for r in both if r[0] == 0]:
        scores = []
        for _, p, h, _ in [r for r in both if r[0] == 1]:
            shared = [f for f in own[0, q][1].keys() & own[1, p][1].keys() if df[g, f] <= max_df] if g == h else []
            if shared:
                scores.append((-round(sum(own[0, q][1][f] * own[1, p][1][f] for f in shared), 6), p))
        out += [(q, p, -s, r) for r, (s, p) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows_of(rng, n, tag):
    return [(f"{tag}{i}", rng.choice("xy"), [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(7))] or rng.choice([None, []])) for i in range(n)]


@pytest.mark.parametrize("max_df", [20, 1000])
def test_blocks_equal_plain_join(spark, monkeypatch, max_df):
    for name, few in (("QUERIES", 7), ("POOL", 9), ("POSTINGS", 40)):
        monkeypatch.setattr(blocking, name, few)
    rng = random.Random(max_df)
    queries, pool = rows_of(rng, 40, "q"), rows_of(rng, 70, "p") + [("p1000", "z", ["a"])]
    got = blocking.sparse_topk(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA), 4, max_df)
    assert sorted((r.s1_id, r.cand_id, r.score, r["rank"]) for r in got.collect()) == plain(queries, pool, 4, max_df)


@pytest.mark.parametrize("step", [1, 60, 10**6])
def test_steps_of_a_block(monkeypatch, step):
    """The same best rows whatever a step holds, whether its pairs are dense or few."""
    monkeypatch.setattr(blocking, "STEP", step)
    rng = random.Random(3)
    for words in (3, 4000):
        side = lambda s, n: [{"side": s, "id": f"{s}-{i:02d}", "feats": (f := sorted({rng.randrange(words) for _ in range(30)})), "ws": [rng.random() for _ in f]} for i in range(n)]  # noqa: E731, B023
        queries, pool = side(0, 25) + [{"side": 0, "id": f"0-none{i}", "feats": [9000 + i], "ws": [1.0]} for i in range(5)], side(1, 40)
        met = blocking._meet(3, pa.schema([("s1_id", pa.string()), ("cand_id", pa.string()), ("score", pa.float64())]))
        got = [tuple(r.values()) for b in met(pa.Table.from_pylist(queries + pool)) for r in b.to_pylist()]
        want = []
        for q in queries:
            of = dict(zip(q["feats"], q["ws"], strict=True))
            scores = [(-round(sum(of.get(f, 0) * w for f, w in zip(p["feats"], p["ws"], strict=True)), 6), p["id"]) for p in pool if of.keys() & set(p["feats"])]
            want += [(q["id"], p, -s) for s, p in sorted(scores)[:3]]
        assert sorted(got) == sorted(want)


def test_pairs_are_no_rows(spark):
    """600 times 900 rows with one common feature: Spark's plan gets the best of each query, not 540,000 pairs."""
    side = lambda n: spark.range(n).select(F.format_string("%04d", "id").alias("id"), F.lit("x").alias("grp"), F.array(F.lit("a")).alias("keys"))
    out = blocking.sparse_topk(side(600), side(900), 2, 2000)
    rows = out.collect()
    assert {(r.cand_id, r.score, r["rank"]) for r in rows} == {("0000", 1.0, 0), ("0001", 1.0, 1)} and len(rows) == 1200
    plan = out._jdf.queryExecution().executedPlan()
    counts, todo = [], [plan]
    while todo:
        x = todo.pop()
        if x.metrics().contains("numOutputRows"):
            counts.append(x.metrics().apply("numOutputRows").value())
        inner = [x.executedPlan()] if hasattr(x, "executedPlan") and x.nodeName() == "AdaptiveSparkPlan" else [x.plan()] if "QueryStage" in x.nodeName() else []
        todo += inner + [x.children().apply(i) for i in range(x.children().size())]
    assert counts and max(counts) < 10_000


def test_long_rows_are_sorted_once(spark):
    """30,000 keys of one row: sorted again for each key, they would take minutes."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: (i % 20_000).cast("string")).alias("keys"))
    start = time.time()
    row = df.select(blocking.counted(F.col("keys")).alias("f")).select(F.size("f").alias("n"), F.expr("aggregate(f, 0L, (s, x) -> s + x.c)").alias("c")).first()
    assert (row.n, row.c) == (20_000, 30_000) and time.time() - start < 30


def test_levenshtein_against_rows():
    def rows(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 64, 65, 90])))
    for a, b in [(text(), text()) for _ in range(1500)]:
        assert strings.levenshtein(a, b) == rows(a, b)


def leaves(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_plans_of_the_features_stay_small(spark):
    """Each plan that a large one holds again takes memory of the driver: hits, texts and weights are read, not planned again."""
    record = {c: F.lit("a 1") for c in features.RECORD} | {"country": F.lit("x"), "name_romanized": F.lit(False)}
    row = spark.range(1)
    pairs = row.select(F.lit("S1-1").alias("s1_id"), F.lit("S2-1").alias("cand_id"), F.uuid().alias("marked"), *[v.alias(p + c) for p in ("s_", "p_") for c, v in record.items()])
    st = spark.createDataFrame([(f, c, "a", 1, 1, 2) for f in ("norm_name", "norm_addr") for c in ("", "x")], "field string, country string, token string, df long, pos_count long, n_docs long")
    out = features.with_weights(pairs, st, ["norm_name", "norm_addr"])
    assert leaves(out, "Range (") == 1 and leaves(out, "Aggregate") == 0
    got = out.first()
    assert len(got.s_norm_name_idf) == len(got.p_norm_addr_idf) == 2


def test_hits_of_channels_are_written(spark):
    rows = spark.createDataFrame([("S1-1", "S1", "x"), ("S2-1", "S2", "x")], "entity_id string, source string, country string")
    rows = rows.withColumns({c: F.lit("red rose 12") for c in ("norm_name", "fold_name", "norm_addr", "fold_addr", "house_number")})
    out = blocking.union(rows.where("source = 'S1'"), rows.where("source <> 'S1'"))
    assert leaves(out, "MapInArrow") == 0
    assert out.first().n_channels >= 2


def test_plans_of_the_folds_hold_one_vector(spark, monkeypatch):
    """Fits and scoring read the features as one column: k plans of 108 expressions fill the driver."""
    collected = []
    monkeypatch.setattr(model, "collected", collected.append)
    rows = spark.range(60).select(
        F.concat(F.lit("S1-"), F.col("id") % 12).alias("s1_id"), F.col("id").alias("cand_id"), (F.col("id") % 2).cast("double").alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("float")).alias("b"), (F.col("id") % 2).cast("int").alias("label"),
    )
    out = model.out_of_fold(rows, ["a", "b"], 3, rounds=2, depth=1)
    assert leaves(out, "nanvl") == 0 and leaves(out, "VectorAssembler") == 0
    assert len(collected) == 3
    assert out.columns == [*rows.columns, "fold", "p"]
    got = {r.cand_id: r for r in out.collect()}
    assert len(got) == 60 and {r.fold for r in got.values()} == {0, 1, 2}
    for n, r in got.items():
        assert (r.a, r.b, r.label) == (n % 2, n if n % 3 else model.MISSING, n % 2)
        assert (r.p > 0.5) == (r.label == 1)


def test_delta_writes_new_pairs_only(spark, monkeypatch):
    names = features.FEATURES[len(features.meta_names()) :]
    many = {}

    def written(df, tag):
        many[tag] = df.count()
        return df

    monkeypatch.setattr(features, "written", written)
    monkeypatch.setattr(features, "with_records", lambda pairs, s1, pool, checked: pairs)
    monkeypatch.setattr(features, "text_features", lambda pairs, st: pairs.select("*", *[F.lit(2.0).alias(n) for n in names]))
    ids = spark.range(10).select(F.lit("S1-1").alias("s1_id"), F.concat(F.lit("S3-"), "id").alias("cand_id"), "id")
    cands = ids.select("s1_id", "cand_id", F.lit(4).alias("bitmask"), F.lit(1).alias("n_channels"), F.col("id").cast("double").alias("cheap_score"))
    earlier = ids.where("id < 7").select("s1_id", "cand_id", *[F.lit(1.0).alias(n) for n in names])
    out = features.delta_features(cands.where("cheap_score > 0"), earlier, None, None, None)
    assert many == {"cands": 9, "earlier": 7, "fresh": 3}
    assert sorted(r[names[0]] for r in out.collect()) == [1.0] * 6 + [2.0] * 3
    with pytest.raises(ValueError, match="rows of text features"):
        features.delta_features(cands, earlier.unionByName(earlier), None, None, None)
