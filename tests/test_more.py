"""Transliteration, dense search, triplets, judge texts and samples on small literals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from linkengine.functions import text as tx
from linkengine.operators import blocking, dense, judge, profile, split, translit
from linkengine.plans import registry
from tests.compare import same


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_dictionary(spark, tmp_path):
    rows = [(str(i), ["राम", "शर्मा"] if i < 4 else ["राम"], ["ram", "sharma"] if i < 4 else ["ram", "other"]) for i in range(5)] + [("x", ["ab"], ["ab"])]
    learned = translit.learn(spark.createDataFrame(rows, "pair_id string, native_tokens array<string>, latin_tokens array<string>"))
    assert {(r.native_token, r.latin_token, r.c) for r in learned.collect()} == {("राम", "ram", 5), ("शर्मा", "sharma", 4)}
    translit.save(learned, str(tmp_path / "d"))
    assert got(translit.load(spark, str(tmp_path / "d"))) == got(learned.select("native_token", "latin_token"))
    records = spark.createDataFrame([("S2-1", "राम मित्र Ltd"), ("S2-2", "")], "entity_id string, raw string")
    out = {r.entity_id: r.t for r in translit.apply(records, learned, "raw", "t").collect()}
    assert out == {"S2-1": "ram mitra ltd", "S2-2": ""}


def test_raw_tokens(spark):
    df = spark.createDataFrame([("www.Acme.com",), ("Acme NA Corp",), ("a null b",)], "t string").select(translit.raw_tokens(F.col("t")))
    assert [r[0] for r in df.collect()] == [["acme"], ["acme", "na", "corp"], ["a", "b"]]


def test_dictionary_query_keeps_letters(spark, tmp_path):
    """Pages whose titles have a sharp s: the query's words are in lower case, as in its SQL, those of ``transliterate`` are folded."""
    rows = [(5 * i + 4, f"https://x.example.net/de/{i}", f'<html lang="de"><title>Stra\u00dfe Nord</title>{i}') for i in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = registry.queries()["dice_dictionary"](spark, str(tmp_path))
    same(df, con, registry.oracle_sql()["dice_dictionary"])
    assert any("\u00df" in r.native_token for r in df.collect())
    assert not any("\u00df" in r.native_token for r in registry._dictionary(spark, str(tmp_path)).collect())


def test_scripts(spark):
    df = spark.createDataFrame([("राम",), ("abc",), ("ಪ್ರೈ",)], "t string")
    assert [r[0] for r in df.select(tx.script_of("t")).collect()] == ["DEVANAGARI", "", "KANNADA"]
    assert [r[0] for r in df.select(tx.has_non_latin(F.col("t"))).collect()] == [True, False, True]


def test_recall(spark):
    rows = spark.createDataFrame([("q0", "p1", 0), ("q0", "p2", 1), ("q0", "p0", 2), ("q1", "p0", 0), ("q1", "p2", 1), ("q1", "p1", 2)], "s1_id string, cand_id string, rank int")
    truth = spark.createDataFrame([("q0", "p0"), ("q1", "p0"), ("q1", "p1")], "s1_id string, cand_id string")
    r = dense.recall(rows, truth, (1, 3)).first()
    assert (r.recall_1, r.recall_3) == (pytest.approx(1 / 3), 1) and r.mrr == pytest.approx((1 / 3 + 1 + 1 / 3) / 3)


def test_knn_against_plain(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(8, 4)), rng.normal(size=(20, 4))
    side = lambda x, n: spark.createDataFrame([(f"{n}{i:02d}", i % 2, [float(c) for c in v]) for i, v in enumerate(x)], "id string, grp int, vec array<double>")
    forward, back = dense.knn(side(q, "q"), side(p, "p"), 3, 2)
    for i in range(8):
        best = sorted((-(round(float(q[i] @ p[j]), 6)), f"p{j:02d}") for j in range(20) if j % 2 == i % 2)[:3]
        assert [r.cand_id for r in forward.where(f"s1_id = 'q{i:02d}'").orderBy("rank").collect()] == [c for _, c in best]
    assert back.count() == 40
    cos = dense.pair_cosine(forward.select("s1_id", "cand_id", "score"), side(q, "q"), side(p, "p"))
    assert cos.where(F.abs(F.col("dense_cos") - F.col("score")) > 1e-5).count() == 0


def test_triplets(spark):
    anchors = spark.createDataFrame([("a", "A"), ("b", "B")], "s1_id string, text string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "s1_id string, cand_id string")
    pool = spark.createDataFrame([(c, c.upper(), None) for c in "xyzuvw"], "cand_id string, text string, owner string")
    near = spark.createDataFrame([(s, c, i) for s in "ab" for i, c in enumerate("xyzuvw")], "s1_id string, cand_id string, rank int")
    rows = dense.triplets(anchors, truth, pool, near, siblings=0.0).collect()
    assert len(rows) == 3 and all((r.s1_id, r.n_text.lower()) not in {("a", "x"), ("a", "y"), ("b", "z")} for r in rows)
    batched = split.batches(dense.triplets(anchors, truth, pool, near, siblings=1.0), 2)
    per = batched.groupBy("layer", "batch", "s1_id").count()
    assert per.where("count > 1").count() == 0


def test_uncertain_first(spark):
    rows = spark.createDataFrame([("s", str(i), p) for i, p in enumerate((0.05, 0.5, 0.8, 0.45, 0.95))], "s1_id string, cand_id string, p double")
    assert [r.p for r in split.infer_band(rows, most=2).collect()] == [0.5, 0.45]
    assert split.infer_band(rows).count() == 3


def test_balanced(spark):
    rows = spark.range(100).select(F.lit("s").alias("s1_id"), F.col("id").cast("string").alias("cand_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    n = {r.label: r["count"] for r in split.balanced(rows, 2.0, 12).groupBy("label").count().collect()}
    assert n == {1: 4, 0: 8}


def test_evidence(spark):
    df = spark.createDataFrame([("acme tools pvt ltd", "acme tolls private zorbex", ["ltd"])], "a string, b string, g array<string>")
    r = df.select(judge.field_evidence("a", "b", "g").alias("e")).first().e
    assert r.links.startswith("1 exact; ") and "'tools'~'tolls' (typo)" in r.links and r.unexplained == "A: ltd(generic) | B: zorbex"
    text = spark.createDataFrame([('a "b"  c',)], "t string").select(judge.clipped(F.col("t"), 5)).first()[0]
    assert text == "a 'b…"


def test_name_relations(spark):
    rows = [("a b", "a b"), ("a b", "b a"), ("a b", "a"), ("abcdefgh", "abcdefgx"), ("abc", "xyz")]
    df = spark.createDataFrame(rows, "a string, b string").select(profile.name_relation(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == ["exact", "reorder", "abbrev_or_drop", "typo", "other_noise"]


def test_boost(spark):
    rows = [("S1-1", "g", "abc", "x"), ("S1-2", "g", "abc", "")]
    s1 = spark.createDataFrame(rows, "entity_id string, country string, norm_name string, norm_addr string")
    pool = spark.createDataFrame([(f"S2-{i}", "g", "abc", "y") for i in range(4)], "entity_id string, country string, norm_name string, norm_addr string")
    channel = blocking.Channel("name_char", blocking.SPARSE[0].keys, 1, 2000, ("norm_addr", 3))
    n = {r.s1_id: r["count"] for r in blocking.channel_hits(s1, pool, channel).groupBy("s1_id").count().collect()}
    assert n == {"S1-1": 1, "S1-2": 3}
