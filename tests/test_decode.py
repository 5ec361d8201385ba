"""Decisions, metrics, owners, splits and sinks on worked examples."""

import itertools

import pytest
from pyspark.sql import functions as F

from linkengine.operators import blocking, collective, decode, split, stats
from linkengine.sources import tables
from linkengine.streaming import streams


def pairs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "s1_id string, cand_id string, p double" + extra)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_decode(spark):
    rows = [("a", f"x{i}", p) for i, p in enumerate((0.05, 0.03, 0.01))] + [("b", f"x{i}", p) for i, p in enumerate((0.97, 0.1, 0.05))] + [("c", f"x{i}", p) for i, p in enumerate((0.9, 0.85, 0.8))]
    assert got(decode.decode(pairs(spark, rows))) == [("b", "x0"), ("c", "x0"), ("c", "x1"), ("c", "x2")]


def plain_expected(ps, q):
    out = []
    for k in range(len(ps) + 1):
        total = 0.0
        for hits in itertools.product((0, 1), repeat=len(ps) + 1):
            w = 1.0
            for h, p in zip(hits, [*ps, q], strict=True):
                w *= p if h else 1 - p
            tp, fn = sum(hits[:k]), sum(hits[k:])
            fp = k - tp
            f = 1.0 if tp + fn + fp == 0 else 0.0 if tp == 0 else 1.25 * tp / (1.25 * tp + 0.25 * fn + fp)
            total += w * f
        out.append(total)
    return out


@pytest.mark.parametrize("ps, q", [([], 0.0), ([0.4], 0.1), ([0.9, 0.5, 0.2], 0.05), ([0.99, 0.98, 0.3, 0.3, 0.01], 0.0)])
def test_expected_f(spark, ps, q):
    df = spark.createDataFrame([(ps,)], "ps array<double>")
    assert df.select(decode.expected_f(F.col("ps"), F.lit(q)).alias("e")).first()["e"] == pytest.approx(plain_expected(ps, q), abs=1e-9)


def test_owner(spark):
    rows = [("a", "x", 0.9), ("b", "x", 0.6), ("b", "y", 0.7)]
    assert got(decode.hard_owner(pairs(spark, rows)).select("s1_id", "cand_id", "p")) == [("a", "x", 0.9), ("b", "x", 0.0), ("b", "y", 0.7)]
    soft = {(r.s1_id, r.cand_id): r.p for r in decode.soft_owner(pairs(spark, rows)).collect()}
    assert soft["b", "y"] == pytest.approx(0.7) and soft["a", "x"] == pytest.approx(0.54)


def test_macro(spark):
    t = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "s1_id string, cand_id string")
    p = spark.createDataFrame([("a", "x"), ("c", "w")], "s1_id string, cand_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    f = {r.s1_id: r.f for r in decode.entity_f(p, t, ids).collect()}
    assert f == pytest.approx({"a": 1.25 / 1.5, "b": 0.0, "c": 0.0, "d": 1.0})
    one = spark.createDataFrame([("q", i) for i in ("S2-00047", "S2-00193", "S3-00812")], "s1_id string, cand_id string")
    true = spark.createDataFrame([("q", i) for i in ("S2-00047", "S3-00812")], "s1_id string, cand_id string")
    assert decode.macro_f(one, true, spark.createDataFrame([("q",)], "s1_id string")).first()[0] == pytest.approx(0.714, abs=1e-3)


def test_context(spark):
    rows = [("a", "x", 0.8), ("a", "y", 0.9), ("a", "z", 0.1), ("b", "x", 0.4)]
    r = {(x.s1_id, x.cand_id): x for x in collective.entity_context(pairs(spark, rows)).collect()}
    assert [r[k].rank for k in sorted(r)] == [1, 0, 2, 0]
    assert [r[k].gap for k in sorted(r)] == pytest.approx([-0.1, 0, -0.8, 0])
    assert [r[k].margin for k in sorted(r)] == pytest.approx([0.1, 0.1, 0.1, 0.4])


def test_siblings(spark):
    rows = [("a", "x", 0.9, "acme co", "1 rd", "1", "5"), ("a", "y", 0.2, "acme", "2 rd", "2", "5"), ("a", "z", 0.8, "acme co", "", "3", ""), ("b", "w", 0.9, "q", "r", "", "")]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, p double, name string, addr string, house string, post string")
    r = {x.cand_id: x for x in collective.sibling_support(df).collect()}
    assert (r["x"].sib_count, r["y"].sib_count, r["z"].sib_count, r["w"].sib_count) == (1, 2, 1, 0)
    assert r["x"].sib_name == 100 and r["y"].sib_number == 1 and r["w"].sib_name is None


def test_bootstrap(spark):
    df = spark.createDataFrame([(str(i), i % 2 * 1.0, i % 2 * 1.0) for i in range(50)], "s1_id string, a double, b double")
    r = decode.bootstrap_diff(df, 50).first()
    assert r["diff"] == 0 and not r["significant"]
    r = decode.bootstrap_diff(df.withColumn("b", F.col("a") + 1), 50).first()
    assert r["diff"] == pytest.approx(1) and r["low"] == pytest.approx(1) and r["significant"]


def test_isotonic_round_trip(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.9, 1)], "p double, label int")
    xs, ys = decode.breakpoints(decode.fit_isotonic(df))
    out = [r[0] for r in spark.createDataFrame([(0.0,), (0.25,), (0.95,)], "p double").select(decode.interpolated(F.col("p"), xs, ys)).collect()]
    assert out == pytest.approx([0.0, 0.5, 1.0])


def test_buckets(spark):
    out = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 9)], "n int").select(split.bucket(F.col("n"))).collect()
    assert [r[0] for r in out] == ["0", "1", "2-3", "2-3", "4+", "4+"]


def test_df_cap(spark):
    q = spark.createDataFrame([("q", "g", ["common"])], "id string, grp string, keys array<string>")
    p = spark.createDataFrame([(f"p{i}", "g", ["common"]) for i in range(5)] + [("w", "g", ["word"])], "id string, grp string, keys array<string>")
    assert blocking.sparse_topk(q, p, 3, 3).count() == 0
    assert [r.cand_id for r in blocking.sparse_topk(q, p, 3, 10).orderBy("rank").collect()] == ["p0", "p1", "p2"]


def test_union(spark):
    rows = [("name_char", "a", "x", 0.9, 0), ("name_char", "a", "y", 0.5, 1), ("addr_char", "a", "x", 0.4, 0), ("addr_char", "b", "z", 0.3, 0), ("addr_char", "b", "v", 0.2, 1)]
    u = blocking.union_hits(spark.createDataFrame(rows, "channel string, s1_id string, cand_id string, score double, rank int"))
    r = {(x.s1_id, x.cand_id): x for x in u.collect()}
    assert len(r) == 4 and r["a", "x"].bitmask == 12 and r["a", "x"].n_channels == 2 and r["a", "y"].addr_char_rank == 999 and r["a", "y"].addr_char_score is None


def test_token_counts(spark):
    rows = [("C1", "acme ltd"), ("C1", "beta ltd"), ("C1", "ltd gamma tools"), ("C2", "x ltd"), ("C2", "y ltd"), ("C2", "z")]
    df = spark.createDataFrame(rows, "country string, norm_name string")
    r = {(x.country, x.token): x for x in stats.token_stats(df, ("norm_name",)).collect()}
    assert (r["", "ltd"].df, r["C1", "ltd"].df, r["C2", "ltd"].df, r["", "ltd"].n_docs) == (5, 3, 2, 6)
    assert r["C1", "ltd"].pos_count == 2


def test_id_lists(spark):
    df = spark.createDataFrame([("S1-2", "S3-9"), ("S1-1", "S2-5"), ("S1-2", "S2-1"), ("S1-2", "S3-9")], "s1_id string, cand_id string")
    assert got(tables.id_lists(df)) == [("S1-1", "S2-5"), ("S1-2", "S2-1,S3-9")]


def test_tsv(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-00047\tNA\t123 Main St\tNA\nS1-2\tJoe's \"Best\" Diner\t\tX\nS1-3\tnext\ty\tX\n")
    rows = {r.entity_id: r for r in tables.read_tsv(spark, str(path), tables.SOURCE, check=True).collect()}
    assert rows["S1-00047"].business_name == "NA" and rows["S1-2"].business_name == 'Joe\'s "Best" Diner' and rows["S1-2"].business_address == "" and len(rows) == 3
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(path), ["a"])


def test_output_round_trip(spark, tmp_path):
    lists = spark.createDataFrame([("S1-2", ""), ("S1-1", "S2-5,S3-1")], "s1_id string, ids string")
    tables.write_id_lists(lists, str(tmp_path / "out"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-5,S3-1", "S1-2\t"]


def test_output_problems(spark):
    lines = spark.createDataFrame([("S1-1\tS2-1,S2-1",), ("S1-9\tS2-2,",), ("S1-1\tS4-1",)], "value string")
    required = spark.createDataFrame([("S1-1", "c"), ("S1-2", "c")], "s1_id string, country string")
    valid = spark.createDataFrame([("S2-1",)], "cand_id string")
    n = {r.problem: r.n for r in tables.output_problems(lines, required, valid, spark.createDataFrame([("S1-1\tS2-1",)], "value string")).collect()}
    assert n["duplicate ids in a list"] == 1 and n["empty id in a list"] == 1 and n["duplicate rows"] == 1 and n["required ids missing"] == 1 and n["unknown first ids"] == 1
    assert n["unknown matched ids"] == 3 and n["matched ids outside the candidates"] == 3 and n["not exactly one tab"] == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("C1", "acme ltd", "12 main st"), ("C1", "beta ltd", ""), ("C2", "x", "9 oak")]
    df = spark.createDataFrame(rows, "country string, norm_name string, norm_addr string")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.run_to_end(streams.token_counts(streams.read_stream(spark, str(tmp_path / "in")), ("norm_name",)), "counts", "complete")
    assert got(out) == got(stats.token_counts(df, "norm_name"))
