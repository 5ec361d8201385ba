"""Folds, samples, interpolation, weights, augmentation, sources and the optional stages of the linker against plain versions."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkengine.functions import strings
from linkengine.functions import text as tx
from linkengine.operators import blocking, decode, dense, features, judge, model, profile, split, stats, translit
from linkengine.plans import pipeline
from linkengine.sources import tables
from linkengine.streaming import streams
from tests.test_pipeline import made_up


def test_folds_are_balanced_and_whole(spark):
    rows = spark.range(530).select((F.col("id") % 53).alias("s1_id"), F.col("id").alias("cand_id"))
    folds = model.group_folds(rows, 5)
    per = {r.fold: r.n for r in folds.select("s1_id", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sorted(per.values()) == [10, 10, 11, 11, 11]
    model.assert_no_leak(folds)
    with pytest.raises(ValueError, match="several folds"):
        model.assert_no_leak(rows.withColumn("fold", F.col("cand_id") % 2))


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_sample_is_the_first_by_hash(spark, n):
    keys = [f"k{i}" for i in range(500)]
    want = sorted(keys, key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())[:n]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert sorted(r.k for r in split.hash_sample(df, "k", n).collect()) == sorted(want)


def test_interpolation_by_bisection(spark):
    rng = np.random.default_rng(0)
    for m in (1, 2, 3, 40):
        xs = np.sort(rng.choice(1000, m, replace=False)) / 1000
        ys = np.sort(rng.random(m))
        ps = [float(v) for v in [*xs, *rng.random(50), 0.0, 1.0]]
        df = spark.createDataFrame([(p,) for p in ps], "p double")
        got = [r.y for r in df.select(decode.interpolated(F.col("p"), xs.tolist(), ys.tolist()).alias("y")).collect()]
        assert got == pytest.approx(np.interp(ps, xs, ys).tolist())


def test_postings_count_keys(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b", "a"]), (2, []), (3, ["x"])], "id long, keys array<string>")
    got = {r.id: [(x.feat, x.c) for x in r.f or []] for r in df.select("id", blocking.counted(F.col("keys")).alias("f")).collect()}
    assert got == {1: [("a", 2), ("b", 3), ("c", 1)], 2: [], 3: [("x", 1)]}


def test_landmark_after_a_long_number(spark):
    rows = [("S1-1", "S1", "x", "a", "1" * 300 + "a near road, near old mill"), ("S1-2", "S1", "x", "a", "near a b c d e")]
    df = spark.createDataFrame(rows, "entity_id string, source string, country string, raw_name string, raw_addr string")
    got = {r.entity_id: (r.landmark, r.norm_addr) for r in tx.normalise_records(df).collect()}
    assert got == {"S1-1": ("near old mill", "1" * 300 + "a near road"), "S1-2": ("near a b c d", "e")}


def test_record_text(spark):
    df = spark.createDataFrame([("ﬁne　 Name", " １２  Main "), ("only", ""), ("", "addr"), (None, None)], "n string, a string")
    assert [r[0] for r in df.select(tx.record_text(F.col("n"), F.col("a"))).collect()] == ["fine Name | 12 Main", "only", " | addr", ""]


def test_raw_tokens_are_case_folded(spark):
    df = spark.createDataFrame([("STRASSE Straße www.Ｓhop.com null ΣΑΣ",)], "t string")
    assert df.select(translit.raw_tokens(F.col("t"))).first()[0] == ["strasse", "strasse", "shop", "σασ"]


def plain_features(pair, idf):
    out = {}
    for side, f in features.FIELDS.items():
        a, b = pair[f"s_{f}"].split(), pair[f"p_{f}"].split()
        w = lambda t, f=f: idf[f].get(t, idf[f][None])
        every = set(a) | set(b)
        out[f"{side}_idf_jacc"] = sum(map(w, set(a) & set(b))) / sum(map(w, every)) if every else None
        values = strings.field_features(a, b, ([w(t) for t in a], [w(t) for t in b]), ([t == "&" for t in a], [t == "&" for t in b]))
        out |= {f"{side}_{n}": v for n, v in zip(strings.FIELD_FEATURES, values, strict=True)}
    for f, s in features.SCORES:
        a, b = pair[f"s_{f}"], pair[f"p_{f}"]
        out[f"{f}_{s}"] = strings.SCORERS[s](a, b) if a and b else None
    return out


def test_text_features_equal_plain_ones(spark):
    records, truth = made_up(spark, 3)
    rows = tx.normalise_records(records)
    st = stats.token_stats(rows)
    pairs = features.with_records(truth, rows.where("source = 'S1'"), rows.where("source <> 'S1'"))
    idf = {}
    for f in features.FIELDS.values():
        for r in stats.idf_rows(st, f).collect():
            idf.setdefault(r.country, {}).setdefault(f, {})[r.token] = r.idf
    got = {(r.s1_id, r.cand_id): r.asDict() for r in features.text_features(pairs, st).collect()}
    assert len(got) == truth.count()
    for r in pairs.collect():
        want = plain_features(r.asDict(), idf[r.s_country])
        own = got[r.s1_id, r.cand_id]
        for n, v in want.items():
            assert own[n] == pytest.approx(v, rel=1e-5), n


def test_unknown_ids_stop_the_features(spark):
    records, truth = made_up(spark, 3)
    rows = tx.normalise_records(records)
    s1, pool = rows.where("source = 'S1'"), rows.where("source <> 'S1'")
    lost = spark.createDataFrame([("S1-1", "S2-999")], "s1_id string, cand_id string")
    assert features.with_records(lost, s1, pool).count() == 0
    with pytest.raises(Exception, match="unknown cand_id S2-999"):
        features.with_records(lost, s1, pool, checked=True).collect()


def test_augmented_pairs_are_normalised_again(spark):
    side = lambda p: f"{p}raw_name string, {p}raw_addr string, {p}country string, {p}source string"
    rows = [(f"S1-{i}", f"S2-{i}", f"Alpha {i} Ltd", f"{i} Road", "x", "S1", f"Beta {i} Ltd", f"{i} Street", "y", "S2") for i in range(60)]
    df = spark.createDataFrame(rows, f"s1_id string, cand_id string, {side('s_')}, {side('p_')}")
    out = judge.augmented(df, drop_addr=0.5, scrambled=0.4).collect()
    assert {r.s_country for r in out if "swap" in r.aug} == {"y"} and {r.s_country for r in out if "swap" not in r.aug} == {"x"}
    dropped = [r for r in out if "drop_addr" in r.aug]
    assert {(r.s_raw_addr == "") + (r.p_raw_addr == "") for r in dropped} == {1}
    assert {r.s_raw_addr == "" for r in dropped} == {True, False}  # either side
    for r in out:
        assert r.s_addr_empty == (r.s_raw_addr == "") and r.s_norm_name == r.s_raw_name.lower()
        assert ("ltd" in r.s_norm_name) == ("scramble" not in r.aug)


def test_dropout_and_top_per(spark):
    df = spark.createDataFrame([(str(i), f"n{i} | a{i}") for i in range(50)] + [("x", "alone")], "k string, t string")
    got = {r.k: r.d for r in df.select("k", dense.field_dropout(F.col("t"), F.col("k")).alias("d")).collect()}
    assert got.pop("x") == "alone" and {v[0] for v in got.values()} == {"n", "a"} and all(v[1:] == k for k, v in got.items())


def test_files(spark, tmp_path):
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    wide = tables.read_truth(spark, str(truth), spark.createDataFrame([("S2-1",), ("S3-2",)], "cand_id string"))
    assert split.truth_long(wide).count() == 2
    with pytest.raises(ValueError, match="unknown ids"):
        tables.read_truth(spark, str(truth), spark.createDataFrame([("S2-1",)], "cand_id string"))
    tables.write_report({"b": 1, "a": {"n": 2}}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": {"n": 2}, "b": 1}
    (tmp_path / "train").mkdir()
    for k in (1, 2, 3):
        (tmp_path / "train" / f"train_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + f'S{k}-1\tName "quoted"\t1 Road\tx\n')
    rows = pipeline.read_split(spark, str(tmp_path), "train")
    assert sorted((r.entity_id, r.source, r.raw_name) for r in rows.collect()) == [(f"S{k}-1", f"S{k}", 'Name "quoted"') for k in (1, 2, 3)]
    (tmp_path / "train" / "train_source2.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\ta\tb\tx\nS2-1\ta\tb\tx\n")
    with pytest.raises(ValueError, match="repeated ids"):
        pipeline.read_split(spark, str(tmp_path), "train")


def test_stream_meets_postings(spark, tmp_path):
    spark.createDataFrame([("p1", "x", ["a", "b", "a"]), ("p2", "y", ["a"])], "id string, grp string, keys array<string>").write.parquet(str(tmp_path / "pool"))
    postings = spark.createDataFrame([("x", "a", "s1", 0.5), ("x", "b", "s2", 0.25)], "grp string, feat string, s1_id string, w double")
    out = streams.run_to_end(streams.match_stream(streams.read_stream(spark, str(tmp_path / "pool")), postings), "met")
    assert sorted((r.cand_id, r.s1_id, r.w) for r in out.collect()) == [("p1", "s1", 0.5), ("p1", "s2", 0.25)]


def test_profile_runs_whole(spark):
    records, truth = made_up(spark, 4)
    out = profile.profile(records, truth)
    assert {n: df.count() > 0 for n, df in out.items() if n not in ("hard_negatives", "multi_owner", "cross_group")}["sizes"]


def test_combiner_rows(spark):
    keys = [("s", f"c{i}", i / 10) for i in range(5)]
    scored = spark.createDataFrame(keys, "s1_id string, cand_id string, p double")
    asked = spark.createDataFrame([("s", "c1", 0.9)], "s1_id string, cand_id string, pl double")
    rows = {r.cand_id: r for r in model.combiner_input(None, scored, judge=asked).collect()}
    assert rows["c1"].judge_scored == 1 and rows["c1"].judge_minus_p1 == pytest.approx(0.8)
    assert rows["c2"].judge_scored == 0 and rows["c2"].judge_p is None
    assert model.full_rounds([10, 20]) == 17


def test_all_stages_together(spark, tmp_path, monkeypatch):
    """Pre-ranker, transliterated channels, combiner and dense hits in one linker, saved and loaded; one sparse channel for speed."""
    monkeypatch.setattr(pipeline.blocking, "SPARSE", blocking.SPARSE[:1])
    records, truth = made_up(spark, 5)
    native = truth.where("cand_id like 'S2-%'").select(F.col("cand_id").alias("entity_id"), F.lit(True).alias("native"))
    cyrillic = F.translate(F.lower("raw_name"), "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз")
    records = records.join(native, "entity_id", "left").withColumn("raw_name", F.when(F.col("native"), cyrillic).otherwise(F.col("raw_name"))).drop("native")
    rng = random.Random(1)
    hits = truth.select(F.lit("dense").alias("channel"), "s1_id", "cand_id", F.lit(rng.random()).alias("score"), F.lit(0).alias("rank"))
    settings = pipeline.Settings(top=3, rounds=1, depth=2, pruner=True, translit=True, combine=True)
    linker = pipeline.train(records, truth, settings, hits)
    assert linker.pruner is not None and linker.combiner is not None and len(linker.dictionary) > 5
    linker.save(str(tmp_path))
    again = pipeline.Linker.load(str(tmp_path))
    assert again.settings == settings and sorted(again.dictionary) == sorted(linker.dictionary)
    matched, _ = pipeline.predict(again, records, hits)
    pairs = matched.select("s1_id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("cand_id"))
    ids = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    assert decode.macro_f(pairs, truth, ids).first()["macro_f05"] > 0.8
