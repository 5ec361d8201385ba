"""The whole lifecycle on small made-up records: train, save, load, predict, streams."""

import random

import pytest
from pyspark.sql import functions as F

from linkengine.operators import decode, model
from linkengine.plans import pipeline
from linkengine.streaming import streams


def made_up(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "bright", "cedar", "delta", "eagle", "forest", "granite", "harbor", "island", "jasper", "kernel", "lotus", "marble", "north", "ocean", "pepper"]
    rows, truth = [], []
    for i in range(40):
        name = " ".join(rng.sample(words, 3))
        addr = f"{rng.randint(1, 99)} {rng.choice(words)} street, {rng.randint(10000, 99999)} town"
        rows.append((f"S1-{i}", "S1", "x" if i % 2 else "y", f"{name} limited", addr))
        for s in (2, 3):
            if rng.random() < 0.6:
                rows.append((f"S{s}-{i}", f"S{s}", "x" if i % 2 else "y", f"{name.upper()} ltd", addr.replace("street", "st")))
                truth.append((f"S1-{i}", f"S{s}-{i}"))
    schema = "entity_id string, source string, country string, raw_name string, raw_addr string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(truth, "s1_id string, cand_id string")


@pytest.fixture(scope="module")
def linker(spark):
    return pipeline.train(*made_up(spark, 1), pipeline.Settings(top=5, rounds=5, depth=3))


def test_links(spark, linker):
    records, truth = made_up(spark, 2)
    matched, candidates = pipeline.predict(linker, records)
    assert matched.count() == candidates.count() == 40
    pairs = matched.select("s1_id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("cand_id"))
    ids = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    assert decode.macro_f(pairs, truth, ids).first()["macro_f05"] > 0.9


def test_saved(spark, linker, tmp_path):
    linker.save(str(tmp_path))
    again = pipeline.Linker.load(str(tmp_path), linker.settings)
    assert again.xs == pytest.approx(linker.xs) and again.ys == pytest.approx(linker.ys)
    feats = spark.createDataFrame([("S1-1", "S2-1", *[0.5] * 108)], ", ".join(["s1_id string", "cand_id string", *[f"`{f}` float" for f in pipeline.features.FEATURES]]))
    assert pipeline.score(again, feats).first() == pipeline.score(linker, feats).first()


def test_feature_count():
    assert len(pipeline.features.FEATURES) == len(set(pipeline.features.FEATURES)) == 108


def test_folds_do_not_leak(spark):
    rows = spark.range(200).select(F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("s1_id"), F.col("id").alias("cand_id"))
    per = model.group_folds(rows, 5).groupBy("s1_id").agg(F.countDistinct("fold").alias("n"))
    assert per.where("n > 1").count() == 0


def test_transfer(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "g string, v double")
    out = model.transfer(df, "g", lambda d: d.first().v, lambda m, d: d.first().v - m)
    assert out == [("a", "b", 2.0), ("b", "a", -2.0)]


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 1, "x", 1.0), ("2024-01-01 00:02:00", 1, "x", 2.0), ("2024-01-01 00:07:00", 2, "y", 4.0)]
    df = spark.createDataFrame(rows, "t string, user_id long, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "e"))
    out = streams.run_to_end(streams.windowed_counts(streams.read_stream(spark, str(tmp_path / "e"))), "wins", "complete")
    assert sorted((r.event_type, r.n, r.total) for r in out.collect()) == [("x", 2, 3.0), ("y", 1, 4.0)]
