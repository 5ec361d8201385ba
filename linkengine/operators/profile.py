"""Profiling queries over raw sources and true pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import score
from .split import hash_order


def _share(c):
    return F.round(F.avg(c.cast("double")), 6)


def sizes(records: DataFrame) -> DataFrame:
    """E1, E12: rows and share for each source and country."""
    n = records.groupBy("source", "country").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


def match_counts(ids: DataFrame, truth: DataFrame) -> DataFrame:
    n = truth.groupBy("s1_id").agg(F.count("*").alias("n"))
    return ids.join(n, "s1_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def singleton_rate(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """E2: share of ids without a match, the score of empty answers."""
    return match_counts(ids, truth).agg(F.count("*").alias("n"), _share(F.col("n") == 0).alias("singleton_rate"))


def match_percentiles(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """E3: mean and percentiles of matches."""
    cuts = [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    ps = [F.percentile("n", F.lit(c)).alias(f"p{int(100 * c)}") for c in cuts]
    return match_counts(ids, truth).agg(F.round(F.avg("n"), 6).alias("mean"), *ps)


def multi_owner(truth: DataFrame) -> DataFrame:
    """E4: records that more than one S1 owns."""
    own = truth.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("n_owners"))
    return own.agg(F.count("*").alias("n_matched"), F.sum((F.col("n_owners") > 1).cast("long")).alias("n_multi"), F.max("n_owners").alias("most"))


def cross_group(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """E5: true pairs whose countries differ."""
    a, b = s1.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1")), pool.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("c2"))
    pairs = truth.join(a, "s1_id").join(b, "cand_id")
    return pairs.groupBy("c1", "c2").agg(F.count("*").alias("n")).withColumn("cross", F.col("c1") != F.col("c2"))


def unmatched_share(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """E6: share of pool records without an owner, for each source."""
    mark = truth.select(F.col("cand_id").alias("entity_id")).distinct().withColumn("m", F.lit(1))
    return pool.join(mark, "entity_id", "left").groupBy("source").agg(F.count("*").alias("n"), _share(F.col("m").isNull()).alias("unmatched"))


def true_pairs(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    side = lambda d, k, p: d.select(F.col("entity_id").alias(k), *[F.col(c).alias(p + c) for c in ("country", "raw_name", "raw_addr")])
    return truth.join(side(s1, "s1_id", "a_"), "s1_id").join(side(pool, "cand_id", "b_"), "cand_id")


def exact_rates(pairs: DataFrame) -> DataFrame:
    """E7: equal names, addresses and both among true pairs, ignoring case."""
    same = lambda c: F.lower(f"a_{c}") == F.lower(f"b_{c}")
    return pairs.agg(F.count("*").alias("n"), _share(same("raw_name")).alias("same_name"), _share(same("raw_addr")).alias("same_addr"), _share(same("raw_name") & same("raw_addr")).alias("same_both"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def name_relation(a, b):
    """exact, reorder, abbrev_or_drop, typo or other_noise; words are runs of letters or of digits."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    wa, wb = words(a), words(b)
    sa, sb = F.array_sort(F.array_distinct(wa)), F.array_sort(F.array_distinct(wb))
    inside = (F.size(sa) > 0) & (F.size(sb) > 0) & ((F.size(F.array_except(sa, sb)) == 0) | (F.size(F.array_except(sb, sa)) == 0))
    return F.when(a == b, "exact").when((sa == sb) & (wa != wb), "reorder").when(inside & (sa != sb), "abbrev_or_drop").when(sequence_ratio(a, b) > 0.8, "typo").otherwise("other_noise")


def noise_census(pairs: DataFrame) -> DataFrame:
    """E8: shares of name relations among true pairs."""
    rel = pairs.select(name_relation(F.lower("a_raw_name"), F.lower("b_raw_name")).alias("relation"))
    n = rel.groupBy("relation").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / rel.agg(F.count("*")).scalar(), 6))


def hard_negatives(s1: DataFrame, pool: DataFrame, truth: DataFrame, n_s1: int = 500, n_pool: int = 300, cut: float = 85.0, seed: int = 42) -> DataFrame:
    """E9: sampled S1 whose most similar sampled, unmatched record of its country is a near twin (a report on a stated sample)."""
    free = pool.join(truth.select(F.col("cand_id").alias("entity_id")), "entity_id", "left_anti")
    some = s1.orderBy(hash_order("entity_id", seed)).limit(n_s1).select(F.col("entity_id").alias("s1_id"), "country", F.lower("raw_name").alias("a"))
    w = Window.partitionBy("country").orderBy(hash_order("entity_id", seed + 1), "entity_id")
    few = free.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_pool).select(F.col("entity_id").alias("cand_id"), "country", F.lower("raw_name").alias("b"))
    pairs = some.join(few, "country").withColumn("similarity", score("ratio", F.col("a"), F.col("b")))
    best = pairs.groupBy("s1_id").agg(F.max_by(F.struct("cand_id", "a", "b", "similarity"), F.struct("similarity", "cand_id")).alias("x"))
    return best.select("s1_id", "x.*").where(F.col("similarity") >= cut)


def field_quality(records: DataFrame) -> DataFrame:
    """E10: lengths, empties and digits of raw fields for each source."""
    out = []
    for c in ("raw_name", "raw_addr"):
        out += [F.round(F.avg(F.length(c)), 6).alias(f"{c}_length"), _share(F.col(c) == "").alias(f"{c}_empty"), _share(F.col(c).rlike("[0-9]")).alias(f"{c}_digits"), _share(F.col(c).rlike(r"[^\x00-\x7F]")).alias(f"{c}_non_ascii")]
    return records.groupBy("source").agg(F.count("*").alias("n"), *out)


def digit_runs(records: DataFrame) -> DataFrame:
    """E11: length of the last digit run of the address, by country."""
    last = F.element_at(F.regexp_extract_all("raw_addr", F.lit("[0-9]+"), F.lit(0)), -1)
    run = F.when(F.col("raw_addr").rlike("[0-9]"), F.length(last)).otherwise(0)
    return records.groupBy("country", run.alias("run_length")).agg(F.count("*").alias("n"))


def shortcut(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """Correlation of the id's number with the matches: a leak would show."""
    rows = match_counts(ids, truth).withColumn("number", F.regexp_extract("s1_id", r"(\d+)$", 1).cast("double"))
    return rows.agg(F.round(F.corr("number", F.col("n").cast("double")), 6).alias("id_corr"))


def positive_sample(pairs: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    return pairs.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "s1_id", "cand_id"))).limit(n)


def profile(records: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """All profiling queries of one data set; records (entity_id, source, country, raw_name, raw_addr)."""
    s1, pool = records.where("source = 'S1'"), records.where("source <> 'S1'")
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    pairs = true_pairs(truth, s1, pool)
    return {
        "sizes": sizes(records), "singleton_rate": singleton_rate(ids, truth), "match_percentiles": match_percentiles(ids, truth), "multi_owner": multi_owner(truth),
        "cross_group": cross_group(truth, s1, pool), "unmatched_share": unmatched_share(pool, truth), "exact_rates": exact_rates(pairs), "noise_census": noise_census(pairs),
        "hard_negatives": hard_negatives(s1, pool, truth), "field_quality": field_quality(records), "digit_runs": digit_runs(records), "shortcut": shortcut(ids, truth), "positive_sample": positive_sample(pairs),
    }
