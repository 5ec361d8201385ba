"""Stratified halves, pool ownership and sampling, all by hash order so that any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A_SHARE = 0.55


def bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def hash_order(column: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string")))


def truth_long(wide: DataFrame) -> DataFrame:
    """Wide truth (source1_entity_id, matched_entity_ids) as pairs; an empty list has none."""
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    return wide.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("cand_id"))


def hash_rank(df: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``rank`` (from 1, by hash of the key) and ``size`` of its group.

    Hashes spread evenly, so a group is ranked in slices by the hash's first digits and each slice starts after the rows of
    those before it: no task sorts more than a slice, however large a group is.
    """
    rows = df.withColumn("__h", hash_order(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    n = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*by, "__b", before.alias("__before"), F.sum("__n").over(w).alias("size"))
    own = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))
    return rows.withColumn("__r", own).join(n, [*by, "__b"]).withColumn("rank", F.col("__before") + F.col("__r")).drop("__h", "__b", "__r", "__before")


def ab_split(s1: DataFrame, truth: DataFrame, share: float = A_SHARE, seed: int = 42) -> DataFrame:
    """entity_id, country, n_matches, bucket, split: the first round(share * n) of each stratum by hash are A."""
    n = truth.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count("*").alias("n_matches"))
    rows = s1.select("entity_id", "country").join(n, "entity_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("int"))
    rows = rows.withColumn("bucket", bucket(F.col("n_matches")))
    ranked = hash_rank(rows, ["country", "bucket"], "entity_id", seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.bround(F.col("size") * share), "A").otherwise("B")).drop("rank", "size")


def pool_split(pool: DataFrame, truth: DataFrame, split: DataFrame) -> DataFrame:
    """entity_id, split of pool rows: the halves of their owners, ``shared`` without any."""
    own = truth.join(split.select(F.col("entity_id").alias("s1_id"), "split"), "s1_id").groupBy(F.col("cand_id").alias("entity_id"))
    half = own.agg(F.array_join(F.array_sort(F.collect_set("split")), "").alias("split"))
    return pool.select("entity_id").join(half, "entity_id", "left").withColumn("split", F.coalesce("split", F.lit("shared")))


def split_report(split: DataFrame) -> DataFrame:
    """Size, singleton rate and mean matches of each half, over all and by country."""
    aggs = [F.count("*").alias("n"), F.round(F.avg((F.col("n_matches") == 0).cast("double")), 6).alias("singleton_rate"), F.round(F.avg("n_matches"), 6).alias("mean_matches"), F.grouping("country").alias("g")]
    out = split.groupingSets([["split"], ["split", "country"]], "split", "country").agg(*aggs)
    return out.withColumn("country", F.when(F.col("g") == 1, "ALL").otherwise(F.col("country"))).drop("g")


def hash_sample(df: DataFrame, column: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows without replacement: the first by hash.

    The rows of each of 4096 hash slices are counted; whole slices are taken by a filter, and only the slice in which the
    sample ends is sorted, so that a sample may grow with the data.
    """
    rows = df.withColumn("__h", hash_order(column, seed)).withColumn("__b", F.substring("__h", 1, 3))
    left, last = n, ""
    for part, count in sorted((r["__b"], r["count"]) for r in rows.groupBy("__b").count().collect()):
        last = part
        if count > left:
            break
        left -= count
        last = part + "~"
    whole = rows.where(F.col("__b") < last)
    some = rows.where(F.col("__b") == last).orderBy("__h", column).limit(max(left, 0))
    return whole.unionByName(some).drop("__h", "__b")


def crc_sample(df: DataFrame, column: str, per_mille: int, keep: DataFrame | None = None) -> DataFrame:
    """Rows whose CRC-32 falls in the share, and all rows in ``keep`` (one column of the same name)."""
    small = F.crc32(F.col(column)) % 100_000 < per_mille * 100
    if keep is None:
        return df.where(small)
    mark = keep.select(column).distinct().withColumn("__keep", F.lit(True))
    return df.join(mark, column, "left").where(small | F.col("__keep")).drop("__keep")


def balanced(scored: DataFrame, per_positive: float = 2.0, most: int = 20_000, seed: int = 42) -> DataFrame:
    """Positives and ``per_positive`` negatives each, at most ``most`` rows, by hash of the pair."""
    key = scored.withColumn("__k", F.concat_ws("|", "s1_id", "cand_id"))
    n = {r["label"]: r["count"] for r in scored.groupBy("label").count().collect()}
    n_pos = min(n.get(1, 0), int(most / (1 + per_positive)))
    n_neg = min(n.get(0, 0), int(n_pos * per_positive), most - n_pos)
    part = lambda y, k: hash_sample(key.where(F.col("label") == y), "__k", k, seed)
    return part(1, n_pos).unionByName(part(0, n_neg)).drop("__k")


def train_band(scored: DataFrame, low: float = 0.05, high: float = 0.95, confident: float = 0.1, **caps) -> DataFrame:
    """Uncertain pairs and a tenth as many confident ones, balanced, with ``band``."""
    inside = F.col("p").between(low, high)
    band = scored.where(inside).withColumn("band", F.lit(1))
    rest = scored.where(~inside).withColumn("band", F.lit(0)).withColumn("__k", F.concat_ws("|", "s1_id", "cand_id"))
    return balanced(band.unionByName(hash_sample(rest, "__k", int(confident * band.count())).drop("__k")), **caps)


def infer_band(scored: DataFrame, low: float = 0.1, high: float = 0.9, most: int | None = None) -> DataFrame:
    """Uncertain pairs, the least certain first."""
    out = scored.where(F.col("p").between(low, high)).orderBy(F.abs(F.col("p") - 0.5), "s1_id", "cand_id")
    return out.limit(most) if most else out


def queue(scored: DataFrame) -> DataFrame:
    """The order in which splits share a judge: by distance from one half, then split, then pair."""
    return scored.withColumn("depth", F.abs(F.col("p") - 0.5)).orderBy("depth", "split", "s1_id", "cand_id")


def common_depth(queue: DataFrame) -> DataFrame:
    """The distance from one half that every split was scored to; rows (split, p) of what was reached."""
    return queue.groupBy("split").agg(F.max(F.abs(F.col("p") - 0.5)).alias("d")).agg(F.min("d").alias("depth"))


def batches(triplets: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``layer`` and ``batch`` of each row: no S1 twice in a batch.  Layer t holds the t-th row of each S1."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "s1_id", "n_text", "p_text"))
    rows = triplets.withColumn("__k", key).withColumn("layer", F.row_number().over(Window.partitionBy("s1_id").orderBy("__k", "p_text")) - 1)
    n = rows.groupBy("layer").agg(F.ceil(F.count("*") / size).cast("int").alias("nb"))
    spread = F.pmod(F.xxhash64("s1_id", F.lit(seed)), F.col("nb")).cast("int")
    return rows.join(n, "layer").withColumn("batch", spread).drop("__k", "nb")
