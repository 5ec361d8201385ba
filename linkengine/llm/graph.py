"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


#: A node with more than this share of all edges, or more than ``LEAST`` edges, is hot.
SHARE, LEAST = 512, 256


def _joined(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their u in ``least`` (u, m, n).

    The rows of a hot u stay where they are: there are at most 2 * SHARE nodes with more than 2 * edges / SHARE of the
    2 * edges ends of edges, so that their part of ``least`` is broadcast within a proven bound.  All others are shuffled.
    """
    bound = max(LEAST, edges // SHARE)
    hot = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    cold = rows.join(hot.drop("m"), "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return rows.join(hot, "u").unionByName(cold)


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return _joined(both.where("v > u"), least, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = _joined(e, low, edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, store: Store, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs -> rows (id, comp): the smallest id reachable, for each id that has an edge.

    Self loops, repeated and reversed edges are allowed; an empty table gives an empty one.  Every round is written to the
    shared folder.  A table has settled when its count and two sums of 64-bit hashes stay; nothing else reaches the driver.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = store.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    mark = lambda d: tuple(d.agg(F.count("*"), total("u", "v"), total("v", F.lit(7), "u")).first())
    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        large = store.save(_large_star(e, last[0]), "large", 2 * last[0])
        new = store.save(_small_star(large, last[0]), "star", 2 * last[0])
        now = mark(new)
        store.drop(e)
        store.drop(large)
        e = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
