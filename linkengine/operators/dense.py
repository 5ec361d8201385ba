"""Exact nearest neighbours of dense vectors inside groups, recall figures and training triplets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocking import DIGITS, ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


#: Queries and pool rows of a group that meet in one task.
BLOCK = 2048


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties to the smaller id; columns are in the order of ids."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _kernel(k: int, reverse_k: int, schema: pa.Schema):
    """Rows (forward, s1_id, cand_id, score): of each block pair the k best pool rows of each query and the other way round."""

    def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = t.column("asks").to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, bool)
        sides = []
        for own in (np.flatnonzero(asks), np.flatnonzero(~asks)):
            part = t.take(pa.array(own))
            part = part.take(pc.sort_indices(part, sort_keys=[("id", "ascending")]))
            vecs = part.column("vec").combine_chunks()
            sides.append((part.column("id").combine_chunks(), np.asarray(vecs.flatten(), np.float64).reshape(len(vecs), -1)))
        (q, x), (p, y) = sides
        if not len(q) or not len(p):
            return
        scores = np.round(x @ y.T, DIGITS) + 0.0
        for forward, best in ((True, _best(scores, k)), (False, _best(scores.T, reverse_k))):
            row, at = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
            i, j = (row, at) if forward else (at, row)
            yield pa.record_batch([pa.array(np.full(len(i), forward)), q.take(pa.array(i)), p.take(pa.array(j)), pa.array(scores[i, j])], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = list(zip(*[b.column(c).to_pylist() for c in ("grp", "qb", "pb")], strict=True))
            a = 0
            for i in range(1, len(key) + 1):
                if i == len(key) or key[i] != key[a]:
                    if key[a] != last and held:
                        yield from met(pa.Table.from_batches(held))
                        held = []
                    last = key[a]
                    held.append(b.slice(a, i - a))
                    a = i
        if held:
            yield from met(pa.Table.from_batches(held))

    return run


def block_hits(queries: DataFrame, pool: DataFrame, k: int, reverse_k: int) -> DataFrame:
    """Rows (forward, s1_id, cand_id, score) of the block pairs of each group; rows (id, grp, vec) on both sides.

    A group is cut into blocks of about ``BLOCK`` rows a side; each block pair is one matrix product and leaves the best of
    each of its rows, never its pairs.  Vectors must have one length within a group.
    """
    count = lambda d, n: d.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    blocks = count(queries, "nq").join(count(pool, "np"), "grp")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    q = queries.join(blocks, "grp").select("id", "grp", vec, F.lit(True).alias("asks"), own("nq").alias("qb"), every("np").alias("pb"))
    p = pool.join(blocks, "grp").select("id", "grp", vec, F.lit(False).alias("asks"), own("np").alias("pb"), every("nq").alias("qb"))
    rows = q.unionByName(p).repartition("grp", "qb", "pb").sortWithinPartitions("grp", "qb", "pb")
    kinds = dict(queries.dtypes)["id"], dict(pool.dtypes)["id"]
    out = T.StructType.fromDDL(f"forward boolean, s1_id {kinds[0]}, cand_id {kinds[1]}, score double")
    return rows.mapInArrow(_kernel(k, reverse_k, to_arrow_schema(out)), out)


def knn(queries: DataFrame, pool: DataFrame, k: int = 30, reverse_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(k best pool rows of each query, reverse_k best queries of each pool row), exact."""
    hits = block_hits(queries, pool, k, reverse_k)
    one = lambda forward: hits.where(F.col("forward") == forward).drop("forward")
    return ranked(one(True), "s1_id", "cand_id", k), ranked(one(False), "cand_id", "s1_id", reverse_k)


def pair_cosine(union: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """``dense_cos`` of every pair of a union table; rows (id, vec) on both sides."""
    q, p = queries.select(F.col("id").alias("s1_id"), F.col("vec").alias("__q")), pool.select(F.col("id").alias("cand_id"), F.col("vec").alias("__p"))
    return union.join(q, "s1_id", "left").join(p, "cand_id", "left").withColumn("dense_cos", dot(F.col("__q"), F.col("__p"))).drop("__q", "__p")


def dense_channels(queries: DataFrame, pool: DataFrame, k: int = 30, reverse_k: int = 5) -> DataFrame:
    """Both directions as hits of one channel."""
    forward, back = knn(queries, pool, k, reverse_k)
    both = forward.unionByName(back.select(forward.columns))
    return both.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank")).withColumn("channel", F.lit("dense"))


def approximate_knn(queries: DataFrame, pool: DataFrame, k: int = 30, length: float = 0.6, tables: int = 8, within: float = 1.0) -> DataFrame:
    """Candidates by random projections for groups too large for all pairs; unit vectors, ``within`` is a Euclidean distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    side = lambda d: d.where("grp is not null").select("id", "grp", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    q, p = side(queries), side(pool)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=length, numHashTables=tables, seed=42).fit(p)
    near = model.approxSimilarityJoin(q, p, within, "d").where("datasetA.grp = datasetB.grp")
    rows = near.select(F.col("datasetA.id").alias("s1_id"), F.col("datasetB.id").alias("cand_id"), F.round(1 - F.col("d") * F.col("d") / 2, DIGITS).alias("score"))
    return ranked(rows, "s1_id", "cand_id", k)


def recall(ranked_rows: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 10, 30)) -> DataFrame:
    """Share of true pairs within each rank, and the mean reciprocal rank."""
    hit = truth.select("s1_id", "cand_id").distinct().join(ranked_rows.select("s1_id", "cand_id", "rank"), ["s1_id", "cand_id"], "left")
    at = [F.avg(F.coalesce((F.col("rank") < k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return hit.agg(F.count("*").alias("n_pairs"), *at, F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"))


def sanity_cosines(queries: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """Quantiles of true pairs' cosines and of pairs rotated by one place in hash order."""
    q, p = queries.select(F.col("id").alias("s1_id"), F.col("vec").alias("vq")), pool.select(F.col("id").alias("cand_id"), F.col("vec").alias("vp"))
    pairs = truth.select("s1_id", "cand_id").join(q, "s1_id").join(p, "cand_id")
    order = Window.partitionBy(F.pmod(F.xxhash64("s1_id"), F.lit(64))).orderBy(F.xxhash64("cand_id"))
    rows = pairs.select(dot(F.col("vq"), F.col("vp")).alias("true_cos"), dot(F.col("vq"), F.lag("vp").over(order)).alias("random_cos"))
    return rows.agg(F.percentile("true_cos", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("true_q"), F.percentile("random_cos", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("random_q"))


def triplets(anchors: DataFrame, truth: DataFrame, pool: DataFrame, neighbours: DataFrame, hard: int = 3, siblings: float = 0.25, seed: int = 42) -> DataFrame:
    """s1_id, a_text, p_text, n_text, n_owner: each match with one of the S1's ``hard`` nearest wrong rows, and sibling matches.

    anchors (s1_id, text), pool (cand_id, text, owner), neighbours (s1_id, cand_id, rank).
    """
    draw = lambda *c: F.md5(F.concat_ws("|", F.lit(seed), *c))
    wrong = neighbours.join(truth, ["s1_id", "cand_id"], "left_anti")
    near = wrong.withColumn("r", F.row_number().over(Window.partitionBy("s1_id").orderBy("rank", "cand_id"))).where(f"r <= {max(3 * hard, 10)}")
    some = near.withColumn("t", F.row_number().over(Window.partitionBy("s1_id").orderBy(draw("s1_id", "cand_id"))) - 1).where(f"t < {hard}")
    negs = some.join(pool, "cand_id").select("s1_id", "t", F.col("text").alias("n_text"), F.col("owner").alias("n_owner"))
    many = negs.groupBy("s1_id").agg(F.count("*").alias("n_neg"))
    w = Window.partitionBy("s1_id").orderBy("cand_id")
    match = truth.join(pool.select("cand_id", F.col("text").alias("p_text")), "cand_id").withColumn("i", F.row_number().over(w) - 1)
    base = match.join(many, "s1_id").withColumn("t", F.col("i") % F.col("n_neg")).join(negs, ["s1_id", "t"])
    out = base.join(anchors.select("s1_id", F.col("text").alias("a_text")), "s1_id").select("s1_id", "a_text", "p_text", "n_text", "n_owner")
    chosen = F.conv(F.substring(draw("s1_id"), 1, 8), 16, 10).cast("double") / 4294967296.0 < 2 * siblings
    pair = match.withColumn("next", F.lead("p_text").over(w)).where(F.col("next").isNotNull() & (F.col("i") == 0) & chosen)
    sib = pair.join(negs.where("t = 0"), "s1_id").select("s1_id", F.col("p_text").alias("a_text"), F.col("next").alias("p_text"), "n_text", "n_owner")
    return out.unionByName(sib)


def field_dropout(text: Column, key: Column, rate: float = 0.5) -> Column:
    """One side of ``name | address`` texts, chosen by hash."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(~text.contains(" | "), text).when(u < rate, F.substring_index(text, " | ", 1)).otherwise(F.substring_index(text, " | ", -1))
