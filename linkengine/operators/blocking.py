"""Candidate generation: sparse top-k joins over channel keys, their union, gaps, pruning and the blocking report.

Both sides of a channel are rows of features and weights.  They meet by (group, feature) in blocks, as products of sparse
matrices whose pairs never leave a task; pool features above ``max_df`` are filtered before, which bounds the work of a feature.
Scores are rounded before they are ranked and ties go to the smaller id, so that a result does not depend on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import keys
from ..sources.stage import written

# Bit i of a mask is channel i.
CHANNELS = ["dense", "reverse", "name_char", "addr_char", "name_tok", "num_key", "name_pair", "addr_pair", "cross_pair", "translit_name", "translit_addr"]
NO_RANK = 999
DIGITS = 6
#: Channels whose jobs are submitted at once.
SIDE_BY_SIDE = 4
#: Queries, pool rows and postings of a side that meet in one task, about; postings and pairs of a step there.
QUERIES, POOL, POSTINGS, STEP = 4096, 16384, 1 << 20, 1 << 19


@dataclass(frozen=True)
class Channel:
    name: str
    keys: Callable[[], Column]
    k: int
    max_df: int
    #: Rows whose key array is long where another column is empty get this many instead.
    boost: tuple[str, int] | None = None


def _key(column: Column) -> Column:
    return F.filter(F.array(column), lambda x: x != "")


SPARSE = [
    Channel("name_char", lambda: keys.char_grams(F.col("norm_name")), 20, 2000),
    Channel("addr_char", lambda: keys.char_grams(F.col("norm_addr")), 15, 2000),
    Channel("name_tok", lambda: keys.name_tokens(F.col("norm_name"), F.col("fold_name")), 20, 200),
    Channel("num_key", lambda: _key(keys.num_key(F.col("norm_addr"), F.col("house_number"))), 20, 200),
    Channel("name_pair", lambda: keys.pair_keys(F.col("fold_name"), keys.NAME_PAIR), 30, 2000),
    Channel("addr_pair", lambda: keys.pair_keys(F.col("fold_addr"), keys.ADDR_PAIR), 30, 2000),
    Channel("cross_pair", lambda: keys.cross_keys(F.col("fold_name"), F.col("fold_addr")), 30, 2000),
]


def translit_channels(name: str = "translit_name", addr: str = "translit_addr") -> list[Channel]:
    """Channels over transliterated text columns; a record whose other field is empty gets more candidates, in one pass."""
    return [
        Channel("translit_name", lambda: keys.char_grams(F.col(name)), 20, 2000, ("norm_addr", 40)),
        Channel("translit_addr", lambda: keys.char_grams(F.col(addr)), 20, 2000, ("norm_name", 40)),
    ]


#: Figures of a union row that the pre-ranker reads; those of absent channels count as missing.
PRUNE_FEATURES = ["dense_cos", "dense_cos_gap", "dense_rank", "reverse_rank", "reverse_score", "num_key_score", "n_channels", "union_size"]
PRUNE_FEATURES += [f"{c}_{f}" for c in ("name_char", "addr_char", "name_tok", "name_pair", "addr_pair", "cross_pair", "translit_name", "translit_addr") for f in ("score", "rank", "score_gap")]


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def weighted_postings(queries: DataFrame, pool: DataFrame, max_df: int) -> DataFrame:
    """side (0 for queries), grp, id, feats, ws of rows (id, grp, keys): weights of unit length for each id.

    Document frequency and the number of rows count both sides, rows without keys included, and so do the lengths all features.
    Of the arrays only features stay that can meet: not above ``max_df`` and on both sides.  ``feats`` are numbers of them.
    """
    both = queries.select(F.lit(0).alias("side"), "id", "grp", "keys").unionByName(pool.select(F.lit(1).alias("side"), "id", "grp", "keys"))
    rows = written(both.select("side", "id", "grp", counted(F.col("keys")).alias("feats")), "postings")
    n = rows.groupBy("grp").agg(F.count("*").alias("n"))
    posts = rows.select("side", "id", "grp", F.inline("feats"))
    # counted before it is joined: a feature that all rows have costs a row for each task, and its join is split as skewed
    df = posts.groupBy("grp", "feat").agg(F.count("*").alias("df"), F.min("side").alias("low"), F.max("side").alias("high")).join(n, "grp")
    meets = (F.col("low") < F.col("high")) & (F.col("df") <= max_df)
    # written: the numbers must not change when a task is repeated
    df = written(df.select("grp", "feat", idf(F.col("n"), F.col("df")).alias("idf"), F.when(meets, F.monotonically_increasing_id()).alias("code")), "features")
    posts = posts.join(df, ["grp", "feat"]).withColumn("w", (1 + F.log("c")) * F.col("idf"))
    # a record's postings come together once, for their length; collect_list leaves nulls out
    own = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "w")))
    whole = posts.groupBy("side", "id", "grp").agg(own.alias("own"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where(F.size("own") > 0)
    return written(whole.select("side", "grp", "id", F.col("own.code").alias("feats"), F.transform("own.w", lambda w: w / F.col("norm")).alias("ws")), "weighted")


def counted(keys_: Column) -> Column:
    """Structs (feat, c) of the distinct keys of an array and how often it holds them, by sorting it."""
    heads = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda at, a: F.transform(at, lambda i, k: F.struct(F.get(a, i).alias("feat"), (F.coalesce(F.get(at, k + 1), F.size(a)) - i).cast("long").alias("c")))
    # arrays of one element hold what lambdas read: an expression inside a lambda, such as the sort, runs for each of its elements
    parts = F.transform(F.array(F.array_sort(keys_)), lambda s: F.struct(heads(s).alias("at"), s.alias("a")))
    return F.when(F.size(keys_) > 0, F.element_at(F.transform(parts, lambda x: runs(x["at"], x["a"])), 1))


def ranked(scores: DataFrame, by: str, other: str, k: Column | int) -> DataFrame:
    """The k best rows of each ``by`` with ``rank`` from 0."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _sums(q: np.ndarray, f: np.ndarray, w: np.ndarray, ptr: np.ndarray, rows: np.ndarray, ws: np.ndarray, nq: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(q * n + row, sum of products) of the pairs that share a feature; the pool's rows of feature f lie at ptr[f] to ptr[f + 1]."""
    many = ptr[f + 1] - ptr[f]
    at = np.repeat(ptr[f] - np.cumsum(many) + many, many) + np.arange(many.sum())
    pair, product = np.repeat(q * n, many) + rows[at], np.repeat(w, many) * ws[at]
    if 8 * len(pair) > nq * n:
        dense = np.bincount(pair, product, nq * n)
        pair = np.flatnonzero(dense)
        return pair, dense[pair]
    pair, back = np.unique(pair, return_inverse=True)
    return pair, np.bincount(back, product, len(pair))


def _best(pair: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the k best of each query among pairs in order; ties go to the smaller row."""
    if not len(pair):
        return pair
    q, key = pair // n, score * n + (n - 1 - pair % n)
    first, out = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), []
    for a, b in zip(first, np.r_[first[1:], len(q)], strict=True):
        out.append(a + (np.argpartition(key[a:b], b - a - k)[b - a - k :] if b - a > k else np.arange(b - a)))
    return np.concatenate(out)


def _flat(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, and of each posting the place of its id, its feature and its weight)."""
    t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_start"))
    feats, ws = t.column("feats").combine_chunks(), t.column("ws").combine_chunks()
    many = np.asarray(pc.list_value_length(feats), np.int64)
    return t.column("id").combine_chunks(), np.repeat(np.arange(len(many)), many), np.asarray(feats.flatten(), np.int64), np.asarray(ws.flatten(), np.float64)


def _meet(k: int, schema: pa.Schema) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Rows (s1_id, cand_id, score): the k best pool rows of each query of a block pair."""

    def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = pc.equal(t.column("side"), 0)
        queries, pool = t.filter(asks), t.filter(pc.invert(asks))
        if not queries.num_rows or not pool.num_rows:
            return
        (q_ids, q, qf, qw), (p_ids, p, pf, pw) = _flat(queries), _flat(pool)
        names, pf = np.unique(pf, return_inverse=True)
        order = np.argsort(pf, kind="stable")
        p, pw, ptr = p[order], pw[order], np.r_[0, np.cumsum(np.bincount(pf, minlength=len(names)))]
        qf_at = np.minimum(np.searchsorted(names, qf), len(names) - 1)
        known = names[qf_at] == qf
        q, qf, qw = q[known], qf_at[known], qw[known]
        # queries go in steps whose postings and dense rows are bounded
        n, ends = len(p_ids), np.searchsorted(q, np.arange(len(q_ids) + 1))
        cost = np.r_[0, np.cumsum(ptr[qf + 1] - ptr[qf])][ends] + np.arange(len(q_ids) + 1) * n
        a = 0
        while a < len(q_ids):
            b = max(a + 1, int(np.searchsorted(cost, cost[a] + STEP, "right")) - 1)
            x = slice(ends[a], ends[b])
            pair, score = _sums(q[x] - a, qf[x], qw[x], ptr, p, pw, b - a, n)
            score = np.floor(score * 10**DIGITS + 0.5).astype(np.int64)
            own = _best(pair, score, n, k)
            yield pa.record_batch([q_ids.take(pa.array(a + pair[own] // n)), p_ids.take(pa.array(pair[own] % n)), pa.array(score[own] / 10**DIGITS)], schema=schema)
            a = b

    return met


def by_block(met: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``met`` on the rows of each (grp, qb, pb) of sorted batches."""

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


def sparse_topk(queries: DataFrame, pool: DataFrame, k: int, max_df: int) -> DataFrame:
    """s1_id, cand_id, score, rank of the k most similar pool rows of each query; rows (id, grp, keys) on both sides.

    Each group is cut into blocks; a block pair is a sparse matrix product in one task and leaves the k best of its queries,
    never its pairs.
    """
    rows = weighted_postings(queries, pool, max_df)
    blocks = lambda side, most: F.ceil(F.greatest(F.sum((F.col("side") == side).cast("long")) / most, F.sum(F.when(F.col("side") == side, F.size("feats"))) / POSTINGS)).cast("int")
    sizes = rows.groupBy("grp").agg(blocks(0, QUERIES).alias("nq"), blocks(1, POOL).alias("np")).where("nq > 0 and np > 0")
    own = lambda side, n: F.when(F.col("side") == side, F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    cells = rows.join(sizes, "grp").withColumn("qb", F.explode(own(0, "nq"))).withColumn("pb", F.explode(own(1, "np"))).select("side", "grp", "qb", "pb", "id", "feats", "ws")
    kinds = dict(queries.dtypes)["id"], dict(pool.dtypes)["id"]
    out = T.StructType.fromDDL(f"s1_id {kinds[0]}, cand_id {kinds[1]}, score double")
    hits = cells.repartition("grp", "qb", "pb").sortWithinPartitions("grp", "qb", "pb").mapInArrow(by_block(_meet(k, to_arrow_schema(out))), out)
    return ranked(hits, "s1_id", "cand_id", k)


def keyed(records: DataFrame, channel: Channel) -> DataFrame:
    return records.select(F.col("entity_id").alias("id"), F.col("country").alias("grp"), channel.keys().alias("keys"))


def channel_hits(s1: DataFrame, pool: DataFrame, channel: Channel) -> DataFrame:
    """Rows (channel, s1_id, cand_id, score, rank) of one channel."""
    q, p = keyed(s1, channel), keyed(pool, channel)
    if channel.boost is None:
        hits = sparse_topk(q, p, channel.k, channel.max_df)
    else:
        other, most = channel.boost
        few = s1.select(F.col("entity_id").alias("s1_id"), F.when(F.col(other) == "", most).otherwise(channel.k).alias("k"))
        hits = sparse_topk(q, p, max(most, channel.k), channel.max_df).join(few, "s1_id").where("rank < k").drop("k")
    return hits.select(F.lit(channel.name).alias("channel"), "s1_id", "cand_id", "score", "rank")


def reverse_hits(s1: DataFrame, pool: DataFrame, queried: DataFrame | None = None, k: int = 3, max_df: int = 2000) -> DataFrame:
    """Each pool row's k best S1 by name characters among all S1, kept where the S1 is queried."""
    channel = SPARSE[0]
    back = sparse_topk(keyed(pool, channel), keyed(s1, channel), k, max_df)
    hits = back.select(F.lit("reverse").alias("channel"), F.col("cand_id").alias("s1_id"), F.col("s1_id").alias("cand_id"), "score", "rank")
    return hits if queried is None else hits.join(queried, "s1_id", "left_semi")


def union_hits(hits: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """One row per pair: score and rank of each channel, bitmask and n_channels; the best score of a channel counts."""
    aggs = []
    for c in channels:
        own = F.col("channel") == c
        aggs += [F.max(F.when(own, F.col("score"))).alias(f"{c}_score"), F.coalesce(F.min(F.when(own, F.col("rank"))), F.lit(NO_RANK)).alias(f"{c}_rank")]
    bit = F.lit(0)
    for c in channels:
        bit = F.when(F.col("channel") == c, 1 << CHANNELS.index(c)).otherwise(bit)
    out = hits.groupBy("s1_id", "cand_id").agg(*aggs, F.bit_or(bit).alias("bitmask"))
    return out.withColumn("n_channels", F.bit_count("bitmask"))


def gaps(union: DataFrame, columns: list[str]) -> DataFrame:
    """Each score less the best of its S1 (missing ones count as -1 for the best and stay missing), and the S1's pairs."""
    w = Window.partitionBy("s1_id")
    out = {f"{c}_gap": F.col(c) - F.max(F.coalesce(F.col(c), F.lit(-1.0))).over(w) for c in columns}
    return union.withColumns(out | {"union_size": F.count("*").over(w)})


def prune(union: DataFrame, score: str, top: int) -> DataFrame:
    """The ``top`` best pairs of each S1 as ``cheap_score``, with cheap_rank."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("cheap_score"), "cand_id")
    out = union.withColumn("cheap_score", F.col(score).cast("double")).withColumn("cheap_rank", F.row_number().over(w) - 1)
    return out.where(F.col("cheap_rank") < top)


def with_prune_features(union: DataFrame) -> DataFrame:
    """A union table with all of PRUNE_FEATURES: gaps are added, absent columns are missing."""
    have = [c for c in union.columns if c.endswith("_score") and c not in ("reverse_score", "num_key_score")] + ["dense_cos"] * ("dense_cos" in union.columns)
    out = gaps(union, have)
    return out.withColumns({c: F.lit(None).cast("double") for c in PRUNE_FEATURES if c not in out.columns})


def all_hits(s1: DataFrame, pool: DataFrame, channels: list[Channel] = SPARSE, reverse: bool = True) -> list[DataFrame]:
    """The hits of each channel, then the reverse ones.

    Channels are independent, so their jobs run side by side; each writes its hits, as one plan of all of them would fill the driver.
    """
    tasks = [lambda c=c: written(channel_hits(s1, pool, c), "hits") for c in channels] + [lambda: written(reverse_hits(s1, pool), "hits")] * reverse
    with ThreadPoolExecutor(SIDE_BY_SIDE) as threads:
        return list(threads.map(lambda task: task(), tasks))


def union(s1: DataFrame, pool: DataFrame, channels: list[Channel] = SPARSE, reverse: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """One row per pair that a channel, the reverse search or the rows of ``extra`` (dense lists) found."""
    hits = extra.select("channel", "s1_id", "cand_id", "score", "rank") if extra is not None else None
    for own in all_hits(s1, pool, channels, reverse):
        hits = own if hits is None else hits.unionByName(own)
    return union_hits(hits, [c.name for c in channels] + ["reverse"] * reverse + ["dense"] * (extra is not None))


def candidates(s1: DataFrame, pool: DataFrame, channels: list[Channel] = SPARSE, top: int = 50, reverse: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """Union of the channels, pruned by the number of channels that found a pair."""
    rows = union(s1, pool, channels, reverse, extra)
    names = [c.name for c in channels] + ["reverse"] * reverse + ["dense"] * (extra is not None)
    best = F.greatest(*[F.coalesce(F.col(f"{c}_score"), F.lit(0.0)) for c in names]) if len(names) > 1 else F.col(f"{names[0]}_score")
    return prune(gaps(rows, [f"{c}_score" for c in names]).withColumn("__s", F.col("n_channels") + best / 10), "__s", top).drop("__s")


def report(union: DataFrame, pruned: DataFrame, truth: DataFrame, queried: DataFrame, n_pool: int) -> DataFrame:
    """Blocking quality for ALL and for each country; ``queried`` has (s1_id, country), truth (s1_id, cand_id)."""
    true = truth.join(queried, "s1_id")
    per = lambda d, name: d.groupBy("s1_id").agg(F.count("*").alias(name))
    mark = true.select("s1_id", "cand_id").distinct()
    ids = queried.join(per(mark, "n_true"), "s1_id", "left").join(per(union, "n_union"), "s1_id", "left").join(per(pruned, "n_cands"), "s1_id", "left")
    ids = ids.join(per(union.join(mark, ["s1_id", "cand_id"], "left_semi"), "found_union"), "s1_id", "left").join(per(pruned.join(mark, ["s1_id", "cand_id"], "left_semi"), "found"), "s1_id", "left")
    ids = ids.na.fill(0, ["n_true", "n_union", "n_cands", "found_union", "found"])
    share = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 5)
    complete = F.avg(F.when(F.col("n_true") > 0, (F.col("found") == F.col("n_true")).cast("double")))
    aggs = [
        F.count("*").alias("n_s1"), F.sum("n_true").alias("n_true_pairs"), share("found_union", "n_true").alias("pair_recall_union"), share("found", "n_true").alias("pair_recall"),
        F.round(F.coalesce(complete, F.lit(1.0)), 5).alias("entity_complete_recall"), F.round(1 - F.sum("n_cands") / (F.count("*") * n_pool), 8).alias("reduction_ratio"),
        F.round(F.avg("n_cands"), 2).alias("cands_per_s1_mean"), F.round(F.percentile("n_cands", F.lit(0.95)), 4).alias("cands_per_s1_p95"),
    ]
    return ids.groupingSets([[], ["country"]], "country").agg(*aggs).withColumn("country", F.coalesce("country", F.lit("ALL")))


def channel_report(union: DataFrame, truth: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """For each channel the true pairs that it found, and those that no other channel found."""
    hit = union.join(truth.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_semi")
    bits = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(1 << CHANNELS.index(c)).alias("bit")) for c in channels])
    out = hit.select("bitmask", F.explode(bits).alias("b")).groupBy("b.channel").agg(
        F.sum((F.col("bitmask").bitwiseAND(F.col("b.bit")) > 0).cast("long")).alias("found"), F.sum((F.col("bitmask") == F.col("b.bit")).cast("long")).alias("unique")
    )
    return out


def miss_prior(truth: DataFrame, cands: DataFrame, ids: DataFrame) -> DataFrame:
    """Share of ids with a true match that is no candidate: the decoder's ``q``."""
    lost = truth.join(cands, ["s1_id", "cand_id"], "left_anti").select("s1_id").distinct().withColumn("lost", F.lit(1.0))
    return ids.join(lost, "s1_id", "left").agg(F.avg(F.coalesce("lost", F.lit(0.0))).alias("q"))


def missed_pairs(truth: DataFrame, cands: DataFrame, s1: DataFrame, pool: DataFrame, most: int = 200) -> DataFrame:
    """True pairs that are no candidates, with the raw fields; a report of the first ``most``."""
    side = lambda d, p: d.select(F.col("entity_id").alias(f"{p}_id"), F.col("raw_name").alias(f"{p}_name"), F.col("raw_addr").alias(f"{p}_addr"))
    gone = truth.join(cands, ["s1_id", "cand_id"], "left_anti")
    return gone.join(side(s1, "s1"), "s1_id").join(side(pool, "cand"), "cand_id").orderBy("s1_id", "cand_id").limit(most)
