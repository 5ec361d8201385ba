"""Pair features: blocking figures, string similarities, explanation of tokens, numbers, overlaps (108 columns)."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches as batches_
from ..functions import numbers, strings
from ..functions.text import tokens
from ..sources.stage import collected, written
from . import stats
from .blocking import CHANNELS

SPARSE = CHANNELS[2:9]
# Fields and scorers, in order.
SCORES = [("norm_name", s) for s in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "WRatio", "jw", "lev")]
SCORES += [("norm_addr", s) for s in ("ratio", "token_set_ratio", "jw", "lev")] + [(f, s) for f in ("fold_name", "fold_addr") for s in ("ratio", "jw")]
QUICK = [("norm_name", s) for s in ("ratio", "token_set_ratio", "jw", "lev")] + [("norm_addr", s) for s in ("ratio", "jw", "lev")] + [("fold_name", "ratio")]
# Names and order of the overlaps and flags.
OVERLAPS = [
    "name_tok_jacc", "name_idf_jacc", "name_c3_jacc", "addr_tok_jacc", "addr_idf_jacc", "addr_c3_jacc", "name_len_ratio", "addr_len_ratio", "addr_empty_1", "addr_empty_2",
    "has_postcode_1", "has_postcode_2", "landmark_1", "landmark_2", "landmark_jacc", "romanized_1", "romanized_2",
]
RECORD = ["country", "source", "norm_name", "fold_name", "norm_addr", "fold_addr", "name_numbers", "addr_numbers", "house_number", "postcodes", "landmark", "name_romanized"]


#: Tasks of a core, at least, that pairs with records are dealt out to.
TASKS = 4


def meta_names(channels: list[str] = SPARSE) -> list[str]:
    return [f"ch_{c}" for c in channels] + [f"{c}_score" for c in channels] + ["n_channels", "cheap_score", "cheap_rank", "cheap_gap", "n_cands", "is_S3"]


SCORE_NAMES = [f"{f}_{s}" for f, s in SCORES]
EXPLAIN = [f"{side}_{f}" for side in ("name", "addr") for f in strings.FIELD_FEATURES]
FEATURES = meta_names() + SCORE_NAMES + EXPLAIN + numbers.NUMBER_FEATURES + OVERLAPS


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def char_set(text: Column, n: int = 3) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(text) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.least(F.length(a), F.length(b)) / longest)


def meta(cands: DataFrame, channels: list[str] = SPARSE) -> DataFrame:
    """Blocking figures of candidate rows; missing channel columns count as missing scores."""
    w = Window.partitionBy("s1_id")
    order = w.orderBy(F.desc("cheap_score"), "cand_id")
    bit = lambda c: (F.col("bitmask").bitwiseAND(F.lit(1 << CHANNELS.index(c))) > 0).cast("int")
    have = [F.col(f"{c}_score") if f"{c}_score" in cands.columns else F.lit(None).cast("double").alias(f"{c}_score") for c in channels]
    return cands.select(
        "s1_id", "cand_id", *[bit(c).alias(f"ch_{c}") for c in channels], *have, "n_channels", "cheap_score", (F.row_number().over(order) - 1).alias("cheap_rank"),
        (F.col("cheap_score") - F.max("cheap_score").over(w)).alias("cheap_gap"), F.count("*").over(w).alias("n_cands"), F.col("cand_id").startswith("S3-").cast("int").alias("is_S3"),
    )


def with_records(pairs: DataFrame, s1: DataFrame, pool: DataFrame, checked: bool = False) -> DataFrame:
    """Pairs with both records' columns under the prefixes s_ and p_.

    Pairs of unknown ids go, or, if ``checked``, stop the query.  Pairs are dealt out by their pool record to a fixed number of tasks,
    as few bytes of them are much work.
    """
    side = lambda d, p, key: d.select(F.col("entity_id").alias(key), F.lit(True).alias(p + "known"), *[F.col(c).alias(p + c) for c in RECORD])
    out = pairs
    for d, p, key in ((s1, "s_", "s1_id"), (pool, "p_", "cand_id")):
        if key == "cand_id":
            out = out.repartition(max(TASKS * pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
        out = out.join(side(d, p, key), key, "left" if checked else "inner")
        if checked:
            stop = F.raise_error(F.concat(F.lit(f"unknown {key} "), F.coalesce(key, F.lit("null"))))
            out = out.withColumn(p + "source", F.when(F.col(p + "known"), F.col(p + "source")).otherwise(stop))
            out = out.withColumn(key, F.when(F.col(p + "source").isNotNull() | F.col(p + "known"), F.col(key)))
        out = out.drop(p + "known")
    return out


def scores(specs: list[tuple[str, str]] = SCORES) -> dict[str, Column]:
    return {f"{f}_{s}": strings.score(s, F.col(f"s_{f}"), F.col(f"p_{f}")) for f, s in specs}


def overlaps() -> dict[str, Column]:
    """Set overlaps and flags that need no IDF."""
    out = {}
    for side, field in (("name", "norm_name"), ("addr", "norm_addr")):
        a, b = F.col(f"s_{field}"), F.col(f"p_{field}")
        grams = jaccard(char_set(a), char_set(b))
        if side == "addr":  # unknown, not different, where one side is empty
            grams = F.when((a != "") & (b != ""), grams)
        out |= {f"{side}_tok_jacc": jaccard(tokens(a), tokens(b)), f"{side}_c3_jacc": grams, f"{side}_len_ratio": length_ratio(a, b)}
    flag = lambda c: c.cast("int")
    for i, p in ((1, "s_"), (2, "p_")):
        out |= {f"addr_empty_{i}": flag(F.col(p + "norm_addr") == ""), f"has_postcode_{i}": flag(F.col(p + "postcodes") != ""), f"landmark_{i}": flag(F.col(p + "landmark") != ""), f"romanized_{i}": flag(F.col(p + "name_romanized"))}
    a, b = F.col("s_landmark"), F.col("p_landmark")
    return out | {"landmark_jacc": F.when((a != "") & (b != ""), jaccard(tokens(a), tokens(b)))}


#: Text fields whose tokens carry weights.
FIELDS = {"name": "norm_name", "addr": "norm_addr"}


def token_weights(texts: DataFrame, token_stats: DataFrame, field: str) -> DataFrame:
    """id, country, ``field``_idf and ``field``_generic: arrays along the tokens of rows (id, country, ``field``).

    A record's tokens are weighed once for each country that asks, not once for each pair.
    """
    rows = texts.select("id", "country", F.posexplode(tokens(F.col(field))).alias("pos", "token"))
    w = stats.idf_rows(token_stats, field)
    unseen = w.where("token is null").select("country", F.col("idf").alias("unseen"))
    generic = stats.generic_tokens(token_stats).where(F.col("field") == field).select("token", F.lit(True).alias("generic"))
    rows = rows.join(w.where("token is not null"), ["country", "token"], "left").join(unseen, "country", "left").join(generic, "token", "left")
    weight = F.coalesce("idf", "unseen", F.lit(1.0)).alias("idf")
    usual = (F.coalesce("generic", F.lit(False)) | (F.col("token") == "&")).alias("generic")
    got = F.array_sort(F.collect_list(F.struct("pos", weight, usual)))
    return rows.groupBy("id", "country").agg(got.alias("at")).select("id", "country", F.col("at.idf").alias(f"{field}_idf"), F.col("at.generic").alias(f"{field}_generic"))


def with_weights(pairs: DataFrame, token_stats: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs with records and, for each field, the token weights of both sides under the S1's country.

    The distinct texts of a side and their weights are written: no plan holds the pairs' plan more than once, which bounds the
    memory of the driver.  A side's weights meet the pairs in one join.
    """
    out = pairs
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    for p, key in (("s_", "s1_id"), ("p_", "cand_id")):
        texts = pairs.select(F.col(key).alias("id"), F.col("s_country").alias("country"), *[F.col(p + f).alias(f) for f in fields]).dropDuplicates(["id", "country"])
        texts = written(texts, "texts")
        weights = None
        for f in fields:
            w = written(token_weights(texts.select("id", "country", f), token_stats, f), "weights")
            w = w.select(F.col("id").alias(key), F.col("country").alias("s_country"), F.col(f"{f}_idf").alias(f"{p}{f}_idf"), F.col(f"{f}_generic").alias(f"{p}{f}_generic"))
            weights = w if weights is None else weights.join(w, [key, "s_country"], "full")
        out = out.join(weights, [key, "s_country"], "left")
        for f in fields:
            out = out.withColumns({f"{p}{f}_idf": none(F.col(f"{p}{f}_idf"), "double"), f"{p}{f}_generic": none(F.col(f"{p}{f}_generic"), "boolean")})
    return out


def idf_jaccard(field: str) -> Column:
    """Share of the IDF of both sides' distinct tokens that common ones hold; null where there are none."""
    a, b = tokens(F.col(f"s_{field}")), tokens(F.col(f"p_{field}"))
    worth = lambda ts, w: F.array_distinct(F.arrays_zip(ts.alias("t"), F.col(w).alias("w")))
    x, y = worth(a, f"s_{field}_idf"), worth(b, f"p_{field}_idf")
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["w"])
    every = F.concat(x, F.filter(y, lambda r: ~F.array_contains(a, r["t"])))
    return F.when(F.size(every) > 0, total(F.filter(x, lambda r: F.array_contains(b, r["t"]))) / total(every))


#: What the Arrow pass works out for each pair.
PYTHON = SCORE_NAMES + EXPLAIN + [f"{side}_{s}_jacc" for side in FIELDS for s in ("tok", "c3", "idf")]
#: Pairs that are scored at once.
TOGETHER = 5_000


def _figures(names: list[str], kept: list[str]):
    """Scores, explanations and overlaps of batches of pairs with weights; ``kept`` columns go through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the held texts are many objects, which whole collections would visit again and again
        try:
            yield from figures(batches)
        finally:
            gc.enable()

    def figures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            out: dict[str, Iterable] = {}
            for field in dict.fromkeys(f for f, _ in SCORES):
                keys = list(zip(col(f"s_{field}"), col(f"p_{field}"), strict=True))
                once = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                at = np.fromiter((once[k] for k in keys), np.int64, len(keys))
                left, right = [x for x, _ in once], [y for _, y in once]
                out |= {f"{field}_{s}": v[at] for s, v in batches_.all_scores(left, right, [s for f, s in SCORES if f == field]).items()}
                for side in (s for s, f in FIELDS.items() if f == field):
                    x, y = [batches_.seen(t) for t in left], [batches_.seen(t) for t in right]
                    grams = batches_.gram_jaccard(left, right)
                    if side == "addr":  # unknown, not different, where one side is empty
                        grams[[not a or not b for a, b in once]] = np.nan
                    out |= {f"{side}_tok_jacc": batches_.token_jaccard(x, y)[at], f"{side}_c3_jacc": grams[at]}
                    al, places = batches_.alignments(x, y), at.tolist()
                    idf, usual = (list(zip(col(f"s_{field}_{w}"), col(f"p_{field}_{w}"), strict=True)) for w in ("idf", "generic"))
                    rows = np.array([strings.field_figures(al[k], *own) for k, *own in zip(places, idf, usual, strict=True)], float)
                    out |= {f"{side}_{n}": rows[:, i] for i, n in enumerate(strings.FIELD_FEATURES)}
                    out[f"{side}_idf_jacc"] = np.array([batches_.idf_jaccard(x[k].tokens, y[k].tokens, w) for k, w in zip(places, idf, strict=True)], float)
            through = [b.column(b.schema.get_field_index(c)) for c in kept]
            gc.collect(1)
            yield pa.record_batch([*through, *[pa.array(out[n], pa.float64(), from_pandas=True) for n in names]], names=[*kept, *names])

    return run


def text_features(pairs: DataFrame, token_stats: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """All features but the blocking figures, of pairs with records; ``kept`` columns stay in front.

    Expressions run in the JVM; one Arrow pass adds the scores, the token overlaps and the alignment, distinct texts of a batch once.
    The pairs are written, as their texts are read again for each side's weights.
    """
    kept = ["s1_id", "cand_id", *(kept or [])]
    collected(pairs.sparkSession)
    rows = with_weights(written(pairs, "pairs"), token_stats, list(FIELDS.values()))
    collected(pairs.sparkSession)
    own = {n: c for n, c in (numbers.number_features() | overlaps()).items() if n not in PYTHON}
    through = rows.select(*kept, *[c.cast("float").alias(n) for n, c in own.items()], *[p + f for f in dict.fromkeys(f for f, _ in SCORES) for p in ("s_", "p_")], *[f"{p}{f}_{w}" for f in FIELDS.values() for p in ("s_", "p_") for w in ("idf", "generic")])
    stay = [*kept, *own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in through.schema.fields if f.name in stay) + ", " + ", ".join(f"`{n}` double" for n in PYTHON)
    return through.mapInArrow(_figures(PYTHON, stay), schema)


def pair_features(cands: DataFrame, s1: DataFrame, pool: DataFrame, token_stats: DataFrame, channels: list[str] = SPARSE) -> DataFrame:
    """s1_id, cand_id and the features as floats.  A candidate whose id is in neither table is an error, not a lost row."""
    known, names = meta_names(channels), FEATURES[len(meta_names()) :]
    figures = meta(cands, channels)
    out = text_features(with_records(figures, s1, pool, checked=True), token_stats, known)
    return out.select("s1_id", "cand_id", *[F.col(n).cast("float").alias(n) for n in known + names])


def delta_features(cands: DataFrame, earlier: DataFrame, s1: DataFrame, pool: DataFrame, token_stats: DataFrame, channels: list[str] = SPARSE) -> DataFrame:
    """Like :func:`pair_features`; text features of pairs in ``earlier`` are reused, only new pairs are computed.

    The result has a row for each candidate, which is asserted: an earlier table with repeated pairs stops the query.
    """
    names = FEATURES[len(meta_names()) :]
    keys = ["s1_id", "cand_id"]
    cands, earlier = written(cands, "cands"), written(earlier, "earlier")
    collected(cands.sparkSession)
    old = earlier.select(*keys, *names).join(cands.select(*keys), keys, "left_semi")
    fresh = text_features(with_records(cands.select(*keys).join(earlier.select(*keys), keys, "left_anti"), s1, pool, checked=True), token_stats)
    text = old.unionByName(written(fresh.select(*keys, *[F.col(n).cast("float").alias(n) for n in names]), "fresh"))
    collected(cands.sparkSession)
    many, wanted = text.count(), cands.count()
    if many != wanted:
        raise ValueError(f"{many} rows of text features for {wanted} candidates")
    return meta(cands, channels).join(text, keys).select(*keys, *[F.col(n).cast("float").alias(n) for n in meta_names(channels) + names])
