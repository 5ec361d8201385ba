"""Scores to decisions: sharpening, one owner per record, thresholds, expected-F decoding, calibration, metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA2 = 0.25
MAX_N, MIN_P = 20, 0.01
P_MIN, GAMMA = 0.05, 1.0


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def sharpen(p: Column, lam: float) -> Column:
    return p if lam == 1 else 1 / (1 + F.exp(-lam * logit(p)))


def hard_owner(pairs: DataFrame, p_min: float = P_MIN) -> DataFrame:
    """A record keeps the p of its best pair; its other pairs from ``p_min`` on get 0."""
    w = Window.partitionBy("cand_id").orderBy(F.desc("p"), "s1_id")
    lost = (F.col("p") >= p_min) & (F.row_number().over(w) > 1)
    return pairs.withColumn("p", F.when(lost, 0.0).otherwise(F.col("p")))


def soft_owner(pairs: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """p times the power of its share of the record's total."""
    total = F.sum("p").over(Window.partitionBy("cand_id"))
    return pairs.withColumn("p", F.when(total > 0, F.col("p") * F.pow(F.col("p") / total, gamma)).otherwise(0.0))


def owner(pairs: DataFrame, mode: str = "hard") -> DataFrame:
    return {"none": lambda d: d, "soft": soft_owner, "hard": hard_owner}[mode](pairs)


def threshold(pairs: DataFrame, t: float) -> DataFrame:
    return pairs.where(F.col("p") >= t).select("s1_id", "cand_id")


def fbeta(tp: Column, fn: Column, fp: Column) -> Column:
    """F-beta of counts; nothing to find and nothing found is 1."""
    return F.when((tp + fn + fp) == 0, 1.0).when(tp == 0, 0.0).otherwise((1 + BETA2) * tp / ((1 + BETA2) * tp + BETA2 * fn + fp))


def _pmf(ps: Column) -> Column:
    """Distribution of the number of successes, as an array from 0 on."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(ps, F.array(F.lit(1.0)), lambda acc, p: F.zip_with(F.concat(acc, zero), F.concat(zero, acc), lambda a, b: a * (1 - p) + b * p))


def expected_f(ps: Column, q: Column) -> Column:
    """Expected F-beta of returning the first k of the falling probabilities, for k = 0..n; q: a match was never a candidate."""

    def at(k: Column) -> Column:
        hits, rest = _pmf(F.slice(ps, F.lit(1), k)), _pmf(F.concat(F.slice(ps, k + 1, F.size(ps)), F.array(q)))
        score = lambda t, f: fbeta(t.cast("double"), f.cast("double"), (k - t).cast("double"))
        inner = lambda pt, t: F.aggregate(F.transform(rest, lambda pf, f: pt * pf * score(t, f)), F.lit(0.0), lambda s, x: s + x)
        return F.aggregate(F.transform(hits, inner), F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), F.size(ps)), at)


def decode(pairs: DataFrame, q: float | Column = 0.0, max_n: int = MAX_N, min_p: float = MIN_P) -> DataFrame:
    """s1_id, cand_id of the returned pairs: for each S1 the smallest k of the largest expected F among its best pairs.

    Only the ``max_n`` best pairs from ``min_p`` on take part, so that a row's array has a fixed bound.
    """
    w = Window.partitionBy("s1_id").orderBy(F.desc("p"), "cand_id")
    best = pairs.where(F.col("p") >= min_p).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_n)
    miss = q if isinstance(q, Column) else F.lit(float(q))
    one = best.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(F.col("r"), F.col("cand_id"), F.col("p")))).alias("xs"))
    e = F.transform(expected_f(F.transform("xs", lambda x: x["p"].cast("double")), miss), lambda v: F.round(v, 12))
    one = one.withColumn("e", e).withColumn("k", F.array_position("e", F.array_max("e")).cast("int") - 1)
    return one.select("s1_id", F.explode(F.slice("xs", F.lit(1), F.col("k"))).alias("x")).select("s1_id", "x.cand_id")


def pair_counts(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp of every id, with other columns of ``ids``."""
    keys = ["s1_id", "cand_id"]
    marks = pred.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(truth.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    pairs = marks.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    per = pairs.groupBy("s1_id").agg(F.sum("b").alias("n_true"), F.sum("a").alias("n_pred"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    return ids.join(per, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])


def entity_f(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    counts = pair_counts(pred, truth, ids)
    return counts.withColumn("f", fbeta(F.col("tp").cast("double"), (F.col("n_true") - F.col("tp")).cast("double"), (F.col("n_pred") - F.col("tp")).cast("double")))


def macro_f(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    return entity_f(pred, truth, ids).agg(F.avg("f").alias("macro_f05"), F.count("*").alias("n"))


def group_f(pred: DataFrame, truth: DataFrame, ids: DataFrame, group: str = "country") -> DataFrame:
    """ALL and each group: macro F, floor of empty answers, singleton accuracy, F of the others."""
    e = entity_f(pred, truth, ids)
    single = F.col("n_true") == 0
    aggs = [
        F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("macro_f05"), F.round(F.avg(single.cast("double")), 6).alias("floor"),
        F.round(F.avg(F.when(single, F.col("f"))), 6).alias("singleton_accuracy"), F.round(F.avg(F.when(~single, F.col("f"))), 6).alias("non_singleton_f05"),
    ]
    return e.groupingSets([[], [group]], group).agg(*aggs, F.grouping(group).alias("g")).withColumn(group, F.when(F.col("g") == 1, "ALL").otherwise(F.col(group).cast("string"))).drop("g")


def ece(scored: DataFrame, p: str = "p", y: str = "label", bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    per = scored.groupBy(b).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def auc_logloss(scored: DataFrame, group: str, p: str = "p", y: str = "label") -> DataFrame:
    """Exact AUC and log-loss for each group.

    Ranks come from counts of equal scores, not from a sort of all rows, and are summed in 1024 slices of the score's range,
    each of which starts after those before it, so that a group of many distinct scores is not one task.
    """
    label = F.col(y).cast("double")
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(label * F.log(clipped) + (1 - label) * F.log(1 - clipped))
    per = scored.groupBy(group, p).agg(F.count("*").alias("c"), F.sum(label).alias("pos"), F.sum(loss).alias("loss"))
    per = per.withColumn("__s", F.least(F.greatest(F.floor(F.col(p) * 1024), F.lit(-1)), F.lit(1024)))
    before = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = per.groupBy(group, "__s").agg(F.sum("c").alias("__n"))
    slices = slices.select(group, "__s", before("__n", Window.partitionBy(group).orderBy("__s")).alias("__before"))
    below = F.col("__before") + before("c", Window.partitionBy(group, "__s").orderBy(p))
    per = per.join(slices, [group, "__s"]).withColumn("rank_sum", F.col("pos") * (below + (F.col("c") + 1) / 2))
    tot = per.groupBy(group).agg(F.sum("c").alias("n"), F.sum("pos").alias("np"), F.sum("rank_sum").alias("rs"), F.sum("loss").alias("loss"))
    neg = F.col("n") - F.col("np")
    auc = F.when((F.col("np") > 0) & (neg > 0), (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * neg))
    return tot.select(group, "n", F.round(auc, 6).alias("auc"), F.round(F.col("loss") / F.col("n"), 6).alias("logloss"))


def fit_isotonic(scored: DataFrame, p: str = "p", y: str = "label") -> IsotonicRegressionModel:
    """Isotonic fit on one weighted row for each score, so that ties do not depend on the library."""
    rows = scored.groupBy(F.col(p).alias("p")).agg(F.avg(F.col(y).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    return IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(rows)


def breakpoints(model: IsotonicRegressionModel) -> tuple[list[float], list[float]]:
    return [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def fit_platt(scored: DataFrame, p: str = "p", y: str = "label") -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on the logit."""
    rows = scored.select(array_to_vector(F.array(logit(F.col(p)))).alias("x"), F.col(y).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y").fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def platt(p: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(slope * logit(p) + intercept)))


def interpolated(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear values between breakpoints, constant beyond them, without a model in the plan; found by bisection."""
    x, y = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        """The number of breakpoints up to p lies in lo..hi."""
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        return F.when(s["lo"] >= s["hi"], s).when(F.get(x, mid.cast("int")) <= p, span(mid + 1, s["hi"])).otherwise(span(s["lo"], mid))

    def valued(s: Column) -> Column:
        i = s["lo"]
        x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
        return F.when(i == 0, ys[0]).when(i >= len(xs), ys[-1]).otherwise(y0 + (p - x0) * (y1 - y0) / (x1 - x0))

    steps = F.sequence(F.lit(0), F.lit(len(xs).bit_length()))
    return F.when(p.isNotNull(), F.aggregate(steps, span(F.lit(0), F.lit(len(xs))), halved, valued))


def hash_fold(column: str, k: int, seed: int = 42) -> Column:
    """A fold of 0..k-1 by hash, the same in SQL engines with MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def crossfit_calibrated(scored: DataFrame, k: int = 2) -> DataFrame:
    """Every row calibrated by a fit on the other folds of its S1's hash."""
    folds = scored.withColumn("fold", hash_fold("s1_id", k))
    value = None
    for f in range(k):
        xs, ys = breakpoints(fit_isotonic(folds.where(F.col("fold") != f)))
        part = interpolated(F.col("p"), xs, ys)
        value = F.when(F.col("fold") == f, part) if value is None else value.when(F.col("fold") == f, part)
    return folds.withColumn("p", value).drop("fold")


def postprocess(pairs: DataFrame, lam: float = 1.3, mode: str = "hard", q: float = 0.0, t: float | None = None) -> DataFrame:
    """Sharpen, give each record one owner, then decode (or cut at ``t``)."""
    out = owner(pairs.withColumn("p", sharpen(F.col("p"), lam)), mode)
    return decode(out, q) if t is None else threshold(out, t)


def grid_search(pairs: DataFrame, truth: DataFrame, ids: DataFrame, lams=(0.7, 0.85, 1.0, 1.15, 1.3, 1.5), modes=("none", "hard"), qs=(0.0,), cuts=()) -> list[tuple[float, dict]]:
    """Settings by falling macro F; the input is read once for each setting, so pass a written table."""
    tried = [{"lam": a, "mode": m, "q": q} for a in lams for m in modes for q in qs] + [{"lam": 1.0, "mode": m, "t": t} for m in modes for t in cuts]
    out = [(macro_f(postprocess(pairs, **s), truth, ids).first()["macro_f05"], s) for s in tried]
    return sorted(out, key=lambda x: -x[0])


def bootstrap_diff(per_entity: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean difference of two systems' per-entity scores (columns a, b, s1_id) with its 5 and 95 % bounds.

    Poisson bootstrap: a row's weight in a round follows from a hash, so rows need not meet before they are summed.
    """
    u = (F.pmod(F.xxhash64("s1_id", "round", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.lit(0)
    total, term = 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        weight = F.when(u >= total, k).otherwise(weight)
        term /= k
    rows = per_entity.select("s1_id", (F.col("b") - F.col("a")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    rows = rows.withColumn("w", F.when(F.col("round") == 0, 1).otherwise(weight))  # round 0 is the sample itself
    means = rows.groupBy("round").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    drawn = F.when(F.col("round") > 0, F.col("m"))
    out = means.agg(F.max(F.when(F.col("round") == 0, F.col("m"))).alias("diff"), F.percentile(drawn, F.lit(0.05)).alias("low"), F.percentile(drawn, F.lit(0.95)).alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def error_buckets(pred: DataFrame, truth: DataFrame, cands: DataFrame, ids: DataFrame) -> DataFrame:
    """Every wrong S1 with its first cause and its counts; cands may carry name_sim and number_conflict."""
    keys = ["s1_id", "cand_id"]
    pred, truth = pred.select(*keys).distinct(), truth.select(*keys).distinct()
    pred, truth = pred.join(ids, "s1_id", "left_semi"), truth.join(ids, "s1_id", "left_semi")
    info = cands.select(*keys, *(F.col(c) if c in cands.columns else F.lit(None).cast("double").alias(c) for c in ("name_sim", "number_conflict")), F.lit(True).alias("known"))
    owners = pred.groupBy("cand_id").agg(F.count("*").alias("n_owners"), F.min("s1_id").alias("some_owner"))
    rows = truth.withColumn("t", F.lit(True)).join(pred.withColumn("h", F.lit(True)), keys, "full").na.fill(False, ["t", "h"]).where("t <> h")
    rows = rows.join(info, keys, "left").join(owners, "cand_id", "left")
    fp, fn = F.col("h"), F.col("t")
    other = F.coalesce((F.col("n_owners") > 1) | (F.col("some_owner") != F.col("s1_id")), F.lit(False))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    per = rows.groupBy("s1_id").agg(
        F.sum(fp.cast("long")).alias("n_fp"), F.sum(fn.cast("long")).alias("n_fn"), F.sum((fn & F.col("known").isNull()).cast("long")).alias("n_miss_blocking"),
        flag(other).alias("multi"), flag(fp & (F.col("name_sim") >= 85) & (F.col("number_conflict") > 0)).alias("chain"), flag(fn & (F.col("name_sim") < 70)).alias("noise"),
    )
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    bucket = (
        F.when(F.col("n_true").isNull(), "false_match_on_singleton").when(F.col("n_miss_blocking") > 0, "blocking_miss").when(F.col("multi"), "multi_claim_conflict")
        .when(F.col("chain"), "chain_branch").when(F.col("noise"), "heavy_noise").otherwise("other")
    )
    return per.join(n_true, "s1_id", "left").select("s1_id", bucket.alias("bucket"), "n_fp", "n_fn", "n_miss_blocking")


def error_examples(scored: DataFrame, pred: DataFrame, truth: DataFrame, s1: DataFrame, pool: DataFrame, most: int = 50, seed: int = 42) -> DataFrame:
    """kind (missed or wrong), s1_id, cand_id, p and the raw fields of ``most`` errors of each kind, by hash; a report."""
    keys = ["s1_id", "cand_id"]
    lost = truth.select(*keys).join(pred.select(*keys), keys, "left_anti").withColumn("kind", F.lit("missed"))
    extra = pred.select(*keys).join(truth.select(*keys), keys, "left_anti").withColumn("kind", F.lit("wrong"))
    pair = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    w = Window.partitionBy("kind").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), pair)), *keys)
    some = lost.unionByName(extra).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
    side = lambda d, p, k: d.select(F.col("entity_id").alias(k), F.col("raw_name").alias(f"{p}_raw_name"), F.col("raw_addr").alias(f"{p}_raw_addr"))
    out = some.join(scored.select(*keys, "p"), keys, "left").join(side(s1, "s", "s1_id"), "s1_id").join(side(pool, "p", "cand_id"), "cand_id")
    return out.select("kind", *keys, "p", "s_raw_name", "s_raw_addr", "p_raw_name", "p_raw_addr")
