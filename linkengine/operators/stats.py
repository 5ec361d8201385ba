"""Token statistics of records: document frequency, positional counts, IDF, likeness scores, generic tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

NAME_FIELDS = ("norm_name", "fold_name")
ADDR_FIELDS = ("norm_addr", "fold_addr")
TYPE_WINDOW = 3
GENERIC_DF, NAME_END, STREET_TYPE = 1000, 0.7, 0.5


def token_counts(records: DataFrame, field: str) -> DataFrame:
    """field, country, token, df, pos_count of rows (country, field): a record counts once in df, each place in pos_count.

    A name token's place counts in the last two; an address token's one to three places after the first token with a digit.
    Positions are found inside the row, so that one partial and final aggregation is all the shuffle there is.
    """
    words = tokens(F.col(field))
    at = F.transform(words, lambda t, i: F.struct(t.alias("token"), i.alias("pos"), F.size(words).alias("n")))
    row = records.select("country", at.alias("at"))
    if field in NAME_FIELDS:
        hit = lambda x: x["pos"] >= x["n"] - 2
        row = row.withColumn("house", F.lit(None).cast("int"))
    else:
        row = row.withColumn("house", F.array_min(F.transform(F.filter("at", lambda x: x["token"].rlike(r"\d")), lambda x: x["pos"])))
        hit = lambda x: F.coalesce(((x["pos"] - F.col("house")).between(1, TYPE_WINDOW)) & ~x["token"].rlike(r"\d"), F.lit(False))
    once = F.transform(F.array_distinct(F.transform("at", lambda x: x["token"])), lambda t: F.struct(t.alias("token"), F.lit(1).alias("df"), F.lit(0).alias("pos")))
    places = F.transform("at", lambda x: F.struct(x["token"].alias("token"), F.lit(0).alias("df"), hit(x).cast("int").alias("pos")))
    flat = row.select("country", F.inline(F.concat(once, places)))
    return flat.groupBy("country", "token").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos_count")).withColumn("field", F.lit(field))


def token_stats(records: DataFrame, fields: tuple[str, ...] = (*NAME_FIELDS, *ADDR_FIELDS), min_df: int = 1) -> DataFrame:
    """field, country ('' for all), token, df, pos_count, n_docs; a token below ``min_df`` over all countries goes everywhere."""
    counts = None
    for f in fields:
        own = token_counts(records, f)
        counts = own if counts is None else counts.unionByName(own)
    n = records.groupingSets([[], ["country"]], "country").agg(F.count("*").alias("n_docs"), F.grouping("country").alias("g"))
    n = n.select(F.when(F.col("g") == 1, "").otherwise(F.col("country")).alias("country"), "n_docs")
    whole = counts.groupBy("field", "token").agg(F.sum("df").alias("df"), F.sum("pos_count").alias("pos_count")).where(F.col("df") >= min_df)
    own = counts.join(whole.select("field", "token"), ["field", "token"], "left_semi") if min_df > 1 else counts
    both = own.select("field", "country", "token", "df", "pos_count").unionByName(whole.select("field", F.lit("").alias("country"), "token", "df", "pos_count"))
    return both.join(n, "country").select("field", "country", "token", "df", "pos_count", "n_docs")


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def likeness(stats: DataFrame, field: str) -> DataFrame:
    """token, score: share of positional hits (one at most) times the logistic of the standardised log frequency."""
    own = stats.where((F.col("field") == field) & (F.col("country") == ""))
    logf = own.withColumn("lf", F.log(F.col("df") / F.col("n_docs")))
    mu, sd = logf.agg(F.avg("lf")).scalar(), logf.agg(F.stddev_samp("lf")).scalar()
    z = (F.col("lf") - mu) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0))
    share = F.least(F.col("pos_count") / F.greatest(F.col("df"), F.lit(1)), F.lit(1.0))
    return logf.select("token", (share / (1 + F.exp(-z))).alias("score"))


def top_tokens(stats: DataFrame, field: str, n: int = 50) -> DataFrame:
    return stats.where((F.col("field") == field) & (F.col("country") == "")).orderBy(F.desc("df"), "token").select("token", "df").limit(n)


def generic_tokens(stats: DataFrame, min_df: int = GENERIC_DF) -> DataFrame:
    """field, token of frequent and positional tokens (legal forms, street types)."""
    share = F.col("pos_count") / F.greatest(F.col("df"), F.lit(1))
    cut = F.when(F.col("field") == "norm_name", NAME_END).when(F.col("field") == "norm_addr", STREET_TYPE)
    return stats.where((F.col("country") == "") & (F.col("df") >= min_df) & (share >= cut)).select("field", "token")


def quality(records: DataFrame) -> DataFrame:
    """Shares and mean tokens for each country."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return records.groupBy("country").agg(
        F.count("*").alias("n"), share(F.col("norm_name") == "").alias("name_empty"), share(F.col("norm_addr") == "").alias("addr_empty"),
        share(F.col("house_number") != "").alias("has_house"), share(F.col("postcodes") != "").alias("has_postcode"), share(F.col("landmark") != "").alias("has_landmark"),
        share(F.col("name_romanized")).alias("romanized"), F.round(F.avg(F.size(tokens(F.col("norm_name")))), 6).alias("name_tokens"), F.round(F.avg(F.size(tokens(F.col("norm_addr")))), 6).alias("addr_tokens"),
    )


def idf_rows(stats: DataFrame, field: str) -> DataFrame:
    """country, token, idf of one field, and under a null token the default of unseen tokens."""
    own = stats.where((F.col("field") == field) & (F.col("country") != ""))
    seen = own.select("country", "token", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    default = own.groupBy("country").agg(idf(F.max("n_docs"), F.lit(1)).alias("idf")).select("country", F.lit(None).cast("string").alias("token"), "idf")
    return seen.unionByName(default)


def top_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"__r <= {n}").drop("__r")
