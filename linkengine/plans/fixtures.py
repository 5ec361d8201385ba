"""Views of the driver's tables as record-linkage inputs.

Pages are records: the title is the name, the URL's comma-separated parts the address, the language the country, and the page
number modulo 3 the source.  Pages whose URLs carry the same language and article number are true matches.  Line items are
scored pairs of an order and a part.  Every view covers all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_records
from ..sources.stage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    source = F.concat(F.lit("S"), (1 + F.col("page_id") % 3).cast("string"))
    return pages.select(
        F.concat(source, F.lit("-"), F.col("page_id").cast("string")).alias("entity_id"), source.alias("source"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("country"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("raw_name"), F.replace(F.replace("url", F.lit("://"), F.lit(", ")), F.lit("/"), F.lit(", ")).alias("raw_addr"), "url",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_records(raw_records(spark, sf_dir))


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("source = 'S1'"), rows.where("source <> 'S1'")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id of pages about one article."""
    key = F.regexp_extract("url", "/([a-z]{2}/[0-9]+)", 1)
    rows = raw_records(spark, sf_dir).select("entity_id", "source", key.alias("article")).where("article <> ''")
    s1, pool = sides(rows)
    return s1.select(F.col("entity_id").alias("s1_id"), "article").join(pool.select(F.col("entity_id").alias("cand_id"), "article"), "article").select("s1_id", "cand_id")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, country of all S1 records."""
    return raw_records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "country")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id (order), cand_id (part), p, label: one row for each pair."""
    p = F.round(F.col("l_quantity") / 50 * 0.7 + F.col("l_discount") * 3, 4)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id"), p.alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rows.groupBy("s1_id", "cand_id").agg(F.max("p").alias("p"), F.max("label").alias("label"))


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).where("label = 1").select("s1_id", "cand_id")


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("country"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, pool) of (id, grp, vec): every third vector asks the others of its label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    return rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")


def varied_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all raw records, truth, native truth): each page beside a changed copy of itself, source V, id V + id.

    By its number the copy has two letters swapped, its words reversed, its first word dropped, its letters a as e, or, as a
    native spelling, Cyrillic letters; every other address has other digits.
    """
    raw = raw_records(spark, sf_dir).drop("url")
    n = F.substring_index("entity_id", "-", -1).cast("long")
    name, words = F.col("raw_name"), F.split("raw_name", " ")
    swapped = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substring(name, F.lit(4), F.length(name)))
    kind = n % 5
    other = (
        F.when(kind == 0, swapped).when(kind == 1, F.array_join(F.reverse(words), " ")).when(kind == 2, F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))
        .when(kind == 3, F.replace(name, F.lit("a"), F.lit("e"))).otherwise(F.translate(F.lower(name), *CYRILLIC))
    )
    addr = F.when(n % 2 == 0, F.replace("raw_addr", F.lit("1"), F.lit("2"))).otherwise(F.col("raw_addr"))
    copies = raw.select(F.concat(F.lit("V"), "entity_id").alias("entity_id"), F.lit("V").alias("source"), "country", other.alias("raw_name"), addr.alias("raw_addr"))
    pairs = raw.select(F.col("entity_id").alias("s1_id"), F.concat(F.lit("V"), "entity_id").alias("cand_id"), (kind == 4).alias("native"))
    return raw.unionByName(copies), pairs.where("not native").drop("native"), pairs.where("native").drop("native")


#: Latin letters and the Cyrillic ones that stand for them in native copies.
CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз")


def varied_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pairs of pages and their changed copies with records, all records)."""
    from ..operators import features

    raw, truth, _ = varied_records(spark, sf_dir)
    rows = written(normalise_records(raw), "varied")
    return features.with_records(truth, rows.where("source <> 'V'"), rows.where("source = 'V'")), rows
