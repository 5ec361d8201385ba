"""Streaming forms: token statistics that equal the batch ones, windowed event counts, pool records met by static S1 postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats


def token_counts(records: DataFrame, fields: tuple[str, ...] = ("norm_name", "norm_addr")) -> DataFrame:
    """Running token counts of a stream of normalised records; write it in complete or update mode."""
    out = None
    for f in fields:
        own = stats.token_counts(records, f)
        out = own if out is None else out.unionByName(own)
    return out


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count and sum of values by window and type; rows later than ``late`` are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions of each user, closed by ``gap``."""
    return events.withWatermark(ts, late).groupBy("user_id", F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def match_stream(pool: DataFrame, postings: DataFrame) -> DataFrame:
    """Scores of streamed pool rows (id, grp, keys) against static S1 postings (grp, feat, s1_id, w); no state is kept."""
    rows = pool.select(F.col("id").alias("cand_id"), "grp", F.explode(F.array_distinct("keys")).alias("feat"))
    return rows.join(postings, ["grp", "feat"]).select("cand_id", "s1_id", "feat", "w")


def run_to_end(query_input: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is available now, through a memory table."""
    q = query_input.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return query_input.sparkSession.table(name)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
