"""Stage tables: written once between the stages of a plan, so that later stages read them instead of repeating the work."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def written(df: DataFrame, tag: str = "stage") -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``; a temporary folder only where that is unset."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="stages-")
        root = _OWN[app]
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Between stages: the driver's heap shrinks to what is in use, and shuffles and broadcasts that no plan holds any more go.

    Spark drops them only when the driver happens to collect its garbage, which a growing heap puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
