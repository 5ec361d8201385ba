"""Written tables in the shared folder of the cluster: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows of a file where a table's bound of rows is known.
ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _OWN[app]


class Store:
    """Tables of one operator run, all below one folder of :func:`shared_dir`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back with its own schema.

        Where it has at most ``most`` rows, a file for each ``ROWS`` of them or each core is enough: on local disks each file costs
        two processes that the executor starts, for the permissions.
        """
        if most is not None:
            files = max(self.spark.sparkContext.defaultParallelism, -(-most // ROWS))
            df = df.coalesce(files) if files < partitions(self.spark) else df
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._llm_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_llm_path", None)
        if path:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
