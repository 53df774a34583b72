"""Session helpers: the shared folder, written tables that cut lineage, table readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Only where the session names no shared folder and all of it runs on one machine, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"
#: Rows and bytes that pass to a Python worker at once; texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors of {master} share")
        named = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Written:
    """A DataFrame written as Parquet into the shared folder; `df` reads it back with cut lineage."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/millrace/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing reads `df` any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what passes to Python workers at once, where the session leaves Spark's defaults."""
    for key, value in BATCH.items():
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` through a written table: survives lost executors, is computed once."""
    return Written(df, tag).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; what is computed of it in Python goes there in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
