"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is named, a local one if all runs in this process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("executors share no local folder: name a shared one in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberlake-"))
    return jsc.getCheckpointDir().get()


class Scratch:
    """Parquet tables of one operator call. ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/emberlake/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def keep(self, df: DataFrame, name: str, codec: str | None = None, few: bool = False) -> DataFrame:
        """Write ``df`` and return it as read back: later stages restart from the files.

        few: the rows are small beside the work that made them, so they are dealt to as many
        files as their bytes need, not one for each task.
        """
        path = self.path(name)
        (df.hint("rebalance") if few else df).write.mode("overwrite").parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self) -> None:
        """Shuffle files behind tables that are written are of no more use: let the cleaner find them now, not when the driver's heap happens to fill."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
