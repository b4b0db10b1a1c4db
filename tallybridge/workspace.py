"""Where intermediate tables go, so that lost executors cost a re-read and no more.

The folder is the cluster's shared checkpoint folder. A private temporary
folder is used only where none is configured and the master is local.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tallybridge-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """Tables written on the way to a result; ``release`` drops them."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self._spark = spark
        self._folder = folder

    @cached_property
    def root(self) -> str:
        """Settled on first use: a comparison that stores nothing needs no folder."""
        base = self._folder.rstrip("/") if self._folder else shared_folder(self._spark)
        return f"{base}/tallybridge-{uuid.uuid4().hex}"

    def place(self, name: str) -> str:
        """A path that nothing has been written to."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def store(
        self, df: DataFrame, name: str, partition_by: str | None = None, codec: str | None = None
    ) -> DataFrame:
        """Write ``df`` once and continue from the files."""
        path = self.place(name)
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if codec:
            writer = writer.option("compression", codec)
        writer.parquet(path)
        return self.read(path, df)

    def read(self, path: str, like: DataFrame) -> DataFrame:
        """The files at ``path``, which hold rows with the columns of ``like``."""
        schema = like.schema
        return self._spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def release(self) -> None:
        if "root" not in self.__dict__:
            return
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self._spark._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
