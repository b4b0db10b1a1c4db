"""File-backed sources on any Hadoop file system: text, Parquet, inventories."""

from __future__ import annotations

from collections.abc import Sequence
from posixpath import basename
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_text(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    header: bool = True,
    schema: str | None = None,
    quote: str = '"',
    escape: str = '"',
    multi_line: bool = True,
) -> DataFrame:
    """Delimited text. Without a ``schema`` the types cost one pass over the file.

    A quoted field may hold quotes (doubled) and line breaks. A file that has no
    line breaks in fields can be split among tasks with ``multi_line=False``.
    """
    reader = spark.read.option("sep", delimiter).option("header", header)
    reader = reader.option("quote", quote).option("escape", escape).option("multiLine", multi_line)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def undoubled(df: DataFrame) -> DataFrame:
    """Text columns as they were before ``save_csv`` doubled their backslashes."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit("\\\\"), F.lit("\\")) for c in texts})


def read_parquet(spark: SparkSession, path: str, roots: Sequence[str] = ()) -> DataFrame:
    """Parquet at ``path``, or the dataset of that name under one of ``roots``."""
    return spark.read.parquet(locate(spark, path, roots))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def files_in(spark: SparkSession, folder: str) -> dict[str, int]:
    """Name and length of every file directly in ``folder``."""
    system, target = _file_system(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in system.listStatus(target) if s.isFile()}


def delete(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a file its new place, whose folder is made if need be. Nothing is replaced."""
    system, target = _file_system(spark, to)
    _, present = _file_system(spark, path)
    system.mkdirs(target.getParent())
    # Local file systems would replace the file.
    if system.exists(target) or not system.rename(present, target):
        raise FileExistsError(f"{to} is already there")


def write_whole(spark: SparkSession, path: str, body: str) -> None:
    """A small file that is there as a whole or not at all."""
    beside = f"{path}.{uuid4().hex}.tmp"
    system, place = _file_system(spark, beside)
    stream = system.create(place)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    try:
        move(spark, beside, path)
    except FileExistsError:
        delete(spark, beside)
        raise


def read_whole(spark: SparkSession, path: str) -> str:
    """A small file's text, also where Spark's readers hide it for its name."""
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def locate(spark: SparkSession, path: str, roots: Sequence[str] = ()) -> str:
    """The first place the dataset exists; it is read there, not copied."""
    name = basename(path.rstrip("/"))
    for candidate in [path, *[f"{root.rstrip('/')}/{name}" for root in roots]]:
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(f"{name} is neither at its path nor in any fallback folder")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per object below ``folder``. File contents are never read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    return listing.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"),
        "path",
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )
