"""Helpers that the training-data operators share: column guards and durable scratch tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import shared_path as scratch_path

#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Narrow rows in a file of a stored table.
PART_ROWS = 1 << 16
#: Words are maximal runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str, about: int | None = None, each: int = PART_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, cut from its lineage, and readable after any executor is lost.

    about: how many rows df or what it is last joined from has, roughly, where that is known. A small table then comes in as many files as there are cores, however many
    partitions its shuffle had: to create a file costs processes of its own on a local disk. Large ones get a file for `each` rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    if about is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, about // each))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.corvane_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.corvane_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(df: DataFrame, text_col: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def light_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, where no lower bound is set: ten thousand long texts at once are more than a worker should hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at_most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < at_most <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs: it does so when the driver's JVM collects their handles, which a mostly idle driver puts off."""
    gc.collect()
    spark._jvm.System.gc()
