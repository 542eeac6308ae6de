"""Helpers that the training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def freed(spark: SparkSession):
    """Frames made inside delete their shuffle files once they have run, and not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that lost executors lose nothing; shuffle files behind it go."""
    shared_dir(df.sparkSession)
    with freed(df.sparkSession):
        # a frame of its own, which never runs again
        return df.select("*").checkpoint(eager=True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, the measure that block counts follow."""
    with freed(df.sparkSession):
        return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever store that is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
