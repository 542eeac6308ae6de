"""File and database connectors, batch and streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoweir.functions.helpers import quote_table, time_slices
from tempoweir.stream import Stream

BROADCAST_SPLITS = 50_000

def _ordered(df: DataFrame) -> Column:
    """Row order of file sources: files by name, rows by place."""
    return F.monotonically_increasing_id()


def csv_read(spark: SparkSession, path: str, schema: str, time: str | Column, header: bool = False, late: str = "abort") -> Stream:
    """Rows as structs; a bad row fails the run; rows of one instant keep their order.

    ``late``: a row older than the one before it in its split of a file aborts the run, or is put in order with "sort".
    """
    rows = spark.read.schema(schema).csv(path, header=header, mode="FAILFAST")
    names = rows.columns
    t = F.col(time) if isinstance(time, str) else time
    read = Stream(rows.select(t.cast("long").alias("t"), _ordered(rows).alias("seq"), F.struct(*names).alias("v")))
    return read if late == "sort" else read.in_order()


def csv_write(stream: Stream, path: str, header: bool = False) -> None:
    """Leading time column, then the record's fields; parts are range-partitioned by time, in order."""
    kind = dict(stream.df.dtypes)["v"]
    fields = [F.col("v.*")] if kind.startswith("struct") else [F.col("v")]
    placed = stream.df.repartitionByRange("t").sortWithinPartitions("t", "seq")
    placed.select(F.col("t").alias("time"), *fields).write.csv(path, header=header, mode="overwrite")


def replay_lines(spark: SparkSession, path: str, base: int = 0, step: int = 1) -> Stream:
    """Lines of text files at base + i * step ns, files by name.

    A line's number is its place in its split of a file and the lines of the splits before;
    only the table of splits, a row each, is put in order as a whole.
    """
    split = ["file_path", "file_block_start"]
    rows = spark.read.text(path).select(F.col("value").alias("v"), *[f"_metadata.{c}" for c in split], F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy(*split).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*split, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    index = F.col("id") - F.col("first") + F.col("before")
    return Stream(rows.join(splits, split).select((index * step + base).cast("long").alias("t"), F.lit(0).cast("long").alias("seq"), "v"))


def tail_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear in a folder, as a streaming DataFrame."""
    return spark.readStream.text(folder)


def write_lines(stream: Stream, path: str, append: bool = False) -> None:
    text = stream.df.repartitionByRange("t").sortWithinPartitions("t", "seq").select(F.col("v").cast("string").alias("value"))
    text.write.mode("append" if append else "overwrite").text(path)


def jdbc_predicates(time: str, start: int, end: int, period: int) -> list[str]:
    """A predicate for each slice of [start, end); one partition and one query each."""
    stamp = lambda ns: f"to_timestamp({ns // 10**9}) + interval '{ns % 10**9 // 1000} microseconds'"
    return [f"{time} >= {stamp(a)} AND {time} < {stamp(b)}" for a, b in time_slices(start, end, period)]


def jdbc_read(spark: SparkSession, url: str, name: str, time: str, start: int, end: int, period: int, properties: dict[str, str]) -> DataFrame:
    """Table rows in [start, end), slice by slice; needs the driver's jar on the class path."""
    return spark.read.jdbc(url, quote_table(name), predicates=jdbc_predicates(time, start, end, period), properties=properties)


def jdbc_write(stream: Stream, url: str, name: str, properties: dict[str, str]) -> None:
    stream.df.select(F.timestamp_micros(F.floor(F.col("t") / 1000).cast("long")).alias("time"), "v.*").write.jdbc(url, quote_table(name), mode="append", properties=properties)


def kafka_read(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """topic, partition, offset, key, value; needs the connector's jar."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.select("topic", "partition", "offset", "key", "value")


def kafka_write(df: DataFrame, servers: str, topic: str, checkpoint: str):
    out = df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("checkpointLocation", checkpoint).start()


def cached(spark: SparkSession, folder: str, query: str, make, most_bytes: int | None = None) -> DataFrame:
    """Result of a query kept as Parquet under a digest of its text; ``make`` runs only if there is none.

    ``most_bytes``: results not used for longest are deleted until the others and this one fit.
    """
    folder, own = folder.rstrip("/"), hashlib.sha256(query.encode()).hexdigest()[:32]
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place(f"{folder}/{own}/_SUCCESS")):
        make().write.mode("overwrite").parquet(f"{folder}/{own}")
    fs.create(place(f"{folder}/{own}/_USED"), True).close()  # its time says when a result was last used
    if most_bytes is not None:
        held = []
        for entry in fs.listStatus(place(folder)):
            mark = place(entry.getPath(), "_USED")
            held.append((fs.getFileStatus(mark).getModificationTime() if fs.exists(mark) else 0, fs.getContentSummary(entry.getPath()).getLength(), entry.getPath()))
        total = sum(size for _, size, _ in held)
        for _, size, path in sorted(held, key=lambda x: (x[0], x[2].getName())):
            if total > most_bytes and path.getName() != own:
                fs.delete(path, True)
                total -= size
    return spark.read.parquet(f"{folder}/{own}")
