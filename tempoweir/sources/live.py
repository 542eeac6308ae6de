"""Sources that are fed while a run goes on: producers, channels, polls, pushes and growing files.

Streaming sources are Python data sources whose offsets say what was read.  A growing
file can be read again from its offsets; a poll cannot, so a query that lost a batch
before it was written down fails instead of making values up.
"""

from __future__ import annotations

import base64
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema

from tempoweir.stream import Stream

BATCH = 8_192


def produce(spark: SparkSession, make: Callable[[], Iterable[tuple[int, Any]]], kind: str, seed: Any = None) -> Stream:
    """Ticks (time, value) of a producer that runs in a task, as it makes them.

    An error of the producer, or a time before its last one, aborts the run.  A task that
    is run again makes its producer anew.
    """
    schema = T._parse_datatype_string(f"t bigint, seq bigint, v {kind}")
    arrow = to_arrow_schema(schema)

    def walk(batches):
        for _ in batches:
            pass
        last, rows = None, []
        for i, (t, v) in enumerate(make()):
            if last is not None and t < last:
                raise ValueError(f"time {t} after {last}")
            last = t
            rows.append({"t": t, "seq": i, "v": v})
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return Stream(spark.range(0, 1, 1, 1).mapInArrow(walk, schema), (), seed)


def channel(spark: SparkSession, make: Callable[[], Iterable[tuple[int, Any]]], kind: str) -> Stream:
    """Messages (time, value) of a sender, those of one time in a burst (an array, in order of sending)."""
    sent = produce(spark, make, kind).df
    packed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"])
    return Stream(sent.groupBy("t").agg(F.min("seq").alias("seq"), packed.alias("v")))


class _Poll(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tempoweir_poll"

    def schema(self) -> str:
        return f"t bigint, seq bigint, v {self.options['kind']}"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PollReader(cloudpickle.loads(base64.b64decode(self.options["f"])))


class _PollReader(SimpleDataSourceStreamReader):
    def __init__(self, f: Callable[[], Any]) -> None:
        self.f = f

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        value = self.f()
        if value is None:
            return iter([]), start
        return iter([(time.time_ns(), start["n"], value)]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        raise ValueError("a poll cannot be read again")


def poll(spark: SparkSession, f: Callable[[], Any], kind: str) -> DataFrame:
    """Streaming rows (t, seq, v): ``f()`` once a micro-batch, stamped with the clock; quiet where it gives None."""
    spark.dataSource.register(_Poll)
    return spark.readStream.format("tempoweir_poll").option("kind", kind).option("f", base64.b64encode(cloudpickle.dumps(f)).decode()).load()


class _Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tempoweir_tail"

    def schema(self) -> str:
        return "offset bigint, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options["file"], int(self.options["most"]))


class _TailReader(SimpleDataSourceStreamReader):
    def __init__(self, file: str, most: int) -> None:
        self.file, self.most = file, most

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _whole_lines(self, at: int, most: int) -> bytes:
        """Bytes from ``at`` to the end of the last whole line; of a line longer than ``most`` all of it."""
        try:
            with open(self.file, "rb") as f:
                f.seek(at)
                raw = f.read(most)
                while raw and b"\n" not in raw and (more := f.read(most)):
                    raw += more
        except FileNotFoundError:
            return b""
        return raw[: raw.rfind(b"\n") + 1]

    def _rows(self, at: int, raw: bytes) -> Iterator[tuple]:
        rows = []  # Spark copies the iterator, which a generator does not allow
        for line in raw.split(b"\n")[:-1]:
            rows.append((at, line.removesuffix(b"\r").decode(errors="replace")))
            at += len(line) + 1
        return iter(rows)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        raw = self._whole_lines(start["at"], self.most)
        return self._rows(start["at"], raw), {"at": start["at"] + len(raw)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.file, "rb") as f:
            f.seek(start["at"])
            return self._rows(start["at"], f.read(end["at"] - start["at"]))


def tail_file(spark: SparkSession, file: str, most: int = 1 << 20) -> DataFrame:
    """Streaming rows (offset, value) of the whole lines of a growing file that the driver can open; a line without its end waits."""
    spark.dataSource.register(_Tail)
    return spark.readStream.format("tempoweir_tail").option("file", file).option("most", str(most)).load()


class Pushed:
    """Values pushed by any thread; each call of ``push`` lands as one file, whole or not at all."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def push(self, *values: Any) -> None:
        spare = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(spare, "w") as f:
            for v in values:
                f.write(json.dumps({"v": v}) + "\n")
        os.replace(spare, f"{self.folder}/{time.time_ns()}-{uuid.uuid4().hex}.json")


def external(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, Pushed]:
    """Streaming rows (v) of what is pushed, and where to push; ``folder`` is one that driver and executors see."""
    source = Pushed(folder)
    return spark.readStream.schema(f"v {kind}").json(folder), source


def packed(rows: DataFrame, foreach: Callable[[Sequence[Any]], None], checkpoint: str):
    """Run ``foreach`` with all pending values of each micro-batch as one burst, on the driver."""
    return rows.writeStream.foreachBatch(lambda df, _: foreach([r["v"] for r in df.select("v").toLocalIterator()])).option("checkpointLocation", checkpoint)
