"""Order books, market event selectors and book queries.

Book updates are rows (venue, symbol, t, seq, kind, first, last, bids, asks,
changes): kind 'snapshot' carries bids and asks as arrays of (price, qty), kind
'delta' carries changes as an array of (side, price, qty), quantity 0 removing a
level.  first and last are the venue's sequence numbers, null if it has none.

Books are walked over Arrow columns: prices and quantities are whole numbers of 10^-9,
a side is a map of them and a sorted list of prices, and only the levels asked for
leave the walk.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tempoweir.operators.scan import placed_in_order, runs, whole_instants

LEVEL = "struct<price: decimal(38,9), qty: decimal(38,9)>"
BOOK = f"venue string, symbol string, t bigint, seq bigint, status string, last_seq bigint, bids array<{LEVEL}>, asks array<{LEVEL}>, bid_levels int, ask_levels int"
MOST_WAITING = 16_384
_DECIMAL = pa.decimal128(38, 9)


class Side:
    """Levels of one side: quantity by price, and the prices in rising order."""

    __slots__ = ("qty", "prices")

    def __init__(self, levels=()) -> None:
        self.qty = {p: q for p, q in levels if q}
        self.prices = sorted(self.qty)

    def change(self, price: int, qty: int) -> None:
        if qty:
            if price not in self.qty:
                insort(self.prices, price)
            self.qty[price] = qty
        elif self.qty.pop(price, None) is not None:
            del self.prices[bisect_left(self.prices, price)]


class Book:
    """A book's levels and its place in the venue's sequence; ``apply`` says what became of an update."""

    def __init__(self) -> None:
        self.status, self.last, self.bids, self.asks, self.waiting = "AwaitingSnapshot", None, Side(), Side(), []

    def _gap(self) -> str:
        self.status, self.last, self.waiting, self.bids, self.asks = "Gapped", None, [], Side(), Side()
        return "gap"

    def snapshot(self, last: int | None, bids, asks) -> str:
        if self.status == "Live" and self.last is not None and last is not None and last <= self.last:
            return "stale"
        self.bids, self.asks, self.last, self.status = Side(bids), Side(asks), last, "Live"
        waiting, self.waiting = self.waiting, []
        for d in waiting:
            if self.delta(*d) == "gap":
                return "gap"
        return "applied"

    def delta(self, first: int | None, last: int | None, changes) -> str:
        if self.status == "Gapped":
            return "refused"
        if self.status == "AwaitingSnapshot":
            if len(self.waiting) >= MOST_WAITING:
                return self._gap()
            self.waiting.append((first, last, changes))
            return "buffered"
        if self.last is None:
            self.last = last
        elif last is not None:
            if last <= self.last:
                return "stale"
            if first > self.last + 1:
                return self._gap()
            self.last = last
        for is_bid, price, qty in changes:
            (self.bids if is_bid else self.asks).change(price, qty)
        return "applied"


def _units(numbers: pa.Array) -> list[int]:
    """Decimals as whole numbers of their last place."""
    numbers = numbers.cast(_DECIMAL)
    words = np.frombuffer(numbers.buffers()[1], "<i8").reshape(-1, 2)[numbers.offset : numbers.offset + len(numbers)]
    if ((words[:, 0] >> 63) == words[:, 1]).all():
        return words[:, 0].tolist()
    return [(high << 64) | (low & ((1 << 64) - 1)) for low, high in words.tolist()]


def _decimals(units: list[int]) -> pa.Array:
    if all(-(1 << 63) <= u < 1 << 63 for u in units):
        low = np.array(units, np.int64)
        return pa.Array.from_buffers(_DECIMAL, len(low), [None, pa.py_buffer(np.column_stack([low, low >> 63]).tobytes())])
    return pa.Array.from_buffers(_DECIMAL, len(units), [None, pa.py_buffer(b"".join(u.to_bytes(16, "little", signed=True) for u in units))])


def _levels(column: pa.ListArray):
    """A function from a row to its (price, qty) pairs; a null list is empty."""
    at, flat = column.offsets.to_numpy().tolist(), column.values
    pairs = list(zip(_units(flat.field("price")), _units(flat.field("qty")), strict=True))
    return lambda i: pairs[at[i] : at[i + 1]]


def _changes(column: pa.ListArray):
    at, flat = column.offsets.to_numpy().tolist(), column.values
    rows = list(zip([s == "bid" for s in flat.field("side").to_pylist()], _units(flat.field("price")), _units(flat.field("qty")), strict=True))
    return lambda i: rows[at[i] : at[i + 1]]


def _walker(depth: int | None, bursts: bool):
    schema = to_arrow_schema(T._parse_datatype_string(BOOK))

    def walk(batches):
        book, key = None, None
        for rows in whole_instants(batches, ["venue", "symbol"]):
            snapshots = [k == "snapshot" for k in rows.column("kind").to_pylist()]
            first, last, t = (rows.column(c).to_pylist() for c in ("first", "last", "t"))
            bids_of, asks_of, changes_of = _levels(rows.column("bids")), _levels(rows.column("asks")), _changes(rows.column("changes"))
            take, status, lasts, counts = [], [], [], ([], [])
            sides: tuple = (([0], [], []), ([0], [], []))  # offsets, prices, quantities

            def emit(i):
                take.append(i)
                status.append(book.status)
                lasts.append(book.last)
                for side, (at, prices, quantities), count, down in ((book.bids, sides[0], counts[0], True), (book.asks, sides[1], counts[1], False)):
                    every = side.prices
                    best = every[: -depth - 1 : -1] if down and depth else every[::-1] if down else every[:depth]
                    prices += best
                    quantities += [side.qty[p] for p in best]
                    at.append(len(prices))
                    count.append(len(every))

            for own, lo, hi in runs(rows, ["venue", "symbol"]):
                if book is None or own != key:
                    book, key = Book(), own
                done = None
                for i in range(lo, hi):
                    what = book.snapshot(last[i], bids_of(i), asks_of(i)) if snapshots[i] else book.delta(first[i], last[i], changes_of(i))
                    if what == "applied" or what == "gap":
                        if bursts:
                            done = i
                        else:
                            emit(i)
                    if done is not None and (i + 1 == hi or t[i + 1] != t[i]):
                        emit(done)
                        done = None
            if not take:
                continue
            held = rows.take(pa.array(take, pa.int64()))
            made = []
            for at, prices, quantities in sides:
                levels = pa.StructArray.from_arrays([_decimals(prices), _decimals(quantities)], fields=list(schema.field("bids").type.value_type))
                made.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), levels).cast(schema.field("bids").type))
            yield pa.RecordBatch.from_arrays(
                [*[held.column(c).cast(schema.field(c).type) for c in ("venue", "symbol", "t", "seq")], pa.array(status), pa.array(lasts, pa.int64()), *made, pa.array(counts[0], pa.int32()), pa.array(counts[1], pa.int32())],
                schema=schema,
            )

    return walk


def _books(updates: DataFrame, depth: int | None, bursts: bool) -> DataFrame:
    columns = ["venue", "symbol", "t", "seq", "kind", "first", "last", "bids", "asks", "changes"]
    placed = placed_in_order(updates.select(*columns), ["venue", "symbol"], "t", "seq")
    return placed.mapInArrow(_walker(depth, bursts), BOOK)


def order_book(updates: DataFrame, depth: int | None = None) -> DataFrame:
    """The book of each instrument after every update that is applied or leaves a gap.

    ``depth``: only so many best levels of a side; the counts of levels are of the whole book.
    """
    return _books(updates, depth, False)


def order_book_bursts(updates: DataFrame, depth: int | None = None) -> DataFrame:
    """One row for each instant, after the last of its updates that is applied or leaves a gap."""
    return _books(updates, depth, True)


def best(side: str) -> Column:
    """Best level of 'bids' or 'asks', null unless the book is live."""
    return F.when(F.col("status") == "Live", F.get(F.col(side), F.lit(0)))


def depth(side: str, n: int) -> Column:
    return F.when(F.col("status") == "Live", F.slice(side, 1, n)).otherwise(F.slice(side, 1, 0))


def level_count(side: str) -> Column:
    """Levels of the whole side."""
    return F.when(F.col("status") == "Live", F.col("bid_levels" if side == "bids" else "ask_levels")).otherwise(0)


def mid() -> Column:
    return (best("bids")["price"].cast("double") + best("asks")["price"].cast("double")) / 2


def spread() -> Column:
    return best("asks")["price"] - best("bids")["price"]


def microprice() -> Column:
    b, a = best("bids"), best("asks")
    bq, aq = b["qty"].cast("double"), a["qty"].cast("double")
    return (b["price"].cast("double") * aq + a["price"].cast("double") * bq) / F.nullif(bq + aq, F.lit(0.0))


def trades(events: DataFrame) -> DataFrame:
    """Payloads of events of kind 'trade'."""
    return events.where("kind = 'trade'").select("t", "seq", "trade.*")


def book_updates(events: DataFrame) -> DataFrame:
    return events.where("kind = 'book'").select("t", "seq", "book.*")


def select_bursts(events: DataFrame, kind: str, field: str) -> DataFrame:
    """Items of one kind in packed bursts (arrays v); quiet where there are none."""
    picked = F.transform(F.filter("v", lambda x: x["kind"] == kind), lambda x: x[field])
    return events.withColumn("v", picked).where(F.size("v") > 0)


def ws_messages(items: DataFrame) -> DataFrame:
    """Messages of a socket's bursts ``v`` of items (kind 'message' or 'status', status, topic, text), as bursts (topic, text)."""
    picked = F.transform(F.filter("v", lambda x: x["kind"] == "message"), lambda x: F.struct(x["topic"].alias("topic"), x["text"].alias("text")))
    return items.withColumn("v", picked).where(F.size("v") > 0)


def ws_status(items: DataFrame) -> DataFrame:
    """The last status of each burst that holds one."""
    picked = F.filter("v", lambda x: x["kind"] == "status")
    return items.withColumn("v", picked).where(F.size("v") > 0).withColumn("v", F.element_at("v", -1)["status"])
