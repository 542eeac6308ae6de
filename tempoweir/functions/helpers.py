"""Scalar helpers as Column expressions: time, fixed point, FIX messages, envelopes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KDB_EPOCH_NS = 946_684_800 * 10**9
DAY_NS = 86_400 * 10**9


def from_kdb(ns: Column) -> Column:
    return ns + F.lit(KDB_EPOCH_NS)


def to_kdb(ns: Column) -> Column:
    return ns - F.lit(KDB_EPOCH_NS)


def pretty(ns: Column) -> Column:
    """ISO time with nine digits of a second."""
    whole = F.timestamp_seconds(F.floor(ns / F.lit(10**9)).cast("long"))
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"))


def within(t: Column, lo: int, hi: int) -> Column:
    """Half-open [lo, hi)."""
    return (t >= lo) & (t < hi)


def time_slices(start: int, end: int, period: int) -> list[tuple[int, int]]:
    """[start, end) cut at midnights and, from each midnight on, at multiples of ``period``."""
    out, at = [], start
    while at < end:
        midnight = at - at % DAY_NS
        step = min(midnight + ((at - midnight) // period + 1) * period, midnight + DAY_NS, end)
        out.append((at, step))
        at = step
    return out


def fixed(text: Column) -> Column:
    """Price or quantity as decimal(38, 9); an overflow or bad text fails."""
    return text.cast("decimal(38,9)")


def try_fixed(text: Column) -> Column:
    return text.try_cast("decimal(38,9)")


def fix_field(message: Column, tag: int) -> Column:
    """First value of a FIX tag; fields end with SOH."""
    return F.get(fix_fields(message, tag), F.lit(0))


def fix_fields(message: Column, tag: int) -> Column:
    """All values of a tag, in order."""
    fields = F.filter(F.split(message, "\x01"), lambda f: f.startswith(f"{tag}="))
    return F.transform(fields, lambda f: f.substr(F.lit(len(str(tag)) + 2), F.length(f)))


def fix_group_count(message: Column, tag: int) -> Column:
    return F.coalesce(fix_field(message, tag).try_cast("int"), F.lit(0))


def fix_groups(message: Column, count_tag: int, first_tag: int) -> Column:
    """Repeating groups: texts of fields from each ``first_tag`` on, after the count."""
    after = F.substring_index(message, f"\x01{count_tag}=", -1)
    cut = F.slice(F.split(F.concat(F.lit("\x01"), after), f"\x01(?={first_tag}=)"), 2, 1_000_000)
    return F.slice(cut, 1, F.greatest(F.lit(0), fix_group_count(message, count_tag)))


def envelope(topic: Column, time_ns: Column, payload: Column) -> Column:
    """JSON envelope of a message."""
    return F.to_json(F.struct(topic.alias("topic"), time_ns.alias("time_ns"), payload.alias("payload")))


def from_envelope(text: Column, payload: str) -> Column:
    return F.from_json(text, f"topic string, time_ns bigint, payload {payload}")


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_table(name: str) -> str:
    return ".".join(quote_ident(part) for part in name.split("."))
