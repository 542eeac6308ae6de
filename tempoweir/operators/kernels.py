"""Kernels of path-dependent operators; each call of a factory makes the state of one key.

``run(times, values)`` takes the next ticks of the key, whole instants in order, and
gives (places of the ticks that emit, or None for all; their values).  A null tick
changes no average, median or fold: it emits the result as it stands, null before the
first value.  For medians NaN counts as null.  ``throttle`` looks at times only, and to
``drop_small_change`` null is a value that differs from every other.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np


@dataclass
class Ewma:
    alpha: float | None
    half_life: int | None
    y: float | None = None
    t: int | None = None

    def run(self, times, values):
        y, last, alpha, half, out = self.y, self.t, self.alpha, self.half_life, []
        for t, x in zip(times, values, strict=True):
            if x is not None:
                if y is None:
                    y = x
                elif alpha is not None:
                    y += alpha * (x - y)
                else:
                    y += (1.0 if half <= 0 else 1 - 2.0 ** ((last - t) / half)) * (x - y)
                last = t
            out.append(y)
        self.y, self.t = y, last
        return None, out


def ewma(alpha: float | None = None, half_life: int | None = None):
    """Exponential average, seeded by the first value: y += a (x - y), a fixed or 1 - 2^(-dt/h)."""
    return partial(Ewma, alpha, half_life)


@dataclass
class Throttle:
    interval: int
    last: int | None = None

    def run(self, times, values):
        at, last = [], self.last
        for i, t in enumerate(times):
            if last is None or t - last >= self.interval:
                last = t
                at.append(i)
        self.last = last
        return at, [values[i] for i in at]


def throttle(interval: int):
    """Emit the first value and then any at least ``interval`` after the last emitted one."""
    return partial(Throttle, interval)


@dataclass
class DropSmallChange:
    is_small: Callable
    last: list = field(default_factory=list)

    def run(self, times, values):
        at = []
        for i, x in enumerate(values):
            held = self.last
            if held and (x is None or held[0] is None):
                same = x is held[0]
            else:
                same = bool(held) and self.is_small(x, held[0])
            if not same:
                self.last = [x]
                at.append(i)
        return at, [values[i] for i in at]


def drop_small_change(is_small: Callable):
    """Drop values that ``is_small(value, last emitted)`` accepts."""
    return partial(DropSmallChange, is_small)


@dataclass
class Fold:
    f: Callable
    acc: Any = None
    empty: bool = False  # the first value is the seed

    def run(self, times, values):
        acc, empty, f, out = self.acc, self.empty, self.f, []
        for x in values:
            if x is not None:
                acc, empty = (x if empty else f(acc, x)), False
            out.append(acc)
        self.acc, self.empty = acc, empty
        return None, out


def fold(init, f: Callable):
    """acc = f(acc, value), emitted at each tick."""
    return partial(Fold, f, init)


def reduce(f: Callable):
    """As fold, seeded by the first value."""
    return partial(Fold, f, None, True)


def _is_value(x) -> bool:
    return x is not None and x == x


class RunningMedian:
    """Exact cumulative median by two heaps, O(log n) a value."""

    def __init__(self) -> None:
        self.low, self.high = [], []

    def run(self, times, values):
        low, high, out = self.low, self.high, []
        for x in values:
            if _is_value(x):
                if low and x > -low[0]:
                    heapq.heappush(high, x)
                else:
                    heapq.heappush(low, -x)
                if len(low) > len(high) + 1:
                    heapq.heappush(high, -heapq.heappop(low))
                elif len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
            out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
        return None, out


def running_median():
    return RunningMedian


class Weights:
    """Samples (value, time, weight) in order, in blocks with sums of weights; O(sqrt n) an operation."""

    MOST = 256

    def __init__(self) -> None:
        self.blocks, self.sums, self.tops, self.total = [], [], [], 0

    def add(self, sample: tuple) -> None:
        self.total += sample[2]
        if not self.blocks:
            self.blocks, self.sums, self.tops = [[sample]], [sample[2]], [sample]
            return
        i = min(bisect_left(self.tops, sample), len(self.tops) - 1)
        block = self.blocks[i]
        insort(block, sample)
        self.sums[i] += sample[2]
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.sums[i : i + 1] = [sum(s[2] for s in block[:half]), sum(s[2] for s in block[half:])]
            self.tops[i : i + 1] = [block[half - 1], block[-1]]
        else:
            self.tops[i] = block[-1]

    def drop(self, sample: tuple) -> None:
        i = bisect_left(self.tops, sample)
        block = self.blocks[i]
        block.pop(bisect_left(block, sample))
        self.sums[i] -= sample[2]
        self.total -= sample[2]
        if block:
            self.tops[i] = block[-1]
        else:
            del self.blocks[i], self.sums[i], self.tops[i]

    def median(self):
        """Value where the weight passes half; at exactly half the mean of the two beside it; None without weight."""
        if not self.total:
            return None
        half, run = self.total, 0
        for i, w in enumerate(self.sums):
            if 2 * (run + w) >= half:
                break
            run += w
        block = self.blocks[i]
        for j, (x, _, w) in enumerate(block):
            run += w
            if 2 * run > half:
                return x
            if 2 * run == half:
                return (x + (block[j + 1] if j + 1 < len(block) else self.blocks[i + 1][0])[0]) / 2


class WeightedMedian:
    """Time-weighted median over all samples, the last ``count`` or those of age up to ``span``."""

    def __init__(self, count: int | None, span: int | None) -> None:
        self.count, self.span = count, span
        self.samples: deque = deque()  # (time, value, turn), weight known once the successor is
        self.held, self.turn, self.now = Weights(), 0, None

    def _drop(self) -> None:
        t, x, turn = self.samples.popleft()
        if self.samples and self.samples[0][0] > t:
            self.held.drop((x, turn, self.samples[0][0] - t))

    def run(self, times, values):
        samples, out = self.samples, []
        for t, x in zip(times, values, strict=True):
            if _is_value(x):
                if samples and t > samples[-1][0]:
                    before, y, turn = samples[-1]
                    self.held.add((y, turn, t - before))
                samples.append((t, x, self.turn))
                self.turn += 1
                self.now = x
                while self.count is not None and len(samples) > max(1, self.count):
                    self._drop()
            while self.span is not None and samples and t - samples[0][0] > self.span:
                self._drop()
            middle = self.held.median()
            out.append(self.now if middle is None else middle)
        return None, out


def weighted_median(count: int | None = None, span: int | None = None):
    return partial(WeightedMedian, count, span)


class WindowMedian:
    """Median of the last ``count`` ticks (null ones count as ticks) or of those of age up to ``span``, with all of the instant."""

    def __init__(self, count: int | None, span: int | None) -> None:
        self.count, self.span, self.samples, self.held, self.turn = count, span, deque(), Weights(), 0

    def run(self, times, values):
        samples, held, out, span = self.samples, self.held, [], self.span
        n, done = len(times), 0
        for i, (t, x) in enumerate(zip(times, values, strict=True)):
            self.turn += 1
            sample = (x, self.turn, 1) if _is_value(x) else None
            samples.append((t, sample))
            if sample:
                held.add(sample)
            while (len(samples) > self.count) if span is None else (t - samples[0][0] > span):
                old = samples.popleft()[1]
                if old:
                    held.drop(old)
            if span is None:
                out.append(held.median())
            elif i + 1 == n or times[i + 1] != t:
                out += [held.median()] * (i + 1 - done)
                done = i + 1
        return None, out


def window_median(count: int | None = None, span: int | None = None):
    return partial(WindowMedian, count, span)


def _merged(a: tuple, b: tuple) -> tuple:
    """(count, mean, squared deviations from it) of two sets of samples together, for arrays of sets (Chan et al.)."""
    n = a[0] + b[0]
    gap, share = b[1] - a[1], b[0] / np.maximum(n, 1)
    return n, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share


def _running(parts: tuple) -> tuple:
    """Each part together with all before it."""
    k = 1
    while k < len(parts[0]):
        made = _merged(tuple(p[:-k] for p in parts), tuple(p[k:] for p in parts))
        parts = tuple(np.concatenate([p[:k], m]) for p, m in zip(parts, made, strict=True))
        k *= 2
    return parts


def _stretches(parts: tuple, lo: np.ndarray, hi: np.ndarray) -> tuple:
    """The parts lo to hi - 1 together, for arrays lo and hi: each a sum of stretches of 1, 2, 4, ... parts."""
    out, at, k = tuple(np.zeros(len(lo)) for _ in parts), lo.copy(), 1
    while k <= (hi - lo).max(initial=0):
        odd = np.flatnonzero((hi - lo) & k)
        for o, m in zip(out, _merged(tuple(o[odd] for o in out), tuple(p[at[odd]] for p in parts)), strict=True):
            o[odd] = m
        at[odd] += k
        parts = _merged(tuple(p[:-k] for p in parts), tuple(p[k:] for p in parts))
        k *= 2
    return out


class SpanVariance:
    """Sample variance (or its root) of the ticks of age up to ``span``, with all of the instant; 0 for less than two.

    Earlier ticks are kept in blocks, one of each run, with what each one and the rest of its
    block come to, so a tick costs a few steps whatever the span holds; samples are
    added only, never taken off, so that a large one leaves no trace once it is out.
    """

    def __init__(self, span: int, root: bool) -> None:
        self.span, self.root = span, root
        self.blocks: list = []  # (times, parts from each tick to the block's end)

    def run(self, times, values):
        t = np.array(times, np.int64)
        n = np.array([x is not None for x in values], np.float64)
        own = n, np.array([0.0 if x is None else x for x in values], np.float64), np.zeros(len(t))
        end = np.flatnonzero(np.diff(t, append=t[-1] + 1)) + 1
        start = t[end - 1] - self.span
        with np.errstate(all="ignore"):
            self.blocks = [b for b in self.blocks if b[0][-1] >= start[0]]
            sofar = _running(own)
            made = tuple(np.zeros(len(end)) for _ in own)
            # instants whose span begins in an earlier block: the rest of that block, the blocks after it, this run so far
            rest, z = tuple(np.zeros(1) for _ in own), int(np.searchsorted(start, self.blocks[-1][0][-1], "right")) if self.blocks else 0
            first, upper = z, z
            for i in range(len(self.blocks) - 1, -1, -1):
                held, parts = self.blocks[i]
                a = int(np.searchsorted(start, self.blocks[i - 1][0][-1], "right")) if i else 0
                if a < upper:
                    at = np.searchsorted(held, start[a:upper])
                    whole = _merged(_merged(tuple(p[at] for p in parts), rest), tuple(p[end[a:upper] - 1] for p in sofar))
                    for m, w in zip(made, whole, strict=True):
                        m[a:upper] = w
                rest, upper = _merged(tuple(p[:1] for p in parts), rest), min(a, upper)
            for m, w in zip(made, _stretches(own, np.searchsorted(t, start[first:]), end[first:]), strict=True):
                m[first:] = w
            self.blocks.append((t, tuple(p[::-1] for p in _running(tuple(p[::-1] for p in own)))))
            var = np.where(made[0] > 1, np.where(np.isfinite(made[1]), made[2] / (made[0] - 1), np.nan), 0.0)
            out = np.sqrt(var) if self.root else var
        return None, np.repeat(out, np.diff(end, prepend=0)).tolist()


def span_variance(span: int, root: bool = False):
    return partial(SpanVariance, span, root)


def feedback(seed, f: Callable, count: int):
    """A loop fused into one row kernel: value re-enters one ns later, ``count`` values from each input tick."""

    def make():
        def step(row):
            x = row["v"] if row["v"] is not None else seed
            for i in range(count):
                yield {"t": row["t"] + i, "seq": row["seq"], "v": x}
                x = f(x)

        return step

    return make


def demux_map(capacity: int):
    """Slot of each item: a key holds the lowest free slot until it closes; a full pool overflows (slot = capacity).

    A row kernel; rows carry ``item`` and ``close``; an item that overflowed stays there until it closes.
    """

    def make():
        held: dict = {}
        free = list(range(capacity))

        def step(row):
            item = row["item"]
            if item not in held:
                held[item] = heapq.heappop(free) if free else capacity
            yield {"t": row["t"], "seq": row["seq"], "item": item, "slot": held[item]}
            if row["close"]:
                slot = held.pop(item)
                if slot < capacity:
                    heapq.heappush(free, slot)

        return step

    return make
