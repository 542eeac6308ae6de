"""Time-series analysis over the last samples of a stream, by NumPy kernels in ordered scans.

A null sample is no sample: it is not held and gives no row.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from tempoweir.operators.scan import ordered_scan


def _windowed(df: DataFrame, keys: list[str], window: int, least: int, of, out: str) -> DataFrame:
    def make():
        held: deque = deque(maxlen=window)

        def step(row):
            if row["v"] is None:
                return
            held.append(row["v"])
            if len(held) >= least and (made := of(list(held))) is not None:
                yield {"t": row["t"], "seq": row["seq"]} | made

        return step

    kinds = dict(df.dtypes)
    return ordered_scan(df, keys, make, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "t bigint", "seq bigint", out]))


# -- forecasts


#: Forms of additive smoothing: level; level and trend; level and damped trend.  Their free numbers, the noise's included.
FORMS = {"level": 3, "trend": 5, "damped": 6}


def _smooth(y: np.ndarray, a: float, b: float, phi: float) -> tuple[float, float, float]:
    """Sum of squared errors, last level and last trend of y under one set of parameters; phi 0 has no trend."""
    level, trend, loss = y[0], (y[1] - y[0]) if phi else 0.0, 0.0
    for x in y[1:]:
        ahead = level + phi * trend
        e = x - ahead
        loss += e * e
        level, trend = ahead + a * e, phi * trend + a * b * e if phi else 0.0
    return loss, level, trend


def _fitted(y: list[float], form: str) -> tuple:
    """(loss, a, b, phi, level, trend) of the best parameters, by grid and refinement."""
    best, at, width = None, (0.5, 0.3, 0.9), (0.4, 0.4, 0.08)
    for _ in range(4):
        grid = lambda i, low, high: sorted({min(high, max(low, at[i] + width[i] * k)) for k in (-1, -0.5, 0, 0.5, 1)})
        for a in grid(0, 0.01, 0.99):
            for b in grid(1, 0.001, 0.99) if form != "level" else (0.0,):
                for phi in grid(2, 0.8, 0.98)[::2] if form == "damped" else (float(form == "trend"),):
                    loss, level, trend = _smooth(y, a, b, phi)
                    if best is None or loss < best[0]:
                        best = loss, a, b, phi, level, trend
        at, width = best[1:4] if form == "damped" else (best[1], best[2], 0.9), tuple(w / 2 for w in width)
    return best


def ets(y: np.ndarray, horizon: int, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing of the form with the least corrected information criterion: points and half widths."""
    values, n = np.asarray(y, float).tolist(), len(y)
    least, held = None, None
    for form, k in FORMS.items():
        if n <= k + 1:
            continue
        fit = _fitted(values, form)
        score = n * np.log(max(fit[0] / n, 1e-300)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if least is None or score < least - 1e-9:
            least, held = score, fit
    loss, a, b, phi, level, trend = held or _fitted(values, "level")
    steps = np.cumsum(phi ** np.arange(1, horizon + 1)) if phi else np.zeros(horizon)
    c = np.concatenate([[0.0], a * (1 + b * (np.cumsum(phi ** np.arange(1, horizon)) if phi else np.zeros(horizon - 1)))])
    return level + trend * steps, z * np.sqrt(loss / max(1, n - 1)) * np.sqrt(1 + np.cumsum(c**2))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Local lines through the ``span`` nearest points with tricube weights."""
    d = np.abs(at[:, None] - x[None, :])
    q = min(span, len(x))
    reach = np.sort(d, 1)[:, q - 1] * max(1.0, span / len(x))
    w = np.clip(1 - (d / np.maximum(reach, 1e-12)[:, None]) ** 3, 0, None) ** 3
    w[w.sum(1) == 0] = 1.0
    total = w.sum(1)
    mx, my = (w @ x) / total, (w @ y) / total
    dx = x[None, :] - mx[:, None]
    spread = (w * dx * dx).sum(1)
    slope = np.where(spread > 1e-12, (w * dx * (y[None, :] - my[:, None])).sum(1) / np.maximum(spread, 1e-12), 0.0)
    return my + slope * (at - mx)


def _odd(x: float) -> int:
    return int(np.ceil(x)) | 1


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.full(n, 1 / n), "valid")


def stl(y: np.ndarray, period: int, span: int, inner: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal component and trend by repeated LOESS (Cleveland et al., 1990), without robustness weights."""
    n = len(y)
    x, trend = np.arange(n, dtype=float), np.zeros(n)
    wide = _odd(1.5 * period / (1 - 1.5 / span))
    for _ in range(inner):
        cycle = np.empty(n + 2 * period)
        for i in range(period):
            own = (y - trend)[i::period]
            m = len(own)
            cycle[i::period][: m + 2] = loess(np.arange(m, dtype=float), own, np.arange(-1, m + 1, dtype=float), span)
        low = _moving(_moving(_moving(cycle, period), period), 3)
        season = cycle[period : period + n] - loess(x, low, x, _odd(period))
        trend = loess(x, y - season, x, wide)
    return season, trend


def mstl(y: np.ndarray, periods: tuple[int, ...], rounds: int = 2) -> dict[int, np.ndarray]:
    """Seasonal component of each period, shortest first, each taken from the series without the others."""
    usable = sorted(p for p in set(periods) if p > 1 and len(y) >= 2 * p)
    found, rest = {p: np.zeros(len(y)) for p in usable}, np.asarray(y, float).copy()
    for _ in range(rounds if len(usable) > 1 else 1):
        for i, p in enumerate(usable):
            rest = rest + found[p]
            found[p] = stl(rest, p, 7 + 4 * (i + 1))[0]
            rest = rest - found[p]
    return found


def forecast(df: DataFrame, keys: list[str], window: int, horizon: int, periods: tuple[int, ...] = (), min_points: int = 12, level: float = 0.95) -> DataFrame:
    """point, lower and upper of the next ``horizon`` values.

    Seasonal components are taken off by ``mstl`` and their last cycle is repeated; what is left gets the best form of ``ets``.
    """
    z = {0.8: 1.2816, 0.9: 1.6449, 0.95: 1.96, 0.99: 2.5758}.get(level, 1.96)

    def of(held):
        y = np.array(held, float)
        n, back = len(y), np.zeros(horizon)
        for p, s in mstl(y, periods).items():
            y, back = y - s, back + s[n - p + np.arange(horizon) % p]
        point, half = ets(y, horizon, z)
        point = point + back
        return {"point": point.tolist(), "lower": (point - half).tolist(), "upper": (point + half).tolist()}

    return _windowed(df, keys, window, max(12, min_points), of, "point array<double>, lower array<double>, upper array<double>")


# -- change points and seasons


def change_points(y: np.ndarray, hazard: float = 250.0) -> list[int]:
    """Bayesian online change points (normal-gamma), as indices where the likeliest run starts anew."""
    y = (y - y.mean()) / (y.std() or 1.0)
    mu, kappa, alpha, beta = (np.array([x]) for x in (0.0, 1.0, 1.0, 1.0))
    p, starts = np.array([1.0]), []
    for x in y:
        scale, df = np.sqrt(beta * (kappa + 1) / (alpha * kappa)), 2 * alpha
        d = (x - mu) / scale
        like = np.exp(_log_gamma((df + 1) / 2) - _log_gamma(df / 2)) / (np.sqrt(df * np.pi) * scale) * (1 + d * d / df) ** (-(df + 1) / 2)
        p = np.append((p * like).sum() / hazard, p * like * (1 - 1 / hazard))
        p /= p.sum() or 1.0
        mu, beta = np.append(0.0, (kappa * mu + x) / (kappa + 1)), np.append(1.0, beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1)))
        kappa, alpha = np.append(1.0, kappa + 1), np.append(1.0, alpha + 0.5)
        starts.append(len(starts) + 1 - int(p.argmax()))
    found, held = [], 0
    for at in starts:
        if at != held and at > held:
            found, held = [*found, at], at
    return [i for i in found if 0 < i < len(y)]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by six."""
    shift = sum(np.log(x + k) for k in range(6))
    z = x + 6
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) - shift


def changepoint(df: DataFrame, keys: list[str], window: int, hazard: float = 250.0, least: int = 8) -> DataFrame:
    return _windowed(df, keys, window, max(8, least), lambda y: {"indices": change_points(np.array(y, float), hazard)}, "indices array<int>")


def season_lengths(y: np.ndarray, threshold: float = 0.9) -> list[int]:
    """Periods whose power in a Welch periodogram stands over the ``threshold`` quantile by far."""
    n = len(y)
    size = max(16, n // 2)
    parts = [y[i : i + size] for i in range(0, n - size + 1, max(1, size // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * np.hanning(size), 4 * size)) ** 2 for p in parts], 0)
    peaks = [k for k in range(2, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 4 * np.quantile(power, threshold)]
    found = [round(4 * size / k) for k in sorted(peaks, key=lambda k: -power[k])]
    return [p for p in dict.fromkeys(found) if 2 <= p <= n // 2]


def seasons(df: DataFrame, keys: list[str], window: int) -> DataFrame:
    return _windowed(df, keys, window, max(window // 2, 16), lambda y: {"periods": season_lengths(np.array(y, float))}, "periods array<int>")


# -- several series: v is an array with a value for each


def aligned(held: list[list[float]]) -> np.ndarray:
    """Series by rows; short samples are filled forward, a late series backward by its first value."""
    width = max(len(s) for s in held)
    out = np.full((len(held), width), np.nan)
    for i, s in enumerate(held):
        out[i, : len(s)] = s
        if i and len(s) < width:
            out[i, len(s) :] = out[i - 1, len(s) :]
    for j in range(width):
        known = np.flatnonzero(~np.isnan(out[:, j]))
        out[: known[0], j] = out[known[0], j]
    return out.T


def mad_outliers(series: np.ndarray, sensitivity: float = 3.5) -> list[int]:
    """Series that stray from the median series by more than ``sensitivity`` scaled deviations."""
    gap = np.abs(series - np.median(series, 0)).mean(1)
    mad = np.median(np.abs(gap - np.median(gap)))
    return [int(i) for i in np.flatnonzero(0.6745 * (gap - np.median(gap)) > sensitivity * (mad or 1e-12))]


def dbscan(distance: np.ndarray, eps: float, least: int) -> list[int]:
    """Cluster of each row of a distance matrix, -1 for noise."""
    n = len(distance)
    near = distance <= eps
    core = near.sum(1) >= least
    label, k = np.full(n, -1), 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    if core[j]:
                        todo += np.flatnonzero(near[j] & (label < 0)).tolist()
            k += 1
    return label.tolist()


def dtw_matrix(series: np.ndarray, manhattan: bool = False, band: int | None = None) -> np.ndarray:
    """Pairwise dynamic time warping distances; all pairs advance together, cell by cell."""
    m, n = series.shape
    cost = np.abs(series[:, None, :, None] - series[None, :, None, :])
    cost = cost if manhattan else cost**2
    acc = np.full((m, m, n + 1, n + 1), np.inf)
    acc[:, :, 0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1 if band is None else max(1, i - band), n + 1 if band is None else min(n, i + band) + 1):
            acc[:, :, i, j] = cost[:, :, i - 1, j - 1] + np.minimum(np.minimum(acc[:, :, i - 1, j], acc[:, :, i, j - 1]), acc[:, :, i - 1, j - 1])
    out = acc[:, :, n, n]
    return out if manhattan else np.sqrt(out)


def outlier(df: DataFrame, keys: list[str], window: int, method: str = "mad", sensitivity: float = 3.5, eps: float = 1.0, least: int = 2) -> DataFrame:
    def of(held):
        x = aligned(held)
        if method == "mad":
            return {"outliers": mad_outliers(x, sensitivity)}
        gaps = np.sqrt(((x[:, None] - x[None]) ** 2).mean(2))
        return {"outliers": [i for i, k in enumerate(dbscan(gaps, eps, least)) if k < 0]}

    return _windowed(df, keys, window, 2, of, "outliers array<int>")


def dtw(df: DataFrame, keys: list[str], window: int, manhattan: bool = False, band: int | None = None) -> DataFrame:
    def of(held):
        x = aligned(held)
        return {"distances": dtw_matrix(x, manhattan, band).tolist()} if len(x) > 1 else None

    return _windowed(df, keys, max(2, window), 2, of, "distances array<array<double>>")


def cluster(df: DataFrame, keys: list[str], window: int, eps: float, least: int = 2) -> DataFrame:
    def of(held):
        x = aligned(held)
        return {"labels": dbscan(dtw_matrix(x), eps, least)} if len(x) > 1 else None

    return _windowed(df, keys, max(2, window), 2, of, "labels array<int>")
