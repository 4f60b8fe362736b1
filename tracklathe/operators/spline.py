"""Cubic smoothing spline of each key's series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklathe.functions.scalars import micros
from tracklathe.operators.sequence import GAP, KEY, TIME, fill, hole_width, unwrap

#: Smoothness; a tenth of it for speeds, wind and vertical rate.
SMOOTH = 1e-2
TENTH = tuple("groundspeed gsx gsy tas tasx tasy u_component_of_wind v_component_of_wind vertical_rate wind".split())
SMOOTHED = (*"altitude latitude longitude specific_humidity temperature track_unwrapped".split(), *TENTH)


def banded_solve(main: np.ndarray, one: np.ndarray, two: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive definite system with two bands on either side, by LDL^T in linear time."""
    n = len(main)
    d, e, f, x = main.astype(float), np.append(one, 0.0), np.append(two, [0.0, 0.0]), b.astype(float)
    for i in range(n):
        if i + 1 < n:
            l1 = e[i] / d[i]
            d[i + 1] -= l1 * e[i]
            if i + 2 < n:
                l2 = f[i] / d[i]
                e[i + 1] -= l1 * f[i]
                d[i + 2] -= l2 * f[i]
                x[i + 2] -= l2 * x[i]
            x[i + 1] -= l1 * x[i]
    for i in range(n - 1, -1, -1):
        x[i] /= d[i]
        if i + 1 < n:
            x[i] -= e[i] / d[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= f[i] / d[i] * x[i + 2]
    return x


def smoothing_spline(t: np.ndarray, y: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and second derivatives at the knots of the curve least in p * squared errors + (1 - p) * squared curvature."""
    h = np.diff(t)
    r = 1 / h
    mid = -(r[:-1] + r[1:])
    lam = 6 * (1 - p)
    main = lam * (r[:-1] ** 2 + mid**2 + r[1:] ** 2) + p * 2 * (h[:-1] + h[1:])
    one = lam * (r[1:-1] * mid[:-1] + r[1:-1] * mid[1:]) + p * h[1:-1]
    two = lam * r[1:-2] * r[2:-1]
    u = banded_solve(main, one, two, np.diff(np.diff(y) * r))
    qu = np.zeros_like(t)
    qu[:-2] += r[:-1] * u
    qu[1:-1] += mid * u
    qu[2:] += r[1:] * u
    return y - lam * qu, np.concatenate([[0.0], 6 * p * u, [0.0]])


def evaluate(t: np.ndarray, f: np.ndarray, m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The natural cubic through (t, f) with second derivatives m, and its slope; straight lines beyond the ends."""
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    inside = np.clip(at, t[0], t[-1])
    a, b = (t[k + 1] - inside) / h, (inside - t[k]) / h
    slope = (f[k + 1] - f[k]) / h + h / 6 * ((3 * b**2 - 1) * m[k + 1] - (3 * a**2 - 1) * m[k])
    value = a * f[k] + b * f[k + 1] + h**2 / 6 * ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1])
    return value + slope * (at - inside), slope


def smooth_series(t: np.ndarray, y: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed values and slopes at all of ``t``; with two known values or fewer, the values as they are and no slope."""
    known = np.isfinite(y)
    if known.sum() <= 2:
        return y, np.full(len(y), np.nan)
    f, m = smoothing_spline(t[known], y[known], p)
    return evaluate(t[known], f, m, t)


def smooth(df: DataFrame, columns: dict[str, float], slopes: dict[str, tuple[str, float]] | None = None, key: str = KEY, time: str = TIME) -> DataFrame:
    """``columns`` (name to smoothness) smoothed for each key at its own times, which must differ.

    ``slopes`` adds derivatives: column to name and factor. One grouped pandas function does all columns of a key.
    """
    slopes = slopes or {}
    columns = {c: p for c, p in columns.items() if c in df.columns}
    slopes = {c: s for c, s in slopes.items() if c in columns}
    base = df.withColumn("_t", micros(F.col(time)) / 1e6).withColumns({c: F.col(c).cast("double") for c in columns})
    fields = [*df.withColumns({c: F.col(c).cast("double") for c in columns}).schema.fields, *[T.StructField(n, T.DoubleType()) for n, _ in slopes.values()]]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_t", kind="stable")
        t = rows["_t"].to_numpy(float)
        for c, p in columns.items():
            value, slope = smooth_series(t, rows[c].to_numpy(float, na_value=np.nan), p)
            rows[c] = np.where(np.isfinite(value), value, None)
            if c in slopes:
                name, factor = slopes[c]
                rows[name] = np.where(np.isfinite(slope), slope * factor, None)
        return rows[[f.name for f in fields]]

    return base.groupBy(key).applyInPandas(run, T.StructType(fields))


def interpolate(df: DataFrame, p: float = SMOOTH, gap: float = GAP, key: str = KEY, time: str = TIME) -> DataFrame:
    """Smoothed trajectories: track unwrapped, every variable smoothed, and NULL again in holes over ``gap`` seconds.

    Adds daltitude, the slope of the altitude a minute. Rows stay as they are: nothing is resampled.
    """
    if "track" in df.columns:
        df = unwrap(df.withColumn("_track", fill("track", key, time)), "_track", "track_unwrapped", key, time)
        df = df.withColumn("track_unwrapped", F.when(F.col("track").isNotNull(), F.col("track_unwrapped"))).drop("track", "_track")
    columns = [c for c in SMOOTHED if c in df.columns]
    df = df.withColumns({f"_hole_{c}": hole_width(c, key, time) for c in columns})
    df = smooth(df, {c: p * 0.1 if c in TENTH else p for c in columns}, {"altitude": ("daltitude", 60.0)}, key, time)
    masked = {c: F.when(F.col(f"_hole_{c}") <= gap, F.col(c)) for c in columns}
    if "altitude" in columns:
        masked["daltitude"] = F.when(F.col("_hole_altitude") <= gap, F.col("daltitude"))
    return df.withColumns(masked).drop(*[f"_hole_{c}" for c in columns])
