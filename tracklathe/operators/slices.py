"""Statistics of slices of altitude and of normalized time, as wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.scalars import FOOT, mach, micros, midpoint, normalized_time, seconds_between, synonyms, temperature_deviation, wind_along_track
from tracklathe.operators.sequence import energy_rate

#: Slices of a thousand feet from -500 ft; in metres.
START, STEP, TOP = -0.5, 1.0, 48.0
#: Climb rate that counts as climbing, in the unit of daltitude (feet a minute); 500 is the alternative.
RATE = 2.54
SPLITS = 20


def range_of(c: Column) -> Column:
    return F.max(c) - F.min(c)


def wide(df: DataFrame, key: str, bucket: Column, n: int, stats: dict[str, Column], prefix: str = "") -> DataFrame:
    """One row a key with columns ``{prefix}{stat}_{i}``, i the bucket, 0 to n-1. A bucket without rows is NULL, counts too.

    Half-open buckets: each row is in one at most, so a pivot aggregates each once.
    """
    rows = df.withColumn("_bucket", bucket.cast("int")).where(F.col("_bucket").between(0, n - 1))
    found = rows.groupBy(key).pivot("_bucket", list(range(n))).agg(*[c.alias(s) for s, c in stats.items()])
    if len(stats) == 1:
        (only,) = stats
        return found.select(key, *[F.col(f"`{i}`").alias(f"{prefix}{only}_{i}") for i in range(n)])
    return found.select(key, *[F.col(f"`{i}_{s}`").alias(f"{prefix}{s}_{i}") for i in range(n) for s in stats])


def closed_slices(df: DataFrame, key: str, t: Column, n: int, stats: dict[str, tuple[str, Column]], time: str) -> DataFrame:
    """The same for n equal slices of [0, 1] closed on both sides: a row on an edge counts in two.

    Rows are copied to their one or two slices, then pivoted. A stat is (kind, column): median, count, or delta (last
    less first known value in time order).
    """
    at = df.withColumn("_t", t).where(F.col("_t").between(0, 1))
    low = F.floor(F.col("_t") * n)
    candidates = F.filter(F.array(low - 1, low, low + 1), lambda i: (i >= 0) & (i < n) & (F.col("_t") >= i / F.lit(float(n))) & (F.col("_t") <= (i + 1) / F.lit(float(n))))
    rows = at.withColumn("_slice", F.explode(candidates))

    def of(kind: str, c: Column) -> Column:
        order = F.when(c.isNotNull(), micros(F.col(time)))
        return {"median": F.median(c), "count": F.count(c), "delta": F.max_by(c, order) - F.min_by(c, order)}[kind]

    return wide(rows, key, F.col("_slice"), n, {s: of(*spec) for s, spec in stats.items()})


def slice_edges(start: float = START, step: float = STEP, top: float = TOP) -> int:
    """Number of slices between start and top: one less than edges start, start + step, .. below top."""
    edges = 0
    while start + edges * step < top:
        edges += 1
    return edges - 1


def altitude_bucket(altitude_m: Column, start: float = START, step: float = STEP) -> Column:
    """Index i with edge[i] <= altitude < edge[i+1]; edges in thousands of feet."""
    kft = altitude_m / (1000 * FOOT)
    i = F.floor((kft - start) / step)
    edge = lambda k: (F.lit(start) + k * step) * 1000 * FOOT
    return F.when(altitude_m < edge(i), i - 1).when(altitude_m >= edge(i + 1), i + 1).otherwise(i)


def phase_statistics() -> dict[str, Column]:
    """The eleven statistics of a slice of a climb or descent."""
    return {
        "mass": F.median("masses"),
        "masscount": F.count("masses"),
        "massadepdate": seconds_between(F.min("t_adep"), F.min("timestamp")),
        "massadesdate": seconds_between(F.max("timestamp"), F.max("t_ades")),
        "DeltaROCD": range_of(F.col("vertical_rate")),
        "ROCD": F.median("vertical_rate"),
        "e_rate_median": F.median("e_rate"),
        "tas_median": F.median("tas"),
        "DeltaT_median": F.median("DeltaT"),
        "e_rate_max": F.max("e_rate"),
        "e_rate_min": F.min("e_rate"),
    }


def climbing(trajectories: DataFrame, dates: DataFrame, limits: DataFrame | None = None, mass: Column | None = None, climb: bool = True, rate: float = RATE, rate_column: str = "daltitude", start: float = START, step: float = STEP, lag: int = 5) -> DataFrame:
    """Slice statistics of the first half of each flight (or, not ``climb``, of the second), SI units.

    ``dates`` has flight_id, t_adep, t_ades and aircraft_type; ``limits`` aircraft_type, mass_min and mass_max;
    ``mass`` is the equivalent mass of a point, NULL if coefficients aren't at hand. The energy rate is computed before
    points are filtered. Climb: climb slices and one takeoff slice at level rates; else descent slices, whose test is a
    rate below +``rate``. Flights without a point in the half have no row. A point is in one slice at most, so one scan
    and one aggregation give all slices. A type without limits of its own takes those of its synonym; the table of limits
    has a row for each type and is broadcast.
    """
    joined = energy_rate(trajectories.join(dates, "flight_id"), lag)
    joined = joined.withColumns({"masses": (mass if mass is not None else F.lit(None)).cast("double"), "DeltaT": temperature_deviation(F.col("temperature"), F.col("altitude"))})
    mid, t = midpoint(F.col("t_adep"), F.col("t_ades")), F.col("timestamp")
    half = joined.where((F.col("t_adep") <= t) & (t < mid)) if climb else joined.where((t < F.col("t_ades")) & (t > mid))
    n, v = slice_edges(start, step), F.col(rate_column)
    bucket = altitude_bucket(F.col("altitude"), start, step)
    within = F.when(bucket.between(0, n - 1), bucket.cast("int"))
    low = (F.col("altitude") >= -10000) & (F.col("altitude") < 2000 * FOOT)
    place = F.when(v > rate, within).when(v.between(-rate, rate) & low, n) if climb else F.when(v < rate, within)
    stats, names = phase_statistics(), {**{i: ("climb" if climb else "descent", i) for i in range(n)}, **({n: ("takeoff", 0)} if climb else {})}
    found = half.withColumn("_place", place).groupBy("flight_id", "aircraft_type").pivot("_place", list(names))
    out = found.agg(*[c.alias(k) for k, c in stats.items()])
    if limits is not None:
        known = limits.select(F.lower("aircraft_type").alias("_type"), "mass_max", "mass_min")
        out = out.join(F.broadcast(known), synonyms(F.col("aircraft_type")) == F.col("_type"), "left")
    else:
        out = out.withColumns({"mass_max": F.lit(None).cast("double"), "mass_min": F.lit(None).cast("double")})
    return out.select("flight_id", "mass_max", "mass_min", *[F.col(f"`{i}_{k}`").alias(f"{prefix}{k}_{j}") for i, (prefix, j) in names.items() for k in stats])


def cruise(trajectories: DataFrame, dates: DataFrame, n: int = SPLITS) -> DataFrame:
    """f_duration and, for n closed slices of normalized time, Mach number, its count, change and median of altitude.

    Speed in knots, altitude in feet. Every flight of ``dates`` has a row.
    """
    joined = trajectories.join(dates.select("flight_id", "t_adep", "t_ades"), "flight_id").withColumn("mach", mach(F.col("tas"), F.col("altitude")))
    stats = {"Cruisemach": ("median", F.col("mach")), "Cruisemachcount": ("count", F.col("mach")), "CruiseDeltaAlt": ("delta", F.col("altitude")), "CruiseMedianAlt": ("median", F.col("altitude"))}
    table = closed_slices(joined, "flight_id", normalized_time(F.col("timestamp"), F.col("t_adep"), F.col("t_ades")), n, stats, "timestamp")
    return dates.select("flight_id", seconds_between(F.col("t_adep"), F.col("t_ades")).alias("f_duration")).join(table, "flight_id", "left")


def wind_effect(trajectories: DataFrame, dates: DataFrame) -> DataFrame:
    """Mean wind along the track between departure and arrival; flights without a point between have no row."""
    joined = trajectories.join(dates.select("flight_id", "t_adep", "t_ades"), "flight_id").where(F.col("timestamp").between(F.col("t_adep"), F.col("t_ades")))
    along = wind_along_track(*[F.col(c) for c in ("gsx", "gsy", "u_component_of_wind", "v_component_of_wind", "groundspeed")])
    return joined.groupBy("flight_id").agg(F.avg(along).alias("wind_effect"))


def columns_of(prefix: str, n: int, stats: Sequence[str]) -> list[str]:
    return [f"{prefix}{s}_{i}" for i in range(n) for s in stats]
