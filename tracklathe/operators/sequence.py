"""Cleaning of ordered sequences: stale repeats, derivative spikes, isolated points, gaps, angles, energy rate.

Every operator takes the key and time columns and needs one shuffle on the key; operators in a row share it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklathe.functions.scalars import GRAVITY, clip, isa_temperature, micros

KEY, TIME = "flight_id", "timestamp"
#: Thresholds of the first and second derivative, in the column's unit a second.
DERIVATIVES = {
    "altitude": (200.0, 50.0),
    "geoaltitude": (200.0, 150.0),
    "vertical_rate": (1500.0, 1000.0),
    "groundspeed": (12.0, 10.0),
    "track": (12.0, 10.0),
    "latitude": (0.01, 0.06),
    "longitude": (0.01, 0.06),
}
ANGLES = ("track",)
GAP = 20.0


def ordered(key: str = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def seconds(time: str = TIME) -> Column:
    return micros(F.col(time)) / 1e6


def dedup(df: DataFrame, key: str = KEY, time: str = TIME, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key and time: the first by ``ties``, or by all other columns."""
    others = [F.col(f"`{c}`") for c in (ties or sorted(c for c in df.columns if c not in (key, time)))]
    w = Window.partitionBy(key, time).orderBy(*[c.asc_nulls_last() for c in others])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def changed(column: str, w: WindowSpec) -> Column:
    """Both this value and the one before are known, and differ."""
    before = F.lag(column).over(w)
    return F.coalesce(F.col(column) != before, F.lit(False))


def mask_unchanged(df: DataFrame, columns: tuple[str, ...], key: str = KEY, time: str = TIME, lone_rows_stay: bool = True) -> DataFrame:
    """NULL for all of ``columns`` in rows where none of them changed. The first row counts as unchanged.

    With ``lone_rows_stay`` a key of one row is left as it is.
    """
    w = ordered(key, time)
    keep = reduce(lambda a, b: a | b, [changed(c, w) for c in columns])
    if lone_rows_stay:
        keep = keep | (F.count(F.lit(1)).over(Window.partitionBy(key)) <= 1)
    df = df.withColumn("_keep", keep)
    return df.withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in columns}).drop("_keep")


def mask_constant_latlon(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    return mask_unchanged(df, ("latitude", "longitude"), key, time, lone_rows_stay=False)


def mask_constant_position(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Reads what mask_constant_latlon() left, so the two don't merge into one test."""
    return mask_unchanged(df, ("altitude", "latitude", "longitude"), key, time)


def mask_constant_speed(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    return mask_unchanged(df, ("vertical_rate", "groundspeed", "track"), key, time)


def unwrapped(column: str, w: WindowSpec, period: float = 360.0) -> tuple[Column, Callable[[Column], Column]]:
    """The step of an angle, and how a running sum of corrections is applied; see unwrap()."""
    step = F.col(column) - F.lag(column).over(w)
    half = period / 2
    # not pmod, which takes a remainder just below 0 to 0 where it should give a period
    folded = step + half - period * F.floor((step + half) / period) - half
    folded = F.when((folded == -half) & (step > 0), half).otherwise(folded)
    return F.when(F.abs(step) < half, 0.0).otherwise(folded - step), lambda total: F.col(column) + total


def unwrap(df: DataFrame, column: str, out: str, key: str = KEY, time: str = TIME, period: float = 360.0) -> DataFrame:
    """``out``: the angle without jumps of a period, over the known values only; unknown values stay so."""
    known = F.col(column).isNotNull()
    w = Window.partitionBy(key, known).orderBy(time)
    correction, apply = unwrapped(column, w, period)
    df = df.withColumn("_step", F.when(known, F.coalesce(correction, F.lit(0.0))))
    total = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(known, apply(total))).drop("_step")


def mask_spikes(df: DataFrame, thresholds: dict[str, tuple[float, float]] = DERIVATIVES, key: str = KEY, time: str = TIME, angles: tuple[str, ...] = ANGLES) -> DataFrame:
    """NULL where derivatives spike, each column by itself on its known values.

    A first derivative at or over its threshold votes for its two points, a second one for its three; a point with two
    votes of either kind goes. A key with two rows or fewer is left as it is. Angles are unwrapped first.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    df = df.withColumn("_n", n)
    for c in [c for c in thresholds if c in df.columns]:
        first, second = thresholds[c]
        known = F.col(c).isNotNull()
        w = Window.partitionBy(key, known).orderBy(time)
        value = c
        if c in angles:
            df, value = unwrap(df, c, "_angle", key, time), "_angle"
        df = df.withColumns({"_dt": seconds(time) - F.lag(seconds(time)).over(w), "_dv": F.col(value) - F.lag(value).over(w)})
        df = df.withColumn("_ddv", F.col("_dv") - F.lag("_dv").over(w)).withColumn("_dtt", F.col("_dt") + F.lag("_dt").over(w))
        d1 = F.coalesce(F.try_divide(F.abs("_dv"), F.col("_dt")) >= first, F.lit(False)).cast("int")
        d2 = F.coalesce(2 * F.try_divide(F.abs("_ddv"), F.col("_dtt")) >= second, F.lit(False)).cast("int")
        df = df.withColumns({"_s1": d1, "_s2": d2})  # _s1 ends a pair at this point, _s2 a triple
        votes1 = F.col("_s1") + F.coalesce(F.lead("_s1").over(w), F.lit(0))
        votes2 = F.col("_s2") + F.coalesce(F.lead("_s2").over(w), F.lit(0)) + F.coalesce(F.lead("_s2", 2).over(w), F.lit(0))
        df = df.withColumn("_bad", ((votes1 >= 2) | (votes2 >= 2)) & (F.col("_n") > 2))
        df = df.withColumn(c, F.when(known & ~F.col("_bad"), F.col(c))).drop("_dt", "_dv", "_ddv", "_dtt", "_s1", "_s2", "_bad", "_angle")
    return df.drop("_n")


def mask_isolated(df: DataFrame, gap: float = GAP, key: str = KEY, time: str = TIME, columns: tuple[str, ...] | None = None, skip: tuple[str, ...] = ("icao24",)) -> DataFrame:
    """NULL for values whose nearer known neighbour is over ``gap`` seconds away, or that lack a neighbour.

    A key's first row needs only the next neighbour and its last row only the one before; any other row needs both.
    """
    columns = columns or tuple(c for c in df.columns if c not in (key, time, *skip))
    w = ordered(key, time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    t = seconds(time)
    df = df.withColumns({"_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull()})
    masked = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), t)
        before, after = t - F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead) - t
        before = F.when(F.col("_first"), F.lit(10_000.0)).otherwise(before)
        after = F.when(F.col("_last"), F.lit(10_000.0)).otherwise(after)
        near = F.when(before.isNotNull() & after.isNotNull(), F.least(before, after))
        masked[c] = F.when(F.coalesce(near <= gap, F.lit(False)), F.col(c))
    return df.withColumns(masked).drop("_first", "_last")


def cascade(df: DataFrame) -> DataFrame:
    """Wind and temperature go where latitude or altitude is unknown; humidity stays."""
    known = F.col("latitude").isNotNull() & F.col("altitude").isNotNull()
    return df.withColumns({c: F.when(known, F.col(c)) for c in ("u_component_of_wind", "v_component_of_wind", "temperature") if c in df.columns})


def clean(df: DataFrame, key: str = KEY, time: str = TIME, thresholds: dict[str, tuple[float, float]] = DERIVATIVES, gap: float = GAP) -> DataFrame:
    """All filters in order. Rows go only as duplicates of a key and time."""
    df = dedup(df, key, time)
    for step in (mask_constant_latlon, mask_constant_position, mask_constant_speed):
        df = step(df, key, time)
    return cascade(mask_isolated(mask_spikes(df, thresholds, key, time), gap, key, time))


def hole_width(column: str, key: str = KEY, time: str = TIME) -> Column:
    """Seconds between the known values around a row; 0 on known values; NULL before the first and after the last."""
    w = ordered(key, time)
    at = F.when(F.col(column).isNotNull(), seconds(time))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return after - before


def forward_fill(column: str, key: str = KEY, time: str = TIME) -> Column:
    return F.last(column, ignorenulls=True).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(column: str, key: str = KEY, time: str = TIME) -> Column:
    return F.first(column, ignorenulls=True).over(ordered(key, time).rowsBetween(0, Window.unboundedFollowing))


def fill(column: str, key: str = KEY, time: str = TIME) -> Column:
    """Forward, then backward."""
    return F.coalesce(forward_fill(column, key, time), backward_fill(column, key, time))


def energy_rate(df: DataFrame, lag: int = 5, longest: float = 40.0, key: str = KEY, time: str = TIME, out: str = "e_rate") -> DataFrame:
    """Specific energy rate over ``lag`` rows, in W/kg, within [-400, 300]; NULL over gaps of more than ``longest`` seconds."""
    w = ordered(key, time)
    step = lambda c: c - F.lag(c, lag).over(w)
    dt = step(seconds(time))
    tau = F.try_divide(F.col("temperature"), isa_temperature(F.col("altitude")))
    power = GRAVITY * step(F.col("altitude")) * tau + 0.5 * step(F.col("tas") * F.col("tas"))
    power = power + step(F.col("u_component_of_wind")) * F.col("tasx") + step(F.col("v_component_of_wind")) * F.col("tasy")
    return df.withColumn(out, clip(F.when(F.abs(dt) <= longest, F.try_divide(power, dt)), -400.0, 300.0))


def out_of_order(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Rows whose time isn't after the row before; none in a strictly increasing sequence."""
    return df.withColumn("_before", F.lag(time).over(ordered(key, time))).where(F.col(time) <= F.col("_before")).drop("_before")
