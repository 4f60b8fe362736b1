"""Departure and arrival instants corrected by the trajectory near the airports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.scalars import great_circle_nm, micros, shift_minutes

#: Feet a minute at which the last or first stretch is flown, and the radius of an airport in nautical miles.
RATE = 1000.0
RADIUS = 10.0


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: none on the side of a join that must be unique."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    if duplicated(df, key).limit(1).count():
        raise ValueError(f"{key} isn't unique")
    return df


def original_dates(flights: DataFrame) -> DataFrame:
    """flight_id, t_adep (off block plus taxi time) and t_ades as the flight table has them."""
    return flights.select("flight_id", shift_minutes(F.col("actual_offblock_time"), F.coalesce("taxiout_time", F.lit(None).cast("double"))).alias("t_adep"), F.col("arrival_time").cast("timestamp").alias("t_ades"))


def corrected_dates(flights: DataFrame, trajectories: DataFrame, airports: DataFrame, distance: Callable[..., Column] = great_circle_nm, radius: float = RADIUS, rate: float = RATE) -> DataFrame:
    """flight_id, t_adep, t_ades for flights with a trajectory.

    Arrival: the first point within ``radius`` of the destination, plus its altitude at ``rate``; departure: the last
    point within it of the origin, less its altitude. Altitude in feet, positions in degrees. Where that is unknown, also because the altitude of the
    chosen point is, the original instant stands. One pass over the trajectories: both ends aggregate together.
    """
    port = lambda end: F.broadcast(airports.select(F.col("icao_code").alias(end), F.col("latitude_deg").alias(f"lat_{end}"), F.col("longitude_deg").alias(f"lon_{end}")))
    ends = flights.select("flight_id", "adep", "ades").join(port("adep"), "adep", "left").join(port("ades"), "ades", "left")
    points = trajectories.select("flight_id", "timestamp", "latitude", "longitude", "altitude").join(ends, "flight_id")
    near = {e: distance(F.col("latitude"), F.col("longitude"), F.col(f"lat_{e}"), F.col(f"lon_{e}")) < radius for e in ("adep", "ades")}
    at = lambda e: F.when(near[e], F.struct(micros(F.col("timestamp")).alias("t"), F.col("altitude").alias("h")))
    order = lambda e: F.when(near[e], micros(F.col("timestamp")))
    found = points.groupBy("flight_id").agg(F.max_by(at("adep"), order("adep")).alias("a"), F.min_by(at("ades"), order("ades")).alias("b"))
    moved = lambda c, sign: F.timestamp_micros((F.col(f"{c}.t") + sign * F.round(F.col(f"{c}.h") / rate * 60e6)).cast("long"))
    found = found.select("flight_id", moved("a", -1).alias("c_adep"), moved("b", 1).alias("c_ades"))
    both = found.join(original_dates(flights), "flight_id")
    return both.select("flight_id", F.coalesce("c_adep", "t_adep").alias("t_adep"), F.coalesce("c_ades", "t_ades").alias("t_ades"))
