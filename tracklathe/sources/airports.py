"""The airport dimension and local times."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.scalars import local_time, minute_of_day


def used_airports(tables: list[DataFrame]) -> DataFrame:
    """Distinct codes of departures and destinations, column icao_code."""
    codes = [t.select(F.col(end).alias("icao_code")) for t in tables for end in ("adep", "ades")]
    return reduce(DataFrame.unionByName, codes).where("icao_code IS NOT NULL").distinct()


def resolve_airports(raw: DataFrame, used: DataFrame, zone: Callable[[Column, Column], Column] | None = None, exclude: tuple[str, ...] = ("EGSY",)) -> DataFrame:
    """Airports in use, with icao_code: ident if a flight uses it, else gps_code if one does. ``zone`` maps latitude and longitude to a time zone."""
    rows = raw.where(~F.col("ident").isin(*exclude))
    flag = lambda c: used.select(F.col("icao_code").alias(c), F.lit(True).alias(f"by_{c}"))
    rows = rows.join(F.broadcast(flag("ident")), "ident", "left").join(F.broadcast(flag("gps_code")), "gps_code", "left")
    rows = rows.where("by_ident OR by_gps_code").withColumn("icao_code", F.when(F.col("by_ident"), F.col("ident")).otherwise(F.col("gps_code")))
    rows = rows.drop("ident", "by_ident", "by_gps_code")
    return rows.withColumn("time_zone", zone(F.col("latitude_deg"), F.col("longitude_deg"))) if zone else rows


def airport_faults(airports: DataFrame, used: DataFrame) -> DataFrame:
    """Codes in use without an airport, and codes with several: icao_code and fault. Empty if all is well."""
    missing = used.join(airports.select("icao_code"), "icao_code", "left_anti").select("icao_code", F.lit("missing").alias("fault"))
    several = airports.groupBy("icao_code").count().where("count > 1").select("icao_code", F.lit("several").alias("fault"))
    return missing.unionByName(several)


def add_local_times(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """local_actual_offblock_time, local_arrival_time, and local_hour_adep and local_hour_ades, which are minutes of the day."""
    for end, time in (("adep", "actual_offblock_time"), ("ades", "arrival_time")):
        zones = airports.select(F.col("icao_code").alias(end), F.col("time_zone").alias("_zone"))
        flights = flights.join(F.broadcast(zones), end, "left")
        flights = flights.withColumn(f"local_{time}", local_time(F.col(time), F.col("_zone"))).drop("_zone")
        flights = flights.withColumn(f"local_hour_{end}", minute_of_day(F.col(f"local_{time}")))
    return flights
