"""Weather reports near the airports: the nearest, and whether any within a radius has a code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.scalars import feature_token
from tracklathe.operators.spatial import nearest, scaled

VARIABLES = tuple("alti drct gust mslp relh sknt skyc1 skyc2 skyc3 skyc4 skyl1 skyl2 skyl3 skyl4 tmpf vsby wxcodes".split())
CODES = tuple("FG TS +TS VCTS +VCTS".split())
RADII = (1, 2, 3, 4, 5, 6)
GEO_SCALE, HOUR_SCALE = 1.0, 1.0


def placed(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Flights with the positions of both airports; flights with an unknown airport drop out."""
    for end in ("adep", "ades"):
        ports = airports.select(F.col("icao_code").alias(end), F.col("latitude_deg").alias(f"lat_{end}"), F.col("longitude_deg").alias(f"lon_{end}"))
        flights = flights.join(F.broadcast(ports), end)
    return flights


def weather(flights: DataFrame, airports: DataFrame, metars: DataFrame, variables: Sequence[str] = VARIABLES, geo_scale: float = GEO_SCALE, hour_scale: float = HOUR_SCALE) -> DataFrame:
    """flight_id and each variable of the nearest report at departure and at arrival, by the uncorrected times."""
    flights = placed(flights, airports)
    out = flights.select("flight_id")
    sites = scaled(F.col("lat"), F.col("lon"), F.col("valid"), geo_scale, hour_scale)
    metars = metars.select(*dict.fromkeys(c for c in ("lat", "lon", "valid", "station", *variables) if c in metars.columns))
    ties = [c for c in ("valid", "station", "lat", "lon") if c in metars.columns]
    for end, time in (("adep", "actual_offblock_time"), ("ades", "arrival_time")):
        asked = flights.select("flight_id", f"lat_{end}", f"lon_{end}", time)
        found = nearest(asked, metars, scaled(F.col(f"lat_{end}"), F.col(f"lon_{end}"), F.col(time), geo_scale, hour_scale), sites, "flight_id", ties)
        out = out.join(found.select(F.col("l.flight_id").alias("flight_id"), *[F.col(f"r.{v}").alias(f"{v}_{end}") for v in variables]), "flight_id", "left")
    return out


def thunder(flights: DataFrame, airports: DataFrame, metars: DataFrame, codes: Sequence[str] = CODES, radii: Sequence[int] = RADII, geo_scale: float = GEO_SCALE, hour_scale: float = HOUR_SCALE) -> DataFrame:
    """flight_id and thunder_max_{code}_{radius}_ades: 1.0 if a report within the radius of the arrival has the code, else 0.0.

    The nearest report with a code tells for every radius. A code is a further coordinate, in steps wider than any radius,
    so one search serves them all.
    """
    flights = placed(flights, airports).select("flight_id", "lat_ades", "lon_ades", "arrival_time")
    reports = metars.select("lat", "lon", "valid", "wxcodes").where("wxcodes IS NOT NULL")
    step = 2.0 * max(radii) + 1
    every = F.array(*[F.struct(F.lit(i).alias("code"), F.lit(c).alias("text")) for i, c in enumerate(codes)])
    asked = flights.withColumn("code", F.explode(F.array(*map(F.lit, range(len(codes))))))
    asked = asked.withColumn("asked", F.struct("flight_id", "code"))
    reports = reports.withColumn("code", F.explode(F.transform(F.filter(every, lambda c: F.col("wxcodes").contains(c["text"])), lambda c: c["code"]))).drop("wxcodes")
    asked_at = [*scaled(F.col("lat_ades"), F.col("lon_ades"), F.col("arrival_time"), geo_scale, hour_scale), F.col("code") * step]
    found = nearest(asked, reports, asked_at, [*scaled(F.col("lat"), F.col("lon"), F.col("valid"), geo_scale, hour_scale), F.col("code") * step], "asked", (), radius=float(max(radii)))
    flags = {f"thunder_max_{feature_token(c)}_{r}_ades": F.max(F.when((F.col("distance") <= r) & (F.col("l.code") == i), 1.0).otherwise(0.0)) for r in radii for i, c in enumerate(codes)}
    found = found.groupBy(F.col("l.flight_id").alias("flight_id")).agg(*[c.alias(k) for k, c in flags.items()])
    return flights.select("flight_id").join(found, "flight_id", "left").fillna(0.0, list(flags))
