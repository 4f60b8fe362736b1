"""Feature tables with the roles of their columns, and their union."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.scalars import great_circle_nm, recode_slice, round_thousand, scale_mass
from tracklathe.sources.airports import add_local_times

KEY = "flight_id"


@dataclass(frozen=True)
class FeatureSet:
    """A table with a row a flight, and which columns are categorical, numeric, and numeric without scaling."""

    df: DataFrame
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    unscaled: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        """The order of the model's input."""
        return sorted(self.categorical) + sorted(self.numeric) + sorted(self.unscaled)


def others(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c != KEY)


def all_numeric(df: DataFrame) -> FeatureSet:
    return FeatureSet(df, numeric=others(df))


def all_unscaled(df: DataFrame) -> FeatureSet:
    return FeatureSet(df, unscaled=others(df))


def all_categorical(df: DataFrame) -> FeatureSet:
    return FeatureSet(df, categorical=others(df))


PORT = tuple("drct elevation_ft latitude_deg longitude_deg sknt tmpf vsby".split())


def flight_features(flights: DataFrame, airports: DataFrame, weather: DataFrame, distance: Callable[..., Column] = great_circle_nm) -> FeatureSet:
    """Flights with local times, weather, both airports and the distance between them."""
    df = add_local_times(flights, airports).join(weather, KEY, "left")
    for end in ("adep", "ades"):
        ports = airports.select(F.col("icao_code").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("latitude_deg", "longitude_deg", "elevation_ft")])
        df = df.join(F.broadcast(ports), end, "left")
    df = df.withColumn("bird_distance", distance(*[F.col(f"{c}_{end}") for end in ("adep", "ades") for c in ("latitude_deg", "longitude_deg")]))
    return FeatureSet(
        df,
        "adep ades aircraft_type airline country_code_adep country_code_ades dayofweek wtc".split(),
        "bird_distance flight_duration flown_distance taxiout_time".split(),
        ["local_hour_ades", "local_hour_adep", "weekofyear", *[f"{v}_{end}" for end in ("ades", "adep") for v in PORT]],
    )


def cruise_features(df: DataFrame) -> FeatureSet:
    """Slices marked as climb (-10000), descent (-20000) or unknown (under 100 points); altitudes to the nearest thousand, halves to even."""
    n = 1 + max(int(m[1]) for c in df.columns if (m := re.fullmatch(r"CruiseDeltaAlt_(\d+)", c)))
    new = {}
    for i in range(n):
        delta, count = F.col(f"CruiseDeltaAlt_{i}"), F.col(f"Cruisemachcount_{i}")
        altitude = round_thousand(F.col(f"CruiseMedianAlt_{i}"))
        # an unknown count isn't under 100
        known = F.coalesce(count, F.lit(100))
        new[f"CruiseMedianAlt_{i}"] = recode_slice(altitude, delta, known)
        new[f"Cruisemach_{i}"] = recode_slice(F.col(f"Cruisemach_{i}"), delta, known)
    return all_numeric(df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns]))


def mass_features(df: DataFrame, scale: bool = True, keep_limits: bool = False) -> FeatureSet:
    """Masses as shares of the range from mass_min to mass_max."""
    limits = ("mass_min", "mass_max")
    scaled = [c for c in df.columns if scale and "mass_" in c and c not in limits]
    new = {c: scale_mass(F.col(c), F.col("mass_min"), F.col("mass_max")) for c in scaled}
    out = df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns if c != "index"])
    return all_numeric(out if keep_limits else out.drop(*limits))


def union(flights: FeatureSet, tables: list[FeatureSet], exclude: tuple[str, ...] = ("C56X", "A310")) -> FeatureSet:
    """All tables joined to the flights, the lists of names put together, some aircraft types left out."""
    df = flights.df
    for t in tables:
        df = df.join(t.df, KEY, "left")
    if exclude:
        df = df.where(~F.col("aircraft_type").isin(*exclude))
    parts = [*tables, flights]
    return FeatureSet(df, *[sorted(c for p in parts for c in getattr(p, role)) for role in ("categorical", "numeric", "unscaled")])
