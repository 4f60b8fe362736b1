"""Typed readers. Floats come without NaN."""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklathe.functions.scalars import cast_columns, iso_day, iso_week, minute_of_day, nan_to_null, to_si

FLIGHTS = {
    **dict.fromkeys("adep ades aircraft_type airline callsign country_code_adep country_code_ades name_adep name_ades wtc".split(), "string"),
    **dict.fromkeys("flight_duration flown_distance taxiout_time tow".split(), "double"),
    "flight_id": "long",
    **dict.fromkeys("actual_offblock_time arrival_time date".split(), "timestamp"),
}
METARS = {
    "station": "string",
    "valid": "timestamp",
    **dict.fromkeys("alti drct dwpf elevation feel gust lat lon mslp p01i relh sknt skyl1 skyl2 skyl3 skyl4 tmpf vsby".split(), "double"),
    **dict.fromkeys("metar skyc1 skyc2 skyc3 skyc4 wxcodes".split(), "string"),
}
MASSES = {
    "aircraft_type": "string",
    **dict.fromkeys("ceiling mfc mlw mmo mtow oew vmo".split(), "double"),
    "source": "string",
    "range": "double",
}


def csv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Text columns by header: files may order columns as they like; types come from casts by name."""
    return spark.read.options(header=True, **options).csv(path)


def flights_csv(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(cast_columns(csv(spark, path), FLIGHTS))


def with_date_parts(flights: DataFrame) -> DataFrame:
    off, on = F.col("actual_offblock_time"), F.col("arrival_time")
    return flights.withColumns({"dayofweek": iso_day(off), "weekofyear": iso_week(off), "arrival_minutes": minute_of_day(on), "actual_offblock_minutes": minute_of_day(off)})


def flights(spark: SparkSession, path: str) -> DataFrame:
    return with_date_parts(nan_to_null(cast_columns(spark.read.parquet(path), FLIGHTS)))


def raw_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(cast_columns(spark.read.parquet(path), {"flight_id": "long", "timestamp": "timestamp"}))


def trajectories(spark: SparkSession, path: str, si: bool = True) -> DataFrame:
    df = nan_to_null(cast_columns(spark.read.parquet(path), {"flight_id": "long", "icao24": "long", "timestamp": "timestamp"}))
    return to_si(df) if si else df


def metars(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder; lines that begin with # are comments; M is an unknown value."""
    return nan_to_null(cast_columns(csv(spark, folder, comment="#", nullValue="M"), METARS))


def airports_csv(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(cast_columns(csv(spark, path), dict.fromkeys("elevation_ft latitude_deg longitude_deg".split(), "double")))


def aircraft_masses(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(cast_columns(csv(spark, path), MASSES))


def table_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of files, one a day for example, as one table."""
    return nan_to_null(spark.read.parquet(folder))


@dataclass(frozen=True)
class Config:
    """Settings by name, as text."""

    values: dict[str, str]

    def __getattr__(self, name: str) -> str:
        try:
            return self.values[name]
        except KeyError as e:
            raise AttributeError(name) from e


def read_config(path: str) -> Config:
    """Lines ``name = value``; # begins a comment; values are taken literally."""
    found = {}
    for line in Path(path).read_text().splitlines():
        name, sign, value = line.partition("#")[0].partition("=")
        if sign:
            found[name.strip()] = value.strip()
    return Config(found)


def read_json(path: str, default: dict | None = None) -> dict:
    """The object in a file; the default where the file is missing."""
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else dict(default or {})


VERSION = re.compile(r"_v(\d+)_")


def version_of(name: str) -> int | None:
    """The number in .._v7_.csv; None for other files, which are left alone."""
    found = VERSION.search(name)
    return int(found[1]) if found else None


def versions(folder: str) -> dict[int, str]:
    return {v: str(p) for p in Path(folder).glob("*.csv") if (v := version_of(p.name)) is not None}


def predictions(spark: SparkSession, folder: str, first: int, stop: int) -> DataFrame:
    """flight_id, tow and version of the versions first .. stop-1."""
    known = versions(folder)
    parts = [cast_columns(csv(spark, known[v]), {"flight_id": "long", "tow": "double"}).select("flight_id", "tow", F.lit(v).alias("version")) for v in range(first, stop)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """The log of experiments, one JSON object a line."""
    return spark.read.json(path)


def literal(text: str):
    """A Python literal, without evaluating code."""
    return ast.literal_eval(text)


def schema(kinds: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(k, {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "timestamp": T.TimestampType()}[v]) for k, v in kinds.items()])
