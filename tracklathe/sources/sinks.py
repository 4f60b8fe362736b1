"""Writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from tracklathe.sources.readers import versions


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def next_version(folder: str) -> int:
    return max(versions(folder), default=-1) + 1


def submission(df: DataFrame, folder: str, team: str = "team") -> str:
    """flight_id and tow as {team}_v{n}_.csv with the next free n; a table of predictions is small enough for one file."""
    if df.where("tow IS NULL").limit(1).count():
        raise ValueError("a prediction is unknown")
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{team}_v{next_version(folder)}_.csv"
    df.select("flight_id", "tow").orderBy("flight_id").toPandas().to_csv(path, index=False)
    return str(path)


def log_experiment(path: str, record: dict) -> None:
    with open(path, "a") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")
