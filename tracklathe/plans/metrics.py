"""Errors of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(df: DataFrame, truth: str, prediction: str, by: dict[str, Column] | None = None) -> DataFrame:
    """Root mean squared error, overall or by group, and the number of rows."""
    error = F.col(truth) - F.col(prediction)
    stats = [F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*[c.alias(k) for k, c in by.items()]).agg(*stats) if by else df.agg(*stats)


def by_type_and_month(df: DataFrame, truth: str = "tow", prediction: str = "prediction", kind: str = "aircraft_type", date: str = "date") -> tuple[DataFrame, DataFrame, DataFrame]:
    return rmse(df, truth, prediction), rmse(df, truth, prediction, {kind: F.col(kind)}), rmse(df, truth, prediction, {"month": F.month(date)})


def ensemble(predictions: DataFrame, key: str = "flight_id", value: str = "tow") -> DataFrame:
    """Mean of all versions by key; raises unless every key has as many as any other."""
    means = predictions.groupBy(key).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
    if means.agg(F.min("_n") != F.max("_n")).first()[0]:
        raise ValueError("versions don't hold the same keys")
    return means.drop("_n")
