"""Scaling of the target, and of features, by group."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklathe.plans.lineage import small


class TargetScaler(Protocol):
    def fit(self, df: DataFrame) -> "TargetScaler": ...
    def transform(self, df: DataFrame) -> DataFrame: ...
    def inverse(self, df: DataFrame, prediction: str = "prediction", out: str = "tow") -> DataFrame: ...


@dataclass
class Identity:
    """The target as it is, all weights 1."""

    target: str = "tow"

    def fit(self, df: DataFrame) -> "Identity":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"label": F.col(self.target).cast("double"), "weight": F.lit(1.0)})

    def inverse(self, df: DataFrame, prediction: str = "prediction", out: str = "tow") -> DataFrame:
        return df.withColumn(out, F.col(prediction))


@dataclass
class Standard(Identity):
    """The target less its mean, by its population deviation; by 1 if it is constant or the table empty."""

    mean: float = 0.0
    scale: float = 1.0

    def fit(self, df: DataFrame) -> "Standard":
        mean, scale = df.agg(F.avg(self.target), F.stddev_pop(self.target)).first()
        self.mean, self.scale = mean or 0.0, scale or 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"label": (F.col(self.target) - self.mean) / self.scale, "weight": F.lit(1.0)})

    def inverse(self, df: DataFrame, prediction: str = "prediction", out: str = "tow") -> DataFrame:
        return df.withColumn(out, F.col(prediction) * self.scale + self.mean)


@dataclass
class ByGroup:
    """The target less the group's mean, by its scale; the weight is the scale's square.

    ``table`` has the group, mean and scale. A group that isn't in it raises. A scale of 0, of a constant group, counts as 1.
    The table has a row for each group and is broadcast if its measured size allows.
    """

    table: DataFrame | None = None
    target: str = "tow"
    by: str = "aircraft_type"

    def fit(self, df: DataFrame) -> "ByGroup":
        return self

    def joined(self, df: DataFrame) -> DataFrame:
        scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
        side = small(self.table.select(F.col(self.by), F.col("mean").alias("_mean"), scale.alias("_scale")))
        known = F.assert_true(F.col("_scale").isNotNull(), F.concat(F.lit(f"no scale for {self.by} "), F.coalesce(F.col(self.by), F.lit("NULL"))))
        return df.join(side, self.by, "left").withColumn("_scale", F.when(known.isNull(), F.col("_scale")))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.joined(df).withColumn("label", (F.col(self.target) - F.col("_mean")) / F.col("_scale"))
        return out.withColumn("weight", F.col("_scale") * F.col("_scale")).drop("_mean", "_scale")

    def inverse(self, df: DataFrame, prediction: str = "prediction", out: str = "tow") -> DataFrame:
        return self.joined(df).withColumn(out, F.col(prediction) * F.col("_scale") + F.col("_mean")).drop("_mean", "_scale")


def oew_mtow(masses: DataFrame, target: str = "tow", by: str = "aircraft_type") -> ByGroup:
    """The target's place between empty and greatest mass."""
    return ByGroup(masses.select(by, F.col("oew").alias("mean"), (F.col("mtow") - F.col("oew")).alias("scale")), target, by)


def group_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("scale"), F.count(F.lit(1)).alias("n"))


@dataclass
class Observed(ByGroup):
    """Mean and deviation of each group's target, of more than ``least`` rows each."""

    least: int = 10

    def fit(self, df: DataFrame) -> "Observed":
        stats = group_statistics(df, self.by, self.target)
        if stats.where(F.col("n") <= self.least).limit(1).count():
            raise ValueError(f"a group has {self.least} rows or fewer")
        self.table = stats.select(self.by, "mean", "scale")
        return self


@dataclass
class Learned(ByGroup):
    """The same, but groups that are small or missing get both from quadratics of mtow - oew, fitted to the other groups."""

    masses: DataFrame | None = None
    least: int = 10

    def fit(self, df: DataFrame) -> "Learned":
        stats = group_statistics(df, self.by, self.target).where(F.col("n") > self.least)
        rows = self.masses.join(stats, self.by, "left").select(self.by, "mtow", "oew", "mean", "scale").collect()  # a row for each aircraft type
        known = [r for r in rows if r["mean"] is not None]
        x = np.array([r["mtow"] - r["oew"] for r in known])
        a = np.vander(x, 3)
        mean, _, _, _ = np.linalg.lstsq(a, np.array([r["mean"] - r["oew"] for r in known]), rcond=None)
        scale, _, _, _ = np.linalg.lstsq(a, np.array([r["scale"] for r in known]), rcond=None)
        table = []
        for r in rows:
            if r["mean"] is None:
                at = r["mtow"] - r["oew"]
                guess = (float(np.polyval(mean, at) + r["oew"]), float(np.polyval(scale, at)))
                if min(guess) <= 0:
                    raise ValueError(f"no positive scale for {r[self.by]}")
                table.append((r[self.by], *guess))
            else:
                table.append((r[self.by], r["mean"], r["scale"]))
        self.table = df.sparkSession.createDataFrame(table, f"{self.by} string, mean double, scale double")
        return self


@dataclass
class GroupFeatureScaler:
    """z-scores of features by group; a group of under ten rows uses its synonym's statistics, and must have one.

    Every group that has a synonym uses the synonym's.
    """

    columns: list[str]
    synonyms: dict[str, str]
    by: str = "aircraft_type"
    least: int = 10
    table: DataFrame | None = None

    def fit(self, df: DataFrame) -> "GroupFeatureScaler":
        stats = df.groupBy(self.by).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{p}_{c}") for c in self.columns for p, f in (("m", F.avg), ("s", F.stddev_pop))])
        lone = [r[0] for r in stats.where(F.col("_n") < self.least).select(self.by).collect() if r[0] not in self.synonyms]
        if lone:
            raise ValueError(f"small groups without synonym: {lone}")
        self.table = stats.drop("_n")
        return self

    def joined(self, df: DataFrame) -> DataFrame:
        group = F.col(self.by)
        if self.synonyms:
            names = F.create_map(*[F.lit(x) for pair in self.synonyms.items() for x in pair])
            group = F.coalesce(names[group], group)
        return df.withColumn("_group", group).join(small(self.table.withColumnRenamed(self.by, "_group")), "_group", "left")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.joined(df)
        return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))) for c in self.columns}).select(*df.columns)

    def inverse(self, df: DataFrame) -> DataFrame:
        out = self.joined(df)
        return out.withColumns({c: F.col(c) * F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) + F.col(f"_m_{c}") for c in self.columns}).select(*df.columns)
