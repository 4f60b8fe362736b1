"""Weighted boosted-tree regression on a feature set: encoding, fit, staged errors, prediction and search."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.operators.features import FeatureSet
from tracklathe.operators.scaling import TargetScaler

#: A missing number; trees split it off.
MISSING = -1e9
#: Rows of a part that a fit holds in memory, some 250 bytes each; larger parts, by the layout of files, are dealt out anew.
ROWS = 500_000


@dataclass
class OrdinalEncoder:
    """{column}_code: the category's place in sorted order; -1 for unknown and missing."""

    columns: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        for c in self.columns:
            values = df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).distinct()
            self.tables[c] = values.withColumn("_code", F.row_number().over(Window.orderBy(c)) - 1)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c, table in self.tables.items():
            side = F.broadcast(table.withColumnRenamed(c, "_category"))
            df = df.join(side, F.col(c).cast("string") == F.col("_category"), "left").withColumn(f"{c}_code", F.coalesce("_code", F.lit(-1))).drop("_code", "_category")
        return df

    def inputs(self, names: list[str]) -> list[str]:
        return [f"{n}_code" if n in self.columns else n for n in names]


def indexer(columns: list[str]) -> StringIndexer:
    """The same as a pipeline stage; the place after the last stands for unknown."""
    return StringIndexer(inputCols=columns, outputCols=[f"{c}_index" for c in columns], stringOrderType="alphabetAsc", handleInvalid="keep")


def split(df: DataFrame, key: str, seed: int, held: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, the latter an exact share, by hash of the key and seed: repeatable on any cluster."""
    n = df.count()
    order = Window.partitionBy("_part").orderBy("_hash", key)
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    # parts by range of the hash keep the ranks distributed: counts before a part plus the rank within it
    parted = hashed.withColumn("_part", F.shiftright("_hash", 56))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_c")
    ranked = parted.join(F.broadcast(before), "_part").withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.row_number().over(order))
    cut = round(n * held)
    drop = ["_hash", "_part", "_before", "_rank"]
    return ranked.where(F.col("_rank") > cut).drop(*drop), ranked.where(F.col("_rank") <= cut).drop(*drop)


@dataclass
class Params:
    trees: int = 50
    depth: int = 5
    rate: float = 0.1
    bins: int = 64
    rows: float = 0.88
    features: str = "0.737"
    seed: int = 0


@dataclass
class Fitted:
    encoder: OrdinalEncoder
    names: list[str]
    scaler: TargetScaler
    model: GBTRegressionModel

    def matrix(self, df: DataFrame) -> DataFrame:
        return assemble(self.encoder.transform(df), self.encoder.inputs(self.names))

    def predict(self, df: DataFrame, out: str = "tow") -> DataFrame:
        return self.scaler.inverse(self.model.transform(self.matrix(df)), "prediction", out)

    def importance(self) -> list[tuple[str, float]]:
        """Features by importance, greatest first."""
        return sorted(zip(self.names, self.model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))

    def staged(self, df: DataFrame, truth: str, every: int) -> list[tuple[int, float]]:
        """Error after each ``every`` trees."""
        scored = self.matrix(df).select(F.col(truth).alias("_truth"), *[c for c in df.columns if c != truth], "features")
        out = []
        for n in range(every, self.model.getNumTrees + 1, every):
            trees = zip(self.model.trees[:n], self.model.treeWeights[:n])
            part = scored
            total = F.lit(0.0)
            for k, (tree, weight) in enumerate(trees):
                part = tree.setPredictionCol(f"_p{k}").transform(part)
                total = total + F.col(f"_p{k}") * weight
            back = self.scaler.inverse(part.withColumn("_sum", total), "_sum", "_pred")
            out.append((n, back.agg(F.sqrt(F.avg(F.pow(F.col("_truth") - F.col("_pred"), 2)))).first()[0]))
        return out


def assemble(df: DataFrame, names: list[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in names})
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in even parts of at most some ROWS rows; as it is if it has no more in all."""
    n = df.count()
    return df.repartition(max(-(-n // ROWS), df.sparkSession.sparkContext.defaultParallelism)) if n > ROWS else df


def fit(features: FeatureSet, scaler: TargetScaler, params: Params = Params()) -> Fitted:
    """Boosted trees on scaled targets, each row weighed as the scaler says.

    Rows are drawn for each tree by part, so the fit depends on how rows are dealt out, within the chance of the draw.
    """
    encoder = OrdinalEncoder(features.categorical).fit(features.df)
    rows = scaler.fit(features.df).transform(encoder.transform(features.df)).where("label IS NOT NULL")
    gbt = GBTRegressor(maxIter=params.trees, maxDepth=params.depth, stepSize=params.rate, maxBins=params.bins, subsamplingRate=params.rows, featureSubsetStrategy=params.features, seed=params.seed, weightCol="weight")
    inputs = encoder.inputs(features.names)
    rows = dealt(rows.select(*inputs, "label", "weight"))
    return Fitted(encoder, features.names, scaler, gbt.fit(assemble(rows, inputs).select("features", "label", "weight")))


def candidates(space: dict[str, list], n: int, seed: int) -> Iterator[dict]:
    """n random choices from a space of parameters."""
    rng = random.Random(seed)
    for _ in range(n):
        yield {k: rng.choice(v) for k, v in space.items()}


def search(score: Callable[[dict], float], tried: Iterator[dict], known: dict[tuple, float] | None = None) -> tuple[dict, float]:
    """The choice with the least score; scores once known aren't computed again."""
    known = {} if known is None else known
    best = None
    for choice in tried:
        key = tuple(sorted(choice.items()))
        if key not in known:
            known[key] = score(choice)
        if best is None or known[key] < best[1]:
            best = (choice, known[key])
    return best


def neighbours(choice: dict, space: dict[str, list]) -> Iterator[dict]:
    """Choices one step away on the grid."""
    for k, values in space.items():
        i = values.index(choice[k])
        for j in (i - 1, i + 1):
            if 0 <= j < len(values):
                yield choice | {k: values[j]}


def climb(score: Callable[[dict], float], start: dict, space: dict[str, list], known: dict[tuple, float] | None = None) -> tuple[dict, float]:
    """Steps to the best neighbour until none is better."""
    known = {} if known is None else known
    here = search(score, iter([start]), known)
    while True:
        there = search(score, itertools.chain([here[0]], neighbours(here[0], space)), known)
        if there[1] >= here[1]:
            return here
        here = there


def remembered(log: DataFrame, names: list[str], score: str) -> dict[tuple, float]:
    """Scores of earlier experiments by parameters, the least of each."""
    rows = log.groupBy(*names).agg(F.min(score).alias(score)).collect()  # a row for each experiment that was run
    return {tuple(sorted((n, r[n]) for n in names)): r[score] for r in rows}


__all__ = ["Fitted", "OrdinalEncoder", "Params", "candidates", "climb", "fit", "indexer", "neighbours", "remembered", "search", "split"]
