"""Helpers common to the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is below this many bytes.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        have = sc._jsc.sc().getCheckpointDir()
    return named or have.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder; its files go when the result does."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, row_bytes: int = 100) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` rows of ``row_bytes`` fit the limit; else as it is, to be shuffled."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def hex_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by ':'; DuckDB can compute the same."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
