"""A corpus from raw documents to packed windows, as stages that each run one operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracklathe.llm import mixing, packing, quality, simhash, toxicity
from tracklathe.llm._shared import shared_folder, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, learned from the labels of documents that came in.

    Null texts and texts under three bytes are kept; without labels of both classes all are kept; rows that repeat are
    judged alike; an empty table stays empty; all columns, whatever their names, are returned as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic, learned from the labels of documents that came in.

    Null, empty and blank texts are kept; without labels of both classes all are kept; rows that repeat are judged alike;
    an empty table stays empty; all columns are returned as they are.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id, null last, then the least text hash.

    Null texts are all kept; texts without words are copies of each other; of rows that repeat one stays; an empty table
    stays empty; all columns are returned as they are.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are dropped or repeated.

    Null texts count as empty and null sources as one source; a source of empty texts alone gets no copies; an empty
    table stays empty; all columns, one called copies too, are returned as they are.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments of documents that fill windows in the target proportions.

    Null, empty and blank texts give no segment; null source and null doc_id are kept; rows that repeat are packed as
    often as they occur; an empty table gives no windows; other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("toxicity", clean),
    ("SimHash near-dedup", single),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The stages fit models and walk graphs, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result but the last is written to the shared folder and read again.

    A written result goes once the next one is written; the last one stays, as the lazy result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                dropped(spark, f"{folder}/{k - 1}")
    return docs
