"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.llm._shared import table

#: Production parameters. PER_CLASS bounds the labelled documents of each class that the model holds: the fit and the
#: broadcast don't grow with the data.
PER_CLASS = 2000
TERMS = 4096
#: Weight of the term that stands for repetition: one dimension against hundreds of trigrams.
REPEATS = 4.0
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.5
SEED = 5
#: Documents turned into features at once.
BLOCK = 256


def term_counts(texts: pa.Array, terms: int = TERMS) -> np.ndarray:
    """log(1 + count) of hashed byte trigrams of each whole text; last, REPEATS * log(1 + percentage of words equal to the one before)."""
    out = np.zeros((len(texts), terms + 1), np.float32)
    shift = np.uint32(32 - int(terms).bit_length() + 1)
    for i, text in enumerate(texts):
        raw = text.as_buffer()
        if raw is None or raw.size < 3:
            continue
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        out[i, :terms] = np.bincount(code >> shift, minlength=terms)
        tokens = raw.to_pybytes().split()
        out[i, terms] = 100 * sum(map(operator.eq, tokens, tokens[1:])) / max(len(tokens), 1)
    np.log1p(out, out=out)
    out[:, terms] *= REPEATS
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """``basis``: inverse document frequencies times the leading right singular vectors; ``vectors``: labelled, unit."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    terms: int = TERMS

    def embed(self, texts: pa.Array) -> np.ndarray:
        return unit(term_counts(texts, self.terms) @ self.basis)

    def vote(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of good quality among the k nearest, each with its similarity (0 at least) and its class's weight."""
        sims = x @ self.vectors.T
        k = min(k, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, near, 1), 0) * self.weights[self.labels[near]]
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-12), np.nan)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), np.nan)
        for i in range(0, len(texts), BLOCK):
            block = texts.slice(i, BLOCK)
            votes = self.vote(self.embed(block))
            blank = np.array([not t.is_valid or t.as_buffer().size < 3 for t in block])
            out[i : i + len(block)] = np.where(blank, np.nan, votes)
        return out


def fit(texts: list[str], labels: np.ndarray, terms: int = TERMS, rank: int = RANK, seed: int = SEED) -> Model:
    """Latent-semantic space of the labelled texts: randomised singular vectors of their tf-idf rows of unit length."""
    x = np.empty((len(texts), terms + 1), np.float32)
    for i in range(0, len(texts), BLOCK):
        x[i : i + BLOCK] = term_counts(pa.array(texts[i : i + BLOCK], pa.string()), terms)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    rank = min(rank, *x.shape)
    q = rng.standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    v = (q @ vt.T)[:, :rank]
    labels = np.asarray(labels, np.int64)
    sizes = np.maximum(np.bincount(labels, minlength=2), 1)
    return Model((idf[:, None] * v).astype(np.float32), unit(x @ v).astype(np.float32), labels, (len(labels) / (2 * sizes)).astype(np.float32), terms)


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, seed: int) -> DataFrame:
    """Up to ``per_class`` labelled documents of each class of ``column``, first by a hash of the id, with text.

    The labels are cut to that bound before they meet the documents, so ids of a bounded number are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    place = F.xxhash64("id", F.lit(seed))
    ids = known.where("label = 0").orderBy(place, "id").limit(per_class).unionByName(known.where("label = 1").orderBy(place, "id").limit(per_class))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text IS NOT NULL AND id IS NOT NULL").join(F.broadcast(ids), "id")
    return found.groupBy("id", "label").agg(F.max("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Model | None:
    rows = sorted(sample(docs, labels, "quality", per_class, seed).collect(), key=lambda r: r["id"])
    if len({r["label"] for r in rows}) < 2:
        return None
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows]), seed=seed)


def scorer(spark: SparkSession, model: Model | None):
    """A column function: the share of votes for good quality; NULL without a model and for texts under three bytes."""
    if model is None:
        return lambda text: F.lit(None).cast("double")
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(held.value.score(texts), pa.float64(), from_pandas=True)

    return votes


def kept(score: Column, threshold: float = THRESHOLD) -> Column:
    """NULL scores are kept: without evidence nothing is rejected."""
    return F.coalesce(score >= threshold, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score (votes for good quality, 0 to 1) and keep for every row of ``docs``.

    The model is fitted on at most ``per_class`` labelled documents of each class, a documented bound; their vectors are
    broadcast (1 MB for 4,000 vectors). Every document is then compared with all of them exactly, in blocks of matrix products,
    in one pass without a shuffle. A class that is rarer among the labelled documents weighs more, in proportion.

    Defined results: null text and text under three bytes score NULL and are kept; null doc_id is kept; repeated rows
    score alike, as often as they occur; contradicting labels of one id are dropped, and of repeated ids in the
    documents the greatest text is learned; equally similar neighbours are chosen by their place. Without labelled
    documents of both classes every score is NULL and all is kept. An empty table gives an empty table. Other columns
    are ignored.
    """
    model = train(docs, labels, per_class)
    votes = scorer(docs.sparkSession, model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), votes(F.col("text")).alias("score"))
    return scored.withColumn("keep", kept(F.col("score"), threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with their columns."""
    votes = scorer(docs.sparkSession, train(docs, labels))
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), votes(F.col("text")).alias("score"))
    return scored.where(kept(F.col("score"), threshold)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
