"""Mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.llm._shared import checkpointed, small, table

#: Production parameters: tokens a window, target weights by source (others count OTHER), parts of each queue.
WINDOW = 2048
WEIGHTS = {"src0": 4.0}
OTHER = 1.0
BUCKETS = 1024
#: Numbers (queues times boundaries) that the search for boundaries holds at once.
CELLS = 1 << 20
SCHEMA = "window_id long, window_offset long, source string, doc_id long, doc_start long, n_tokens long"


def words(text: Column) -> Column:
    """Tokens of a text: its maximal runs of characters other than white space."""
    return F.when(F.length(F.trim(text)) > 0, F.size(F.split(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+"))).otherwise(0)


class Plan:
    """Deficit round-robin over queues of ``totals`` tokens, by arithmetic from a queue's token offsets to windows and back.

    Credit grows for all queues together, by weight: at credit v a queue has been allotted w * v tokens and has given the
    whole number next to that, or all it has. Its deficit, w * v less what it gave, is half a token at most either way,
    and is never set back: it carries from window to window, past the windows in which other queues run dry. A window
    ends where the tokens given reach its size. So what a queue gives before a window follows from the window's number
    alone, and the plan holds two numbers for each queue, however many windows there are.
    """

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int = WINDOW):
        self.totals, self.weights, self.window = np.asarray(totals, np.int64), np.asarray(weights, np.float64), window
        if not (np.isfinite(self.weights) & (self.weights > 0)).all():
            raise ValueError("weights must be above zero and finite")
        self.end = float((self.totals / self.weights).max(initial=0.0)) + 1 / self.weights.min(initial=1.0) + 1

    def at(self, credit: np.ndarray) -> np.ndarray:
        """Tokens given by each queue (columns) at each credit (rows)."""
        return np.minimum(np.floor(credit[:, None] * self.weights + 0.5), self.totals).astype(np.int64)

    def before(self, windows: np.ndarray) -> np.ndarray:
        """Tokens given by each queue (columns) before each window (rows). Queues due at one credit give in their order."""
        out = np.empty((len(windows), len(self.totals)), np.int64)
        step = max(1, CELLS // max(len(self.totals), 1))
        for k in range(0, len(windows), step):
            want = np.minimum(windows[k : k + step] * self.window, self.totals.sum())
            lo, hi = np.zeros(len(want)), np.full(len(want), self.end)
            while True:
                middle = (lo + hi) / 2
                if ((middle <= lo) | (middle >= hi)).all():
                    break
                less = self.at(middle).sum(1) <= want
                lo, hi = np.where(less, middle, lo), np.where(less, hi, middle)
            given = self.at(lo)
            due = np.cumsum(self.at(hi) - given, axis=1)
            room = np.minimum(due, (want - given.sum(1))[:, None])
            out[k : k + step] = given + np.diff(room, axis=1, prepend=0)
        return out

    def window_of(self, k: int, offset: np.ndarray) -> np.ndarray:
        """The window of each token of a queue: near where its credit puts it, and exactly by what is given before windows."""
        credit = (offset + 0.5) / self.weights[k]
        guess = np.concatenate([self.at(credit[i : i + 1024]).sum(1) for i in range(0, len(credit), 1024)] or [np.zeros(0, np.int64)])
        lo = np.maximum((guess - len(self.totals) - 2) // self.window, 0)
        hi = (guess + len(self.totals) + 2) // self.window + 1
        while (hi - lo > 1).any():
            middle = (lo + hi) // 2
            known, place = np.unique(middle, return_inverse=True)
            ahead = self.before(known)[place, k] <= offset
            lo, hi = np.where(ahead, middle, lo), np.where(ahead, hi, np.maximum(middle, lo + 1))
        return lo

    def begin(self, k: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: the queue's first and last-plus-one offset in it, and where in the window its tokens begin."""
        known, place = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
        given = self.before(known)
        head, upto = given[:, k], given[:, :k].sum(1)
        first, after = place[: len(window)], place[len(window) :]
        return head[first], head[after], upto[after] - upto[first]

    def segments(self, k: int, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Index of the row, window, place in the window, place in the row and tokens of each piece of the rows [begin, begin + n)."""
        both = self.window_of(k, np.concatenate([begin, begin + n - 1]))
        lo, hi = both[: len(begin)], both[len(begin) :]
        count = hi - lo + 1
        row = np.repeat(np.arange(len(begin)), count)
        window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[row]
        a, b, off = self.begin(k, window)
        s, e = np.maximum(a, begin[row]), np.minimum(b, begin[row] + n[row])
        m = e > s
        return row[m], window[m], (off + s - a)[m], (s - begin[row])[m], (e - s)[m]


def pack(docs: DataFrame, window: int = WINDOW, weights: dict[str, float] = WEIGHTS, other: float = OTHER, buckets: int = BUCKETS) -> DataFrame:
    """Segments of documents that fill windows of ``window`` tokens, each window in the target proportions of the sources.

    Columns: window_id and window_offset (place of the first token in the window), source, doc_id, doc_start (place of
    the first token in the document), n_tokens. Every token of every document is in exactly one segment; every window
    but the last is full. While all sources last, after any number of windows a source has had its share of the tokens
    to within two tokens, as deficits carry over. A source that has run dry drops out, and the others share by weight.
    Weights are any finite numbers above zero; others raise ValueError.

    A source's queue is its documents ordered by hash bucket, doc_id, text hash and length. Token offsets in the queue
    come from sums by bucket and running sums within a bucket, so no task holds a whole source; the plan, two
    numbers for each source, turns offsets into windows by arithmetic. Text is read once and never shuffled.

    Defined results: null, empty and blank texts have no tokens and no segment. Null source is the source null, with the
    weight of the others. Null doc_id is kept. Rows that repeat are packed as often as they occur. An empty table gives
    an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    counted = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        words(F.col("text")).cast("long").alias("n"),
        F.xxhash64("text").alias("h"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"),
    ).where("n > 0")
    counted = checkpointed(counted)
    sums = checkpointed(counted.groupBy("source", "bucket").agg(F.sum("n").alias("bucket_n"), F.count("*").alias("rows")))
    totals = sorted(((r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("bucket_n").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    if not totals:
        return spark.createDataFrame([], SCHEMA)
    names = [r[0] for r in totals]
    plan = Plan(np.array([r[1] for r in totals]), np.array([float(weights.get(s, other)) for s in names]), window)
    queue = Window.partitionBy("source").orderBy("bucket")
    starts = sums.withColumn("base", F.sum("bucket_n").over(queue) - F.col("bucket_n")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "h", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counted.withColumn("upto", F.sum("n").over(inside) - F.col("n"))
        .join(small(starts, len(names) * buckets, 40), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select("source", "doc_id", "n", (F.col("base") + F.col("upto")).alias("begin"))
    )
    index = {s: k for k, s in enumerate(names)}

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            source = frame["source"].where(frame["source"].notna(), None)
            for s, rows in frame.groupby(source.map(index), sort=False):
                row, win, place, start, n = plan.segments(int(s), rows["begin"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
                yield pd.DataFrame({"window_id": win, "window_offset": place, "source": [names[int(s)]] * len(row), "doc_id": rows["doc_id"].array[row], "doc_start": start, "n_tokens": n})

    return placed.select("source", F.col("doc_id"), "n", "begin").mapInPandas(cut, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
