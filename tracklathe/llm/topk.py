"""Exact top-k search by MaxScore over document shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.llm._shared import table

#: Production parameters: results a query, BM25's constants, digits to which scores are rounded before they are ranked.
K = 10
K1 = 1.2
B = 0.75
DIGITS = 6
#: Queries whose terms are searched for in one pass over the documents.
BATCH = 2000
#: Documents that make one shard's inverted index; postings read at once in a traversal.
SHARD = 8_000
STRIDE = 2048
WORD = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORD.findall(text.lower()) if text else []


@dataclass
class Index:
    """One shard: for each query term its documents (ascending places), BM25 scores and their bound."""

    ids: np.ndarray
    docs: dict[str, np.ndarray]
    scores: dict[str, np.ndarray]
    bounds: dict[str, float]


def build(ids: list, counts: list[dict[str, int]], lengths: list[int], idf: dict[str, float], average: float) -> Index:
    """Postings of the query terms that the shard's documents hold. ``ids`` ascend, so places order as ids do."""
    docs: dict[str, list[int]] = {}
    freqs: dict[str, list[int]] = {}
    for place, found in enumerate(counts):
        for t, n in found.items():
            docs.setdefault(t, []).append(place)
            freqs.setdefault(t, []).append(n)
    norm = K1 * (1 - B + B * np.asarray(lengths, np.float64) / average)
    at = {t: np.asarray(d, np.int64) for t, d in docs.items()}
    scores = {t: idf[t] * (f := np.asarray(freqs[t], np.float64)) * (K1 + 1) / (f + norm[d]) for t, d in at.items()}
    return Index(np.asarray(ids), at, scores, {t: float(s.max()) for t, s in scores.items()})


def max_score(index: Index, query: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents, best first, lower places first among equals.

    Terms in ascending order of their bounds; the longest run of them whose bounds can't lift a document past the k-th
    score is non-essential. Only the essential postings are traversed, STRIDE places at a time; a document met there
    is looked up in the non-essential lists, largest bound first, while it can still compete.
    """
    query = sorted((t for t in query if t in index.docs), key=lambda t: (index.bounds[t], t))
    slack = 10.0**-DIGITS  # scores within rounding of the k-th may tie with it
    reach = np.concatenate([[0.0], np.cumsum([index.bounds[t] for t in query])])
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    least = -np.inf
    essential = 0
    cursors = dict.fromkeys(query, 0)
    for low in range(0, len(index.ids), STRIDE):
        while essential < len(query) and reach[essential + 1] < least - slack:
            essential += 1
        if essential == len(query):
            break
        high = low + STRIDE
        score, seen = np.zeros(STRIDE), np.zeros(STRIDE, bool)
        for t in query[essential:]:
            d = index.docs[t]
            a = int(np.searchsorted(d, low)) if cursors[t] < 0 else cursors[t]
            b = a + int(np.searchsorted(d[a : a + STRIDE], high))
            cursors[t] = b
            score[d[a:b] - low] += index.scores[t][a:b]
            seen[d[a:b] - low] = True
        live = np.flatnonzero(seen)
        value = score[live]
        for j in range(essential - 1, -1, -1):
            compete = value + reach[j + 1] >= least - slack
            live, value = live[compete], value[compete]
            if not len(live):
                break
            t = query[j]
            d = index.docs[t]
            at = np.minimum(np.searchsorted(d, live + low), len(d) - 1)
            value = value + np.where(d[at] == live + low, index.scores[t][at], 0.0)
            cursors[t] = -1
        if len(live):
            value = np.round(value, DIGITS)
            best_at, best = np.concatenate([best_at, live + low]), np.concatenate([best, value])
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
            least = best[-1] if len(best) == k else -np.inf
    return best_at, best


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents by BM25 for every row of ``queries``; exact.

    One pass counts documents, words and the documents that hold each query term; a second builds, shard by shard, an
    inverted index of the query terms alone, runs MaxScore for every query and emits the shard's best k, which are
    merged by query. Documents are never shuffled: what moves is k rows a shard and query. Queries are searched in
    batches of BATCH, so what is sent to the tasks is bounded whatever their number.

    A document's score is the sum over the distinct terms of the query, with idf = ln(1 + (N - n + 0.5) / (n + 0.5)),
    rounded to six digits; ties go to the lower doc_id. Only documents that share a term with the query are results.

    Defined results: null and empty texts count as documents without words and are never found; rows with null doc_id
    are counted and can be found, and rank last among ties; repeated rows are found as often as they occur; a query
    without terms, or whose terms no document has, gives no rows; queries that repeat give their rows again. Empty
    tables give an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = [(r["item_id"], sorted(set(terms(r["text"])))) for r in queries.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()]
    found = None
    for start in range(0, max(len(wanted), 1), BATCH):
        batch = [(start + i, item, q) for i, (item, q) in enumerate(wanted[start : start + BATCH])]
        part = _search(spark, text, batch, k)
        found = part if found is None else found.unionByName(part)
    return found


def _search(spark: SparkSession, text: DataFrame, batch: list[tuple[int, int | None, list[str]]], k: int) -> DataFrame:
    vocabulary = frozenset(t for _, _, q in batch for t in q)
    held = spark.sparkContext.broadcast((vocabulary, [(n, q) for n, _, q in batch]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = held.value
        have: dict[str, int] = {}
        docs = size = 0
        for b in batches:
            for t in b.column(0):
                words = terms(t.as_py())
                docs, size = docs + 1, size + len(words)
                for w in known.intersection(words):
                    have[w] = have.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"term": [None, *have], "docs": pa.array([docs, *have.values()], pa.int64()), "words": pa.array([size] + [0] * len(have), pa.int64())})

    stats = text.select("text").mapInArrow(count, "term string, docs long, words long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()
    total = next((r for r in stats if r["term"] is None), None)
    if total is None or not total["words"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score double")
    n, average = total["docs"], total["words"] / total["docs"]
    idf = spark.sparkContext.broadcast({r["term"]: float(np.log(1 + (n - r["docs"] + 0.5) / (r["docs"] + 0.5))) for r in stats if r["term"] is not None})

    def shard(ids: list, counts: list, lengths: list) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        index = build([ids[i] for i in order], [counts[i] for i in order], [lengths[i] for i in order], idf.value, average)
        rows: dict[str, list] = {"query": [], "doc_id": [], "score": []}
        for q, words in held.value[1]:
            at, best = max_score(index, words, k)
            rows["query"] += [q] * len(at)
            rows["doc_id"] += [index.ids[i] for i in at]
            rows["score"] += best.tolist()
        return pa.RecordBatch.from_arrays([pa.array(rows["query"], pa.int64()), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["score"], pa.float64())], ["query", "doc_id", "score"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        ids, counts, lengths = [], [], []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms(t.as_py())
                here: dict[str, int] = {}
                for w in words:
                    if w in known:
                        here[w] = here.get(w, 0) + 1
                ids.append(i)
                counts.append(here)
                lengths.append(len(words))
                if len(ids) == SHARD:
                    yield shard(ids, counts, lengths)
                    ids, counts, lengths = [], [], []
        if ids:
            yield shard(ids, counts, lengths)

    local = text.mapInArrow(shards, "query long, doc_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    merged = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, item) for n, item, _ in batch], "query long, item_id long")
    return merged.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY term),
s AS (
  SELECT item_id, doc_id, round(sum(idf * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * len / average))), {DIGITS}) AS score
  FROM q JOIN p USING (term) JOIN i USING (term), n GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
WHERE rank <= {K}
"""
