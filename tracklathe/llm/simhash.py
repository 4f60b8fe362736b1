"""SimHash near-duplicates by an inverted index of positional bytes with count filtering."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklathe.llm._shared import checkpointed, small, table
from tracklathe.llm.graph import components

#: Production parameters: 64-bit fingerprints for each document; bits that may differ in one of them, and in all together.
PRINTS = 16
BITS = 3
TOTAL = 160
SEED = 3
#: Bits that may differ, in place of BITS, in a fingerprint under whose key a pair meets, in the query alone:
#: few pairs within TOTAL differ in more, and nearly all unrelated pairs that meet do.
NEAR = 10
#: Positional bytes, of eight, that two fingerprints within BITS bits are sure to share.
SHARED = 8 - BITS
#: Rows of the table of signs to which words are hashed.
SLOTS = 1 << 16
#: Documents listed in one row of the result; a larger group takes several rows with the same keep_id.
LIST = 10_000


@lru_cache(1)
def signs() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (SLOTS, 64 * PRINTS), np.int8) * 2 - 1).astype(np.int8)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Rows of PRINTS 64-bit fingerprints. A word weighs 16 * (1 + log of its count), rounded, so sums are exact."""
    table = signs()
    out = np.zeros((len(texts), 8 * PRINTS), np.uint8)
    slot: dict[str, int] = {}
    weight = [round(16 * (1 + math.log(n))) if n else 0 for n in range(1024)]
    for i, text in enumerate(texts):
        counts = Counter((text or "").lower().split())
        if not counts:
            continue
        for w in [w for w in counts if w not in slot]:
            slot[w] = zlib.crc32(w.encode()) & (SLOTS - 1)
        rows = np.fromiter((slot[w] for w in counts), np.int64, len(counts))
        w = np.fromiter((weight[n] if n < 1024 else round(16 * (1 + math.log(n))) for n in counts.values()), np.float32, len(counts))
        total = np.zeros(64 * PRINTS, np.float32)
        for k in range(0, len(rows), 4096):
            total += w[k : k + 4096] @ table[rows[k : k + 4096]].astype(np.float32)
        out[i] = np.packbits(total > 0)
        if len(slot) > 200_000:
            slot.clear()
    return out.view(">i8").astype(np.int64)


def prints(text: Column | str) -> Column:
    """fingerprints() as a column, an array of PRINTS longs."""
    return F.arrow_udf(print_batches, T.ArrayType(T.LongType()))(text)


def print_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = [fingerprints(texts.slice(k, 500).to_pylist()) for k in range(0, len(texts), 500)]
        flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * PRINTS), pa.array(flat))


def shared_bytes(a: Column, b: Column) -> Column:
    """Positional bytes in which two 64-bit fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit((0xFF << 8 * k) - ((1 << 64) if k == 7 else 0))) == 0, 1).otherwise(0) for k in range(8)), F.lit(0))


def close(a: Column, b: Column, near: int) -> Column:
    """Fingerprints, met under one key, that differ in ``near`` bits at most; for BITS or fewer that share SHARED bytes."""
    apart = F.bit_count(a.bitwiseXOR(b)) <= near
    return (shared_bytes(a, b) >= SHARED) & apart if near <= BITS else apart


def postings(nodes: DataFrame) -> DataFrame:
    """The inverted index: key, node, print. A key is three positional bytes of one half of one fingerprint.

    Two fingerprints that share 5 of 8 bytes share 3 of the 4 of one half, hence one of the eight keys, so every pair
    that the count filter would retain meets under some key, and one byte alone, too common to index, is never a key.
    """
    one = nodes.select("node", F.posexplode("prints").alias("r", "print"))
    keys = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("print", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        for k in range(4):
            part = bits.bitwiseAND(F.lit(0xFFFFFFFF & ~(0xFF << 8 * k)))
            keys.append(part.bitwiseOR(F.shiftleft((F.col("r") * 8 + F.lit(4 * half + k)).cast("long"), 32)))
    return one.select("node", "print", F.explode(F.array(*keys)).alias("key"))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b whose fingerprints together differ in TOTAL bits at most."""
    left = nodes.select(F.col("node").alias("a"), F.col("prints").alias("pa"))
    right = nodes.select(F.col("node").alias("b"), F.col("prints").alias("pb"))
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.distinct().join(left, "a").join(right, "b").where(apart <= TOTAL).select("a", "b")


def grouped(docs: DataFrame, near: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows id, h (hash of the text), n (rows alike), node; and the components node, component of linked nodes.

    A node is a distinct set of fingerprints, so exact copies, however many, are one node. Under each key all nodes are
    first compared with one of them; then only nodes that aren't yet in one component are compared with each other. A
    bucket full of copies of one text thus costs as many comparisons as it has nodes, and no pair that could join two
    components is left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    rows = checkpointed(rows.select("id", "h", prints("text").alias("prints")).groupBy("id", "h", "prints").agg(F.count("*").alias("n")))
    nodes = checkpointed(rows.select("prints").distinct().withColumn("node", F.monotonically_increasing_id()))
    bucket = Window.partitionBy("key")
    full = postings(nodes).withColumn("size", F.count("*").over(bucket)).withColumn("hub", F.min(F.struct("node", "print")).over(bucket)).where("size > 1")
    full = checkpointed(full.select("key", "node", "print", "hub"))
    spokes = full.where((F.col("node") != F.col("hub.node")) & close(F.col("print"), F.col("hub.print"), near)).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    first = checkpointed(verified(spokes, nodes))
    joined = checkpointed(components(first))
    labelled = full.join(joined, "node", "left").select("key", "node", "print", F.coalesce("component", "node").alias("c"))
    mixed = labelled.withColumn("lo", F.min("c").over(bucket)).withColumn("hi", F.max("c").over(bucket)).where("lo < hi").select("key", "node", "print", "c")
    x, y = mixed.alias("x"), mixed.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & close(F.col("x.print"), F.col("y.print"), near))
    second = checkpointed(verified(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), nodes))
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    return rows.join(nodes, "prints").select("id", "h", "n", "node"), checkpointed(components(links))


def members(docs: DataFrame, near: int = BITS) -> DataFrame:
    """id, h, n and group for every distinct row with text."""
    rows, joined = grouped(docs, near)
    return rows.join(joined, "node", "left").select("id", "h", "n", F.coalesce("component", "node").alias("group"))


def near_duplicates(docs: DataFrame, near: int = BITS) -> DataFrame:
    """Groups of near-duplicate documents: keep_id (least doc_id) and doc_ids, sorted, LIST to a row.

    Documents are linked if one of their sixteen 64-bit SimHash fingerprints of words differs in three bits at most and all
    together in 160 of 1024 (an angle of 28 degrees); a group is what links connect. The result equals brute force over all
    pairs: two fingerprints within three bits are sure to share five positional bytes, and the index finds all that do.
    With ``near`` above three, as in the query, pairs are linked that meet under any key (three positional bytes of one
    half of a fingerprint), differ in ``near`` bits at most there, and in TOTAL at most together. Words are split at
    white space, so of texts in scripts without spaces only copies that keep their lines are found.

    Defined results: null text is in no group; texts without words count as copies of each other; a row with null doc_id
    takes part, and is listed as null, last; rows that repeat a doc_id are listed as often as they occur. A text without
    near copies is in no row. An empty table gives an empty table. Other columns are ignored.
    """
    found = checkpointed(members(docs, near))
    sizes = found.groupBy("group").agg(F.sum("n").alias("size"), F.min("id").alias("keep_id")).where("size > 1")
    rows = found.join(sizes, "group").select("group", "keep_id", F.explode(F.array_repeat("id", F.col("n").cast("int"))).alias("id"))
    order = Window.partitionBy("group").orderBy(F.col("id").asc_nulls_last())
    rows = rows.withColumn("part", F.floor((F.row_number().over(order) - 1) / LIST))
    lists = rows.groupBy("group", "part", "keep_id").agg(F.collect_list(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("ids"))
    return lists.select("keep_id", F.transform(F.array_sort("ids"), lambda x: x["id"]).alias("doc_ids"))


def drop_near_duplicates(docs: DataFrame, near: int = BITS) -> DataFrame:
    """``docs`` with one row of each group: the least doc_id (null last), then text hash, then any of equal rows."""
    found = checkpointed(members(docs, near))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    best = found.groupBy("group").agg(F.min(rank).alias("best"), F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 OR most > 1")
    rows = checkpointed(found.join(best, "group").withColumn("keep", rank == F.col("best")).where("NOT keep OR n > 1").select("id", "h", "keep"))
    lose, twice = rows.where("NOT keep").select("id", "h"), rows.where("keep").select("id", "h")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumns({"i": F.col("row.doc_id").cast("long"), "t": F.xxhash64("row.text"), "full": F.col("row.text").isNotNull()})
    same = lambda keys: F.col("full") & F.col("i").eqNullSafe(keys["id"]) & (F.col("t") == keys["h"])
    lose = small(lose, lose.count(), 40)
    kept = row.join(lose, same(lose), "left_anti")
    if repeated := twice.count():
        twice = small(twice, repeated, 40)
        alone = kept.join(twice, same(twice), "left_anti").select("row")
        one = kept.join(twice, same(twice), "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("i", "t").orderBy(F.lit(0)))).where("k = 1").select("row")
        return alone.unionByName(one).select("row.*")
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NEAR)
