"""Embedding near-duplicates by counting collisions of one-dimensional projections: pairs, or classes with numbers of links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.llm._shared import checkpointed, small, table
from tracklathe.llm.graph import components

#: Production parameters: least cosine of a pair; lines on which collisions are counted; half the window; recall the count
#: is set for, and recall of the sorted groups of lines in which pairs meet.
COSINE = 0.95
LINES = 24
HALF = 0.45
RECALL = 0.95
MEET = 0.97
SEED = 13
#: Width of a cell of a sorted line, in distances of a pair just at the least cosine; unrelated vectors that one may meet in a group.
WIDTH = 8.0
MATES = 8.0
#: Steps of a projection in half a window; a projection is kept as one byte.
STEPS = 16
#: Members from which a class found by leaders is no more compared with itself; numbers in a block of vectors compared at once.
WHOLE = 64
BLOCK = 1 << 19


def collide(distance: float, half: float = HALF) -> float:
    """Chance that two vectors at a distance fall within half a window on one random line."""
    return math.erf(half / distance / math.sqrt(2))


def needed(cosine: float = COSINE, recall: float = RECALL, lines: int = LINES) -> int:
    """The largest count that a pair just at ``cosine`` reaches with at least the chance ``recall``."""
    p = collide(math.sqrt(2 - 2 * cosine))
    tail = 0.0
    for n in range(lines, -1, -1):
        tail += math.comb(lines, n) * p**n * (1 - p) ** (lines - n)
        if tail >= recall:
            return n
    return 0


def together(distance: float, width: float) -> float:
    """Chance that two vectors at a distance fall in one cell of a random line, cut at random."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / math.sqrt(2 * math.pi) / t * (1 - math.exp(-t * t / 2))


def groups(n: int, crowd: float, near: float) -> tuple[int, int]:
    """Lines of a group, and groups, for ``n`` vectors of which two share a line's cell with the chance ``crowd``, pairs with ``near``.

    As many lines as leave a vector MATES unrelated ones in its cells of a group; as many groups as find a pair with the
    chance MEET. Lines grow with the logarithm of n, groups with a small power of it.
    """
    lines = 1
    while n * crowd**lines > MATES and lines < 64:
        lines += 1
    return lines, math.ceil(math.log(1 - MEET) / math.log(1 - near**lines))


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of each length in a column of vectors; a null in a vector is NaN."""
    widths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(widths) - widths
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: vectors scaled to unit length, without those that can't be."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            b = batch.slice(k, 2048)
            for rows, x in vectors_of(b.column(1)):
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
                unit = x[good] / norm[good, None]
                starts = np.arange(len(unit) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[rows[good]]), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(unit.ravel()))], ["id", "v"])


def projected(x: np.ndarray) -> np.ndarray:
    """Projections on LINES lines, in steps, from -127 to 127."""
    lines = np.random.default_rng(SEED).standard_normal((x.shape[1], LINES))
    return np.clip(np.rint(x @ lines * (STEPS / HALF)), -127, 127).astype(np.int64)


def keys(x: np.ndarray, width: float, lines: int, count: int) -> np.ndarray:
    """For each vector and group, a hash of its cells on the group's lines."""
    out = np.empty((len(x), count), np.int64)
    for g in range(count):
        rng = np.random.default_rng([SEED, g])
        cells = np.floor(x @ rng.standard_normal((x.shape[1], lines)) / width + rng.random(lines)).astype(np.int64).astype(np.uint64)
        key = np.full(len(x), g + 1, np.uint64)
        for k in range(lines):
            key = (key ^ cells[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, g] = key.view(np.int64)
    return out


def crowded(width: float):
    """mapInArrow function: how many vectors lie in each cell of the first LINES lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in vectors_of(b.column(1)):
                cells = np.floor(projected(x) * (HALF / STEPS) / width).astype(np.int64) + np.arange(LINES) * 1_000_000
                cell, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    return run


def located(width: float, lines: int, count: int):
    """mapInArrow function: a row for each vector and group, with the vector's projections packed, eight bytes a long.

    Columns after the vector, longs without nulls, are passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                b = batch.slice(k, 2048)
                ids = b.column(0).to_numpy()
                more = {b.schema.names[j]: b.column(j).to_numpy() for j in range(2, b.num_columns)}
                for rows, x in vectors_of(b.column(1)):
                    longs = (projected(x) + 128).astype(np.uint8).view("<i8")
                    columns = [np.repeat(ids[rows], count), np.full(len(rows) * count, x.shape[1], np.int64), *[np.repeat(longs[:, j], count) for j in range(longs.shape[1])], keys(x, width, lines, count).ravel(), *[np.repeat(c[rows], count) for c in more.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "width", *PACKED, "key", *more])

    return run


PACKED = [f"p{k}" for k in range(LINES // 8)]
CELLS = "id long, width long, " + ", ".join(f"{p} long" for p in PACKED) + ", key long"


def collisions(a: str, b: str) -> Column:
    """On how many lines two vectors lie within half a window of each other.

    Four lines at a time, in lanes of 16 bits: bit 14 of x - y + 2**14 + STEPS tells x - y >= -STEPS, and no lane borrows.
    """
    lanes = lambda n: F.lit(sum(n << 16 * k for k in range(4)))
    total = F.lit(0)
    for k in range(LINES // 8):
        for odd in (0, 8):
            x, y = (F.shiftrightunsigned(F.col(f"{s}.p{k}"), odd).bitwiseAND(lanes(255)) for s in (a, b))
            both = (x + lanes((1 << 14) + STEPS) - y).bitwiseAND(y + lanes((1 << 14) + STEPS) - x)
            total = total + F.bit_count(both.bitwiseAND(lanes(1 << 14)))
    return total


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id and v, distinct and checkpointed: the ids and unit vectors of rows that can be in a pair."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    return checkpointed(v.mapInArrow(scaled, "id long, v array<double>").distinct())


def grouping(v: DataFrame, cosine: float) -> tuple[float, int, int]:
    """Width of cells, lines of a group, and groups, for the number of vectors of ``v`` and the measured crowding of cells."""
    distance = max(math.sqrt(max(2 - 2 * cosine, 0)), 1e-3)
    width = WIDTH * distance
    n = v.count()
    crowd = v.mapInArrow(crowded(width), "cell long, n long").groupBy("cell").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    return width, *groups(n, crowd / max(n, 1) ** 2 / LINES, together(distance, width))


def verified(pairs: DataFrame, v: DataFrame, cosine: float) -> DataFrame:
    """a, b and the greatest cosine of the pairs of ids a and b that have at least ``cosine``."""
    pairs = checkpointed(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    v = v.join(small(ends, ends.count()), "id", "left_semi")
    left, right = v.select(F.col("id").alias("a"), F.col("v").alias("va")), v.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = pairs.join(left, "a").join(right, "b").where(F.size("va") == F.size("vb")).select("a", "b", dot.alias("cosine"))
    return found.where(F.col("cosine") >= cosine).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def near_pairs(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_a, vec_b (vec_a < vec_b) and cosine, rounded to six digits, of pairs of vectors with at least ``cosine``.

    Every vector is a query, with a window about its place on each of 24 random lines. A pair is verified if it collides
    on as many lines as a pair just at ``cosine`` does with a chance of RECALL (17 of 24). Counting every collision of
    every line would list a quarter of all pairs a line, so the pairs to be counted are those that meet: further lines
    are sorted into wide cells, and a pair meets where it shares the cells of all lines of a group. Lines a group and
    groups follow from the number of vectors and the measured crowding of cells (groups()), by one rule at all sizes, so
    a vector meets a few unrelated ones, however many there are, and a pair just at ``cosine`` meets with a chance of
    MEET, a closer one more surely. Nothing else limits the pairs, so a class of copies gives the square of its members:
    near_classes() tells classes and numbers of links without listing them.

    Defined results: vectors that are null, empty, of zero length or hold a null, NaN or infinity are in no pair, nor are
    rows with null vec_id; vectors of different lengths form no pair. Rows that repeat a vec_id form no pair with each
    other, and a pair of ids is given once, with its greatest cosine. Equal vectors of different ids are pairs. An empty
    table gives an empty table. Other columns are ignored.
    """
    v = unit_vectors(vectors)
    q, d = (v.mapInArrow(located(*grouping(v, cosine)), CELLS).alias(side) for side in "qd")
    met = q.join(d, (F.col("q.key") == F.col("d.key")) & (F.col("q.width") == F.col("d.width")) & (F.col("q.id") < F.col("d.id")) & (collisions("q", "d") >= needed(cosine)))
    pairs = met.select(F.col("q.id").alias("a"), F.col("d.id").alias("b")).distinct()
    return verified(pairs, v, cosine).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), F.round("cosine", 6).alias("cosine"))


def counted(cosine: float):
    """applyInArrow function: for each id, how many other ids of its class have at least ``cosine`` with it.

    A table holds whole classes, or two blocks (lo, hi) of a class, of which only pairs across count; an id is whole in a block.
    """

    def blocks(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = t.sort_by([("class", "ascending"), ("block", "ascending"), ("id", "ascending")])
        cls, block, ids = (t.column(c).to_numpy() for c in ("class", "block", "id"))
        column = t.column("v").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        x = np.zeros((len(ids), sizes.max()))
        for rows, part in vectors_of(column):
            x[rows, : part.shape[1]] = part
        across = t.column("lo")[0] != t.column("hi")[0]
        ends = np.flatnonzero(np.diff(cls, append=cls[-1:] - 1)) + 1
        for start, end in zip([0, *ends[:-1]], ends):
            cut = start + int(np.searchsorted(block[start:end], block[end - 1])) if across else start
            sides = [slice(start, cut), slice(cut, end)] if across else [slice(start, end)] * 2
            firsts = [np.unique(ids[side], return_index=True) for side in sides]
            totals = [np.zeros(len(names), np.int64) for names, _ in firsts]
            (left, right), (names, first), (others, second) = sides, *firsts
            bounds = [*first, left.stop - left.start]
            for k in range(0, len(names), 256):
                at = slice(left.start + bounds[k], left.start + bounds[min(k + 256, len(names))])
                hit = (x[at] @ x[right].T >= cosine) & (sizes[at, None] == sizes[None, right])
                if len(others) < hit.shape[1]:
                    hit = np.logical_or.reduceat(hit, second, axis=1)
                if len(names[k : k + 256]) < len(hit):
                    hit = np.logical_or.reduceat(hit, first[k : k + 256] - bounds[k], axis=0)
                if across:
                    totals[1] += hit.sum(0)
                else:
                    hit[np.arange(len(hit)), k + np.arange(len(hit))] = False
                totals[0][k : k + 256] = hit.sum(1)
            yield names, totals[0]
            if across:
                yield others, totals[1]

    def run(t: pa.Table) -> pa.Table:
        names, totals = zip(*blocks(t))
        return pa.table({"id": np.concatenate(names), "links": np.concatenate(totals)})

    return run


def links_within(v: DataFrame, label: DataFrame, cosine: float) -> DataFrame:
    """id and links: for each node of ``label`` the number of other nodes of its component whose vectors have at least ``cosine``.

    Exact: each class is compared with itself, block by block, as products of matrices; what leaves a block is a number an
    id. Classes of less than a block share one.
    """
    m = v.join(small(label.select(F.col("node").alias("id"), F.col("component").alias("class")), label.count()), "id")
    sized = m.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("long"))
    sized = sized.select("class", (F.col("n") * F.col("long")).alias("numbers"))
    shared = max(1, math.ceil((sized.where(F.col("numbers") <= BLOCK).agg(F.sum("numbers")).first()[0] or 0) / BLOCK))
    m = m.join(sized, "class").withColumn("blocks", F.ceil(F.col("numbers") / BLOCK))
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = F.col("blocks") > 1
    m = m.select("id", "v", "class", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), alone.alias("alone"), F.when(alone, F.col("class")).otherwise(F.pmod(F.xxhash64("class"), F.lit(shared))).alias("part"))
    return m.groupBy("alone", "part", "lo", "hi").applyInArrow(counted(cosine), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row for each vec_id: class_id, the least vec_id of its class, and links, how many other vec_ids have at least ``cosine`` with it.

    A class is a connected component of the links. Pairs meet and are verified as in near_pairs(), with the same recall for
    a link between two classes; but a class of many copies isn't listed pair by pair:

    1. In each cell of each group the members are held against one of them, drawn by hash. Verified links make first classes.
    2. All pairs that meet are held against each other, save those within one first class of over WHOLE members: these are
       in one class already. Of such a class only what meets rows outside it is compared.
    3. Links are counted in each class by comparing all its members (links_within()): no link of a class is missed, however
       many members it has. Two rows with a link are of one class, so there are no others to count.

    What is listed is thus in proportion to the vectors times the groups; only multiplications grow with the square of a class.

    Defined results: every vec_id that isn't null has one row. Vectors that are null, empty, of zero length or hold a null,
    NaN or infinity have no link; vectors of different lengths neither. A repeated vec_id has the links of all its
    vectors, each other vec_id counted once and itself never. Equal vectors of different ids are linked. An empty table
    gives an empty table. Other columns are ignored.
    """
    v = unit_vectors(vectors)
    place, least = located(*grouping(v, cosine)), needed(cosine)
    edge = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    lead = F.min(F.struct(F.xxhash64("id", "key").alias("draw"), "id", *PACKED)).over(Window.partitionBy("key", "width"))
    led = v.mapInArrow(place, CELLS).withColumn("lead", lead).alias("q").where((F.col("q.id") != F.col("lead.id")) & (collisions("q", "lead") >= least))
    first = checkpointed(verified(led.select(*edge("q.id", "lead.id")).distinct(), v, cosine).select("a", "b"))
    label = checkpointed(components(first))
    whole = label.join(label.groupBy("component").count().where(F.col("count") > WHOLE), "component").select(F.col("node").alias("id"), F.col("component").alias("whole"))
    whole = small(whole, whole.count())

    outside = v.join(whole, "id", "left_anti").mapInArrow(place, CELLS)
    inside = v.join(whole, "id").select("id", "v", "whole").mapInArrow(place, CELLS + ", whole long")
    every = outside.withColumn("whole", F.lit(None).cast("long")).unionByName(inside)
    same = (F.col("q.key") == F.col("d.key")) & (F.col("q.width") == F.col("d.width"))
    near = collisions("q", "d") >= least
    met = outside.alias("q").join(every.alias("d"), same & (F.col("d.whole").isNotNull() | (F.col("q.id") < F.col("d.id"))) & near)
    present = inside.select("key", "width", "whole").distinct()
    cross = present.alias("x").join(present.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.width") == F.col("y.width")) & (F.col("x.whole") < F.col("y.whole")))
    cross = cross.select("x.key", "x.width", "x.whole", F.col("y.whole").alias("with"))
    crossed = inside.join(cross, ["key", "width", "whole"]).alias("q").join(inside.alias("d"), same & near & (F.col("q.with") == F.col("d.whole")))
    ends = met.select(*edge("q.id", "d.id")).unionByName(crossed.select(*edge("q.id", "d.id"))).where("a <> b").distinct()

    label = checkpointed(components(first.unionByName(verified(ends, v, cosine).select("a", "b"))))
    links = links_within(v, label, cosine)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    found = rows.join(label.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    return found.select(F.col("id").alias("vec_id"), F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE link AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {COSINE}
), reached(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN link l ON r.other = l.a
)
SELECT r.vec_id, min(r.other) AS class_id, CAST(coalesce(any_value(n.links), 0) AS BIGINT) AS links
FROM reached r LEFT JOIN (SELECT a, count(DISTINCT b) AS links FROM link GROUP BY a) n ON n.a = r.vec_id
GROUP BY r.vec_id
"""
