"""Joins by distance in scaled latitude, longitude and time: all within a radius, and the k nearest."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklathe.functions.scalars import micros
from tracklathe.plans.lineage import checkpointed

#: Sites of a block of space, about, and rows that meet one at once: what a task holds.
BLOCK, ROWS = 16_384, 32_768
#: Sites of a leaf, within a block; each is compared with every row that reaches the leaf.
LEAF = 32
#: Sites that are drawn to cut space into blocks alike in size: so many, or so many a block if that is more.
DRAWN, EACH = 200_000, 64
#: Rows that are copied at once.
CHUNK = 65_536


def scaled(lat: Column, lon: Column, time: Column, geo_scale: float, hour_scale: float) -> list[Column]:
    """Coordinates whose Euclidean distance mixes degrees and hours. Hours count from the epoch."""
    return [lat / geo_scale, lon / geo_scale, micros(time) / 3.6e9 / hour_scale]


def positioned(df: DataFrame, coordinates: Sequence[Column], tag: str) -> DataFrame:
    """One struct of the row, and its coordinates tag0, tag1, ..; rows with an unknown coordinate go."""
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(tag), *[c.cast("double").alias(f"{tag}{k}") for k, c in enumerate(coordinates)])
    return out.dropna(subset=[f"{tag}{k}" for k in range(len(coordinates))])


def finite(df: DataFrame, tag: str, n: int) -> DataFrame:
    for k in range(n):
        df = df.where(F.abs(F.col(f"{tag}{k}")) < math.inf)
    return df


def cells(df: DataFrame, tag: str, width: float, n: int) -> DataFrame:
    return df.withColumns({f"{tag}c{k}": F.floor(F.col(f"{tag}{k}") / width) for k in range(n)})


def met(left: DataFrame, right: DataFrame, width: float, n: int) -> DataFrame:
    """Pairs no further apart than ``width`` (and others), by cells: each left row visits its own and the next cells."""
    around = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(step)]) for step in itertools.product((-1, 0, 1), repeat=n)])
    a = cells(left, "l", width, n).withColumn("step", F.explode(around))
    a = a.withColumns({f"lc{k}": F.col(f"lc{k}") + F.col(f"step.d{k}") for k in range(n)}).drop("step")
    b = cells(right, "r", width, n)
    on = [F.col(f"lc{k}") == F.col(f"rc{k}") for k in range(n)]
    distance = F.sqrt(sum((F.pow(F.col(f"l{k}") - F.col(f"r{k}"), 2) for k in range(n)), F.lit(0.0)))
    return a.join(b, on).withColumn("distance", distance).drop(*[f"{s}c{k}" for s in "lr" for k in range(n)])


def within_radius(left: DataFrame, right: DataFrame, left_at: Sequence[Column], right_at: Sequence[Column], radius: float) -> DataFrame:
    """Columns l and r (structs of the rows) and distance, for all pairs at most ``radius`` apart.

    An equi-join on cells, so its cost follows the number of pairs, which grows with the square of the density of
    points; where only the least distance counts, nearest() with a radius does without them.
    """
    n = len(left_at)
    pairs = met(positioned(left, left_at, "l"), positioned(right, right_at, "r"), radius, n)
    return pairs.where(F.col("distance") <= radius).select("l", "r", "distance")


class Tree:
    """Space cut in two at the median of the widest coordinate, again and again, until a part has ``size`` points or one position."""

    def __init__(self, points: np.ndarray, size: int):
        dim, cut, down, self.leaves = [-1], [0.0], [0], 0
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            wide = np.ptp(own, 0) if len(own) > size else np.zeros(1)
            if not wide.max() > 0:
                down[node] = self.leaves
                self.leaves += 1
                continue
            d = int(np.argmax(wide))
            line = np.sort(own[:, d])
            at = line[len(line) // 2]
            at = at if at > line[0] else line[np.searchsorted(line, at, "right")]
            above = own[:, d] >= at
            dim[node], cut[node], down[node] = d, at, len(dim)
            todo += [(len(dim), own[~above]), (len(dim) + 1, own[above])]
            dim, cut, down = dim + [-1, -1], cut + [0.0, 0.0], down + [0, 0]
        self.dim, self.cut, self.down = np.array(dim), np.array(cut), np.array(down)  # down: the first of two children, or a leaf's number

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each position."""
        node = np.zeros(len(x), np.int64)
        on = np.arange(len(x))
        while len(on := on[self.dim[node[on]] >= 0]):
            here = node[on]
            node[on] = self.down[here] + (x[on, self.dim[here]] >= self.cut[here])
        return self.down[node]

    def bound(self, low: np.ndarray, high: np.ndarray) -> "Tree":
        """Itself, with the bounds of what lies in each leaf; infinity and minus infinity in an empty one."""
        self.low, self.high = np.empty((2, len(self.dim), low.shape[1]))
        for node in range(len(self.dim) - 1, -1, -1):
            at = self.down[node]
            if self.dim[node] < 0:
                self.low[node], self.high[node] = low[at], high[at]
            else:
                self.low[node], self.high[node] = self.low[at : at + 2].min(0), self.high[at : at + 2].max(0)
        return self

    def reached(self, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, each with the positions no further than ``reach`` from its bounds; the caller may lower ``reach`` on the way."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, on = todo.pop()
            gap = np.maximum(np.maximum(self.low[node] - x[on], x[on] - self.high[node]), 0)
            on = on[np.sqrt((gap * gap).sum(1)) <= reach[on] * (1 + 1e-9)]
            if not len(on):
                continue
            at = int(self.down[node])
            if self.dim[node] < 0:
                yield at, on
            else:
                todo += [(at, on), (at + 1, on)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        step = x[:, k, None] - y[None, :, k]
        total += step * step
    return np.sqrt(total)


def closest(x: np.ndarray, sites: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, site and distance of the ``k`` nearest sites of each x within ``reach``, with all that tie with the last; and its distance, or ``reach``."""
    reach = reach.copy()
    none = np.zeros(0, np.int64)
    if not len(x) or not len(sites):
        return none, none, np.zeros(0), reach
    tree = Tree(sites, LEAF)
    leaf = tree.home(sites)
    order = np.argsort(leaf, kind="stable")
    ends = np.cumsum(np.bincount(leaf, minlength=tree.leaves))
    parts = [order[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    tree.bound(np.array([sites[p].min(0) for p in parts]), np.array([sites[p].max(0) for p in parts]))
    home = tree.home(x)
    line = np.argsort(home, kind="stable")
    stops = np.cumsum(np.bincount(home, minlength=tree.leaves))
    for p, a, b in zip(parts, [0, *stops[:-1]], stops):
        if b > a and len(p) >= k:
            reach[line[a:b]] = np.minimum(reach[line[a:b]], np.partition(distances(x[line[a:b]], sites[p]), k - 1, axis=1)[:, k - 1])
    found: list[tuple] = []
    held, most = 0, 64 * ROWS

    def least() -> tuple:
        row, site, d = (np.concatenate(c) for c in zip((none, none, np.zeros(0)), *found))
        turn = np.lexsort((d, row))
        row, site, d = row[turn], site[turn], d[turn]
        first = np.searchsorted(row, np.arange(len(x)))
        full = np.searchsorted(row, np.arange(len(x)), "right") - first >= k
        reach[full] = np.minimum(reach[full], d[first[full] + k - 1])
        keep = d <= reach[row]
        return row[keep], site[keep], d[keep]

    for at, on in tree.reached(x, reach):
        d = distances(x[on], sites[parts[at]])
        if d.shape[1] >= k:
            reach[on] = np.minimum(reach[on], np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d <= reach[on, None])
        found.append((on[i], parts[at][j], d[i, j]))
        held += len(i)
        if held > most:
            found = [least()]
            held = len(found[0][0])
            most = max(most, 2 * held)
    return *least(), reach


def coordinates(rows: pa.RecordBatch | pa.Table, tag: str, n: int) -> np.ndarray:
    return np.stack([np.asarray(rows.column(f"{tag}{k}"), np.float64) for k in range(n)], 1)


def taken(rows: pa.RecordBatch, places: np.ndarray, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by place, repeated as often as a place is, with further columns, some at once."""
    for a in range(0, len(places), CHUNK):
        part = rows.take(pa.array(places[a : a + CHUNK]))
        yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c[a : a + CHUNK]) for c in more.values()]], names=[*part.schema.names, *more])


def in_leaf(tree: Tree, tag: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows with their leaf."""

    def run(batches):
        for b in batches:
            yield from taken(b, np.arange(b.num_rows), leaf=tree.home(coordinates(b, tag, n)))

    return run


def in_reach(tree: Tree, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows for each leaf but their own that they reach."""

    def run(batches):
        for b in batches:
            x = coordinates(b, "l", n)
            home = tree.home(x)
            for leaf, on in tree.reached(x, np.asarray(b.column("reach"), np.float64)):
                on = on[home[on] != leaf]
                yield from taken(b, on, leaf=np.full(len(on), leaf, np.int64))

    return run


def in_groups(shares: np.ndarray, copied: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows with one of the groups of their leaf, in turn, or copied to all of them."""
    first = np.cumsum(shares) - shares

    def run(batches):
        turn = 0
        for b in batches:
            leaf = np.asarray(b.column("leaf"), np.int64)
            places, number = np.arange(b.num_rows), (turn + np.arange(b.num_rows)) % np.maximum(shares[leaf], 1)
            turn += b.num_rows
            if copied:
                places = np.repeat(places, shares[leaf])
                number = np.arange(len(places)) - np.repeat(np.cumsum(shares[leaf]) - shares[leaf], shares[leaf])
            yield from taken(b, places, group=first[leaf[places]] + number)

    return run


def with_columns(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, kind) for c, kind in kinds.items()]])


def counted(df: DataFrame, leaves: int) -> np.ndarray:
    """Rows by leaf; a row comes to the driver for each leaf."""
    out = np.zeros(leaves, np.int64)
    for leaf, count in df.groupBy("leaf").count().collect():
        out[leaf] = count
    return out


def nearest(left: DataFrame, right: DataFrame, left_at: Sequence[Column], right_at: Sequence[Column], key: str, ties: Sequence[str], k: int = 1, radius: float = math.inf) -> DataFrame:
    """Columns l, r, distance and rank of the ``k`` nearest right rows within ``radius`` of each left row, ties by the columns ``ties``.

    ``key`` tells left rows apart. Space is cut into blocks of about BLOCK sites, drawn by some of them; each site is in
    one block. A left row is first held against its own block; the distance found there says which others can have
    nearer sites, by the bounds of their sites, and it is held against these. Of sites at one position only the first
    ``k`` by ``ties`` can count. A block is copied for every ROWS rows that ask it, so all that is moved grows with the
    tables, however dense or uneven they are, and no pair is listed but the nearest of a block. Only keys and positions
    of the left rows are moved; the rows are joined at the end. Left rows with an unknown coordinate, or without a site
    in reach, are left out.
    """
    n = len(left_at)
    rows = finite(positioned(left, left_at, "l"), "l", n)
    asked = rows.withColumn("l", F.struct(F.col(f"l.{key}").alias(key)))
    sites = finite(positioned(right, right_at, "r"), "r", n)
    spot = Window.partitionBy(*[f"r{i}" for i in range(n)]).orderBy(*([F.col(f"r.{t}") for t in ties] or ["r0"]))
    sites = checkpointed(sites.withColumn("_rank", F.row_number().over(spot)).where(F.col("_rank") <= k).drop("_rank"))
    count = sites.count()
    drawn = min(1.0, max(DRAWN / max(count, 1), EACH / BLOCK))
    points = sites.select(*[f"r{i}" for i in range(n)])
    points = coordinates((points.sample(drawn, 0) if drawn < 1 else points).toArrow(), "r", n)
    tree = Tree(points, max(1, int(BLOCK * drawn)))
    leaf = T.LongType()

    placed = sites.mapInArrow(in_leaf(tree, "r", n), with_columns(sites, leaf=leaf))
    low, high = np.full((tree.leaves, n), math.inf), np.full((tree.leaves, n), -math.inf)
    for r in placed.groupBy("leaf").agg(*[f(f"r{i}") for f in (F.min, F.max) for i in range(n)]).collect():  # a row for each leaf
        low[r[0]], high[r[0]] = r[1 : n + 1], r[n + 1 :]
    tree.bound(low, high)

    def compared(rows: DataFrame, schema: T.StructType, run) -> DataFrame:
        shares = -(-counted(rows, tree.leaves) // ROWS)
        group = T.LongType()
        a = rows.mapInArrow(in_groups(shares, False), with_columns(rows, group=group))
        b = placed.mapInArrow(in_groups(shares, True), with_columns(placed, group=group))
        return a.groupBy("group").cogroup(b.groupBy("group")).applyInArrow(run, schema)

    found = T.StructType([*asked.schema.fields, T.StructField("r", sites.schema["r"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("reach", T.DoubleType())])

    def at_home(a: pa.Table, b: pa.Table) -> pa.Table:
        """Nearest sites of the own block; the first of a row, or a row without one, tells its reach."""
        x = coordinates(a, "l", n)
        row, site, distance, reach = closest(x, coordinates(b, "r", n), k, np.full(len(x), float(radius)))
        lone = np.setdiff1d(np.arange(len(x)), row)
        first = np.append(np.diff(row, prepend=-1) > 0, np.ones(len(lone), bool))
        row, blank = np.append(row, lone), np.append(np.zeros(len(row), bool), np.ones(len(lone), bool))
        site, distance = (np.append(c, np.zeros(len(lone), c.dtype)) for c in (site, distance))
        told = [pa.array(distance, mask=blank), pa.array(reach[row], mask=~first)]
        return pa.Table.from_arrays([*a.select(asked_columns).take(pa.array(row)).columns, b["r"].take(pa.array(site, mask=blank)), *told], names=found_columns)

    def abroad(a: pa.Table, b: pa.Table) -> pa.Table:
        row, site, distance, _ = closest(coordinates(a, "l", n), coordinates(b, "r", n), k, np.asarray(a["reach"], np.float64))
        return pa.Table.from_arrays([a["l"].take(pa.array(row)), b["r"].take(pa.array(site)), pa.array(distance)], names=["l", "r", "distance"])

    asked_columns, found_columns = asked.columns, found.names
    own = checkpointed(compared(asked.mapInArrow(in_leaf(tree, "l", n), with_columns(asked, leaf=leaf)), found, at_home))
    onward = own.where("reach IS NOT NULL").drop("r", "distance")
    onward = checkpointed(onward.mapInArrow(in_reach(tree, n), with_columns(onward, leaf=leaf)))
    pair = T.StructType([found["l"], found["r"], found["distance"]])
    every = own.where("distance IS NOT NULL").select(*pair.names).unionByName(compared(onward, pair, abroad))
    best = Window.partitionBy(F.col(f"l.{key}")).orderBy("distance", *[F.col(f"r.{t}") for t in ties])
    done = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumnRenamed("l", "_l")
    return done.join(rows.select("l"), F.col(f"_l.{key}").eqNullSafe(F.col(f"l.{key}"))).select("l", "r", "distance", "rank")
