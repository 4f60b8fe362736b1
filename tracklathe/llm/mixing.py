"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.llm._shared import checkpointed, hex_uniform, small, table

#: Production parameters: source weights (others count OTHER), characters asked for as a share of the input's, seed.
WEIGHTS = {"src0": 4.0}
OTHER = 1.0
RATIO = 1.0
SEED = 17
#: Bins of the histogram that locates each source's last chosen rank.
BINS = 1 << 16


def pareto_copies(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, ratio: float = RATIO, seed: int = SEED, name: str = "copies") -> DataFrame:
    """``docs`` with one more column, ``name`` (long, 0 or more): how often each row enters the mixture.

    The characters asked for (``ratio`` times all) are divided over the sources present by their weights. A source's
    share becomes a fixed number of copies, N, spread over its rows in proportion to x = floor(sqrt(length)) + 1: row i
    expects N*x/X copies. The whole part is allotted for certain; the fractions are inclusion odds of a Pareto sample:
    rows are ranked by u/(1-u) divided by p/(1-p), u a hash of seed and doc_id, and the first N - sum(whole) are taken.
    So each source gets exactly N copies, wherever its rows lie.

    No source is sorted: a histogram of the ranks by source finds the bin of the last chosen row, only that bin is
    ordered, and the choice is then a comparison with one row a source, joined without shuffling the documents.

    Defined results: null text counts as empty (length 0, x = 1); null source is the source ""; null doc_id hashes as
    "". A source whose rows are all empty gets 0 copies. Rows equal in doc_id and text are ranked together, and if the
    last rank falls among them, any of them are taken, as many as are needed. An empty table gives an empty table.
    Other columns pass through, whatever their names; a column called ``name`` in the input is replaced.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    base = docs.select(F.struct(*keep).alias("row"))
    w = F.lit(float(other))
    for source, value in sorted(weights.items()):
        w = F.when(F.col("s") == source, F.lit(float(value))).otherwise(w)
    length = F.coalesce(F.length("row.text"), F.lit(0)).cast("long")
    u = hex_uniform(F.lit(str(seed)), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    ranked = base.select(
        "row",
        F.coalesce(F.col("row.source"), F.lit("")).alias("s"),
        length.alias("len"),
        (F.floor(F.sqrt(length.cast("double"))) + 1).cast("long").alias("x"),
        (u / (1 - u)).alias("odds"),
        F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("id"),
        F.xxhash64("row.text").alias("h"),
    )
    narrow = checkpointed(ranked.drop("row"))
    stats = narrow.groupBy("s").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("len")).alias("sxl"), F.sum("len").alias("sl"))
    stats = stats.withColumn("w", w)
    total = stats.agg(F.sum("w").alias("tw"), F.sum("sl").alias("tl"))
    want = F.lit(float(ratio)) * F.col("tl") * F.col("w") / F.col("tw") * F.col("sx") / F.col("sxl")
    quota = checkpointed(stats.crossJoin(F.broadcast(total)).select("s", "sx", F.when(F.col("sxl") > 0, F.floor(want + 0.5)).otherwise(0).cast("long").alias("n")))
    sources = quota.count()
    quota = small(quota, sources)

    def spread(df: DataFrame) -> DataFrame:
        share = F.col("n") * F.col("x")
        rest = share % F.col("sx")
        rank = F.when(rest > 0, F.col("odds") * ((F.col("sx") - rest) / rest))
        return df.join(quota, "s").withColumn("whole", F.expr("(n * x) div sx")).withColumn("q", rank)

    spreaded = spread(narrow)
    cells = spreaded.withColumn("bin", F.floor(F.col("q") / (F.col("q") + 1) * BINS)).groupBy("s", "bin").agg(F.count("*").alias("c"), F.sum("whole").alias("certain"), F.first("n").alias("n"))
    by_bin = Window.partitionBy("s").orderBy(F.col("bin").asc_nulls_last())
    cells = cells.withColumn("m", F.col("n") - F.sum("certain").over(Window.partitionBy("s"))).withColumn("upto", F.sum("c").over(by_bin))
    last = checkpointed(cells.where("bin IS NOT NULL AND m > 0 AND upto >= m AND upto - c < m").select("s", F.col("bin").alias("last_bin"), (F.col("m") - F.col("upto") + F.col("c")).alias("need")))
    last = small(last, sources)
    inside = spreaded.withColumn("bin", F.floor(F.col("q") / (F.col("q") + 1) * BINS)).join(last, (F.col("bin") == F.col("last_bin")) & (spreaded["s"] == last["s"])).select(spreaded["s"], "q", "id", "h", "need")
    order = Window.partitionBy("s").orderBy("q", "id", "h")
    ties = inside.withColumn("r", F.row_number().over(order)).withColumn("key", F.struct("q", "id", "h"))
    cut = ties.groupBy("s", "key").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.first("need").alias("need")).where("lo <= need AND need <= hi")
    cut = checkpointed(cut.select("s", F.col("key").alias("cut"), (F.col("need") - F.col("lo") + 1).alias("of_ties"), (F.col("hi") - F.col("need")).alias("over")))
    parts = spread(ranked).join(small(cut, sources), "s", "left").withColumn("key", F.struct("q", "id", "h"))
    chosen = F.col("q").isNotNull() & F.col("cut").isNotNull()
    split = cut.where("over > 0").limit(1).count() > 0  # copies of one row lie across the cut
    taken = F.when(chosen & ((F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("over") == 0))), 1).otherwise(0)
    if not split:
        return parts.select("row.*", (F.col("whole") + taken).cast("long").alias(name))
    at_cut = F.coalesce(chosen & (F.col("key") == F.col("cut")) & (F.col("over") > 0), F.lit(False))
    rest = parts.where(~at_cut).select("row", (F.col("whole") + taken).alias("copies"))
    numbered = parts.where(at_cut).withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("id")))
    tied = numbered.select("row", (F.col("whole") + F.when(F.col("r") <= F.col("of_ties"), 1).otherwise(0)).alias("copies"))
    return rest.unionByName(tied).select("row.*", F.col("copies").cast("long").alias(name))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as pareto_copies() says, with the columns of ``docs`` untouched.

    Defined results: as for pareto_copies(); a column ``copies`` of the input keeps its values, since the count goes under
    a name that the input doesn't have.
    """
    columns = docs.columns
    have = {c.lower() for c in columns}
    name = next(n for k in range(len(have) + 1) if (n := f"copies_{k}") not in have)
    counted = pareto_copies(docs, **params, name=name).where(F.col(name) > 0)
    copies = counted.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.explode(F.sequence(F.lit(1), F.col(name).cast("int"))).alias("copy"))
    return copies.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_copies(table(spark, sf_dir, "documents")).where("copies > 0").select("doc_id", "source", "copies")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, coalesce(length(text), 0) AS len,
    CAST(floor(sqrt(CAST(coalesce(length(text), 0) AS DOUBLE))) + 1 AS BIGINT) AS x,
    (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / {float(2**48)}::DOUBLE AS u
  FROM documents),
st AS (
  SELECT s, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(x * len) AS DOUBLE) AS sxl, CAST(sum(len) AS DOUBLE) AS sl,
    CASE {' '.join(f"WHEN s = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())} ELSE {OTHER}::DOUBLE END AS w
  FROM d GROUP BY s),
q AS (
  SELECT s, sx, CAST(CASE WHEN sxl > 0 THEN floor({RATIO}::DOUBLE * (SELECT sum(sl) FROM st) * w / (SELECT sum(w) FROM st) * sx / sxl + 0.5) ELSE 0 END AS BIGINT) AS n
  FROM st),
e AS (
  SELECT d.*, n, n * x // sx AS whole, CASE WHEN n * x % sx > 0 THEN u / (1 - u) * (CAST(sx - n * x % sx AS DOUBLE) / CAST(n * x % sx AS DOUBLE)) END AS rank
  FROM d JOIN q USING (s)),
r AS (
  SELECT *, n - sum(whole) OVER (PARTITION BY s) AS m,
    row_number() OVER (PARTITION BY s ORDER BY rank NULLS LAST, CAST(doc_id AS VARCHAR)) AS pos
  FROM e)
SELECT doc_id, source, CAST(whole + CASE WHEN rank IS NOT NULL AND pos <= m THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r WHERE whole + CASE WHEN rank IS NOT NULL AND pos <= m THEN 1 ELSE 0 END > 0
"""
