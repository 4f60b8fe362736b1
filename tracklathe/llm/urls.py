"""URL filter: gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.llm._shared import checkpointed, small, table

#: Production parameters: host words of a block list, from which the labelled URLs come; bound of the labelled rows of
#: each class used for the fit; trees.
BLOCKED = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
PER_CLASS = 5000
TREES = 12
DEPTH = 3
THRESHOLD = 0.5
SEED = 7
SUFFIXES = (1, 2, 3)
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "host_hyphens", "parameters", "query_length", "fragment", "entropy", "host_entropy", "vowels", "longest_label")


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    size = F.length(text)
    bits = F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda s, c: s + F.when(F.length(c) == 0, 0.0).otherwise((p := (size - F.length(F.replace(text, c, F.lit("")))) / size) * -F.log2(p)),
    )
    return F.when(size > 0, bits).otherwise(0.0)


def share(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.length(text)).otherwise(0.0)


def lexical(url: Column) -> dict[str, Column]:
    """Features of the characters of one URL, and ``host``. Nothing is fetched or parsed strictly; any text has features."""
    url = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d*$", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    size = lambda c: F.length(c).cast("double")
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")
    return {
        "host": host,
        "length": size(url),
        "host_length": size(host),
        "path_length": size(path),
        "depth": count(path, "/"),
        "labels": count(host, ".") + 1,
        "digits": share(url, "0-9"),
        "host_digits": share(host, "0-9"),
        "hyphens": count(url, "-"),
        "host_hyphens": count(host, "-"),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0),
        "query_length": size(query),
        "fragment": F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "vowels": share(host, "aeiou"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
    }


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def suffixes(pages: DataFrame) -> DataFrame:
    """host, and for its last one, two and three labels log(1 + URLs) and log(1 + hosts) with them, counted over all rows.

    URLs are counted by host first, then by suffix, so a frequent suffix costs no more to join than it has hosts. The
    result has a row for each host and is broadcast only if its measured size allows; else adaptive execution splits
    the rows of a frequent host.
    """
    hosts = checkpointed(pages.select(lexical(F.col("url").cast("string"))["host"].alias("host")).groupBy("host").agg(F.count("*").alias("urls")))
    stats = hosts
    for k in SUFFIXES:
        of = hosts.groupBy(suffix(F.col("host"), k).alias(f"s{k}")).agg(F.log1p(F.sum("urls")).alias(f"urls_{k}"), F.log1p(F.count("*")).alias(f"hosts_{k}"))
        stats = stats.withColumn(f"s{k}", suffix(F.col("host"), k)).join(of, f"s{k}")
    stats = checkpointed(stats.drop("urls", *[f"s{k}" for k in SUFFIXES]))
    return small(stats, stats.count(), 150)


def featured(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """id, url, host, the lexical features, and the statistics of suffixes; 0 for a host that has none."""
    base = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"))
    rows = base.select("id", "url", *[c.alias(k) for k, c in lexical(F.col("url")).items()])
    return rows.join(stats, "host", "left").fillna(0.0, NAMES[len(LEXICAL) :])


NAMES = [*LEXICAL, *(f"{what}_{k}" for k in SUFFIXES for what in ("urls", "hosts"))]


def listed(host: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """1.0 if a label of the host is on the block list, else 0.0."""
    return F.when(F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(b) for b in blocked])), 1.0).otherwise(0.0)


def by_list(pages: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """A labelled table, url and label, of the URLs of ``pages`` by a block list of host words."""
    url = F.col("url").cast("string")
    return pages.select(url.alias("url"), listed(lexical(url)["host"], blocked).alias("label"))


def chosen(labelled: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> DataFrame:
    """page_id (0), url and label of at most ``per_class`` labelled URLs of each class, first by hash."""
    given = labelled.select(F.lit(0).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")).where("url IS NOT NULL AND label IN (0, 1)")
    place = F.xxhash64("url", F.lit(seed))
    return given.where("label = 0").orderBy(place, "url").limit(per_class).unionByName(given.where("label = 1").orderBy(place, "url").limit(per_class))


def fit(labelled: DataFrame, stats: DataFrame, per_class: int = PER_CLASS, seed: int = SEED):
    """Trees for labelled URLs; None without both classes. Features are made of the chosen rows alone."""
    rows = chosen(labelled, per_class, seed).toPandas()
    sizes = rows["label"].value_counts()
    if len(sizes) < 2:
        return None
    rows["page_id"] = range(len(rows))
    rows["weight"] = rows["label"].map(len(rows) / (2 * sizes))
    given = labelled.sparkSession.createDataFrame(rows).coalesce(2)
    train = featured(given, stats).join(given.select(F.col("page_id").alias("id"), "label", "weight"), "id").sort("id").coalesce(2)
    train = VectorAssembler(inputCols=NAMES, outputCol="features").transform(train)
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=seed, weightCol="weight", cacheNodeIds=False).fit(train)


def filter_urls(pages: DataFrame, labelled: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, score (probability of a bad URL) and bad for every row of ``pages``.

    ``labelled`` has url and label (0 or 1). The trees see only length, depth, ratios, entropies, counts of parameters
    and statistics of host suffixes, so they carry over to hosts without labels. The fit is on at most ``per_class``
    labelled URLs of each class, a documented bound; features and scores are column expressions, made once for each
    row, and statistics count every row.

    Defined results: a null URL has the features of an empty one, scores NULL and isn't bad; null page_id is kept; repeated
    rows are counted and scored as often as they occur. If one class has no labels, every score is NULL and no URL is
    bad. Labels other than 0 and 1 and labelled URLs that are null are ignored. An empty table gives an empty table.
    Other columns are ignored.
    """
    stats = suffixes(pages)
    model = fit(labelled, stats, per_class)
    if model is None:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("bad"))
    scored = model.transform(VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(featured(pages, stats)))
    score = F.when(F.col("url").isNotNull(), vector_to_array("probability")[1])
    return scored.select(F.col("id").alias("page_id"), "url", score.alias("score")).withColumn("bad", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no labelled URLs, so a block list labels those of pages."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, by_list(pages))
