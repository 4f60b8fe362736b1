import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracklathe.llm import urls


def test_features(spark):
    url = "http://user@www.Spam-Farm.example.org:80/a/b2.html?x=1&y=2#top"
    df = spark.createDataFrame([(url,), (None,), ("",)], "url string")
    rows = df.select(*[c.alias(k) for k, c in urls.lexical(F.col("url")).items()]).collect()
    row = rows[0]
    host = "www.spam-farm.example.org"
    assert row["host"] == host and row["depth"] == 2 and row["parameters"] == 2 and row["fragment"] == 1 and row["host_hyphens"] == 1 and row["labels"] == 4 and row["longest_label"] == 9
    assert row["digits"] == pytest.approx(5 / len(url))
    counts = Counter(host)
    assert row["host_entropy"] == pytest.approx(-sum(n / len(host) * math.log2(n / len(host)) for n in counts.values()))
    assert rows[1] == rows[2] and rows[1]["length"] == 0 and rows[1]["entropy"] == 0


def test_suffix_statistics(spark):
    df = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["a.x.org", "a.x.org", "b.x.org", "c.org"])], "page_id long, url string")
    row = urls.featured(df, urls.suffixes(df)).where("host = 'b.x.org'").first()
    assert [row[f"urls_{k}"] for k in (1, 2, 3)] == pytest.approx([math.log(5), math.log(4), math.log(2)])
    assert [row[f"hosts_{k}"] for k in (1, 2, 3)] == pytest.approx([math.log(4), math.log(3), math.log(2)])


def plain(url):
    """The lexical features in plain Python."""
    url = (url or "").lower()
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url)
    host = re.sub(r"^[^@]*@|:\d*$", "", re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    query = (re.match(r"[^?#]*\?([^#]*)", rest) or ["", ""])[1]
    bits = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    part = lambda t, chars: sum(c in chars for c in t) / len(t) if t else 0.0
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, part(url, "0123456789"), part(host, "0123456789"), url.count("-"), host.count("-"), query.count("&") + 1 if query else 0, len(query), float("#" in url), bits(url), bits(host), part(host, "aeiou"), max(map(len, host.split(".")))]


def test_features_and_scores_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(150)
    rows = [(i, r["url"]) for i, r in enumerate(pages.collect())] + [(900, None), (901, ""), (902, "A?b#c"), (903, "ftp://u:p@h.x:21?q=1&r#s-t")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    stats = urls.suffixes(df)
    found = urls.featured(df, stats).collect()
    hosts = Counter(r["host"] for r in found)
    last = lambda host, k: ".".join(host.split(".")[-k:])
    for r in found:
        wanted = plain(r["url"])
        for k in urls.SUFFIXES:
            alike = [h for h in hosts if last(h, k) == last(r["host"], k)]
            wanted += [math.log1p(sum(hosts[h] for h in alike)), math.log1p(len(alike))]
        assert [r[n] for n in urls.NAMES] == pytest.approx(wanted), r["url"]
    labelled = urls.by_list(df)
    model = urls.fit(labelled, stats)

    def walk(node, x):
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    by_id = {r["id"]: [r[n] for n in urls.NAMES] for r in found}
    trees = [(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights)]
    for r in urls.filter_urls(df, labelled).collect():
        if r["url"] is None:
            assert r["score"] is None
        else:
            margin = sum(w * walk(root, by_id[r["page_id"]]) for root, w in trees)
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)


def test_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    seen = urls.BLOCKED[:4]
    truth = urls.listed(F.lower(F.regexp_extract("url", "//([^/]+)", 1)))
    known = pages.where(~F.col("url").rlike("|".join(urls.BLOCKED[4:]))).select("url", urls.listed(F.regexp_extract("url", "//([^/]+)", 1), seen).alias("label"))
    out = urls.filter_urls(pages, known).withColumn("truth", truth)
    rows = {(r["truth"], r["bad"]): r["count"] for r in out.groupBy("truth", "bad").count().collect()}
    right = rows.get((1.0, True), 0) + rows.get((0.0, False), 0)
    assert right / pages.count() >= 0.97


def test_odd_rows(spark):
    rows = [(1, "http://spam-farm.example.com/x"), (2, "http://good.example.com/"), (2, "http://good.example.com/"), (None, "http://fine.example.com/"), (3, None), (4, ""), (5, "not a url é \U0001f600"), (6, "http://spam-farm.example.com/" + "a" * 50_000), (7, "http://other.example.org/?q=1")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS score", "'x' AS features", "1 AS id", "2 AS length", "3 AS s1")
    out = urls.filter_urls(df, urls.by_list(df)).collect()
    assert len(out) == len(rows)
    assert [r["bad"] for r in out if r["page_id"] == 3] == [False] and [r["score"] for r in out if r["page_id"] == 3] == [None]
    assert urls.filter_urls(df.where("false"), urls.by_list(df)).count() == 0
    assert {(r["score"], r["bad"]) for r in urls.filter_urls(df, urls.by_list(df, ("none",))).collect()} == {(None, False)}
