import math

import duckdb
import numpy as np
import pytest

from tracklathe.llm import topk


def brute(docs, queries, k):
    """All scores of all documents for all queries."""
    counts = [topk.terms(t) for _, t in docs]
    n, average = len(docs), sum(map(len, counts)) / len(docs)
    out = []
    for item, q in queries:
        found = []
        words = set(topk.terms(q))
        idf = {w: math.log(1 + (n - (d := sum(w in c for c in counts)) + 0.5) / (d + 0.5)) for w in words}
        for (i, _), c in zip(docs, counts):
            if words & set(c):
                s = sum(idf[w] * (f := c.count(w)) * (topk.K1 + 1) / (f + topk.K1 * (1 - topk.B + topk.B * len(c) / average)) for w in words if w in c)
                found.append((-round(s, topk.DIGITS), i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("stride", [4, 64])
def test_equals_brute_force(spark, make, monkeypatch, stride):
    monkeypatch.setattr(topk, "STRIDE", stride)
    monkeypatch.setattr(topk, "SHARD", 50)
    rng = np.random.default_rng(0)
    zipf = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 60)
    docs = [(i, zipf(int(rng.integers(1, 40)))) for i in range(300)]
    queries = [(i, zipf(int(rng.integers(1, 9)))) for i in range(25)]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = topk.search(make([(i, t, "en", "a", 0) for i, t in docs]), asked, 7).collect()
    wanted = brute(docs, queries, 7)
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got) == sorted(w[:3] for w in wanted)
    assert {(r["item_id"], r["rank"]): r["score"] for r in got} == pytest.approx({w[:2]: w[3] for w in wanted}, abs=1e-5)


def test_skips_postings():
    counts = [{"common": 1, **({"rare": 1} if i < 30 else {})} for i in range(20_000)]
    index = topk.build(list(range(20_000)), counts, [10] * 20_000, {"common": 0.01, "rare": 5.0}, 10)
    at, _ = topk.max_score(index, ["common", "rare"], 5)
    assert at.tolist() == [0, 1, 2, 3, 4]


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = topk.query(spark, sf).collect()
    wanted = con.execute(topk.SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_odd_rows(spark, odd, none):
    asked = spark.createDataFrame([(1, "plain WORDS"), (1, "plain WORDS"), (2, None), (3, ""), (None, "id"), (4, "word"), (5, "absent")], "item_id long, text string").selectExpr("*", "1 AS query", "2 AS rank", "3 AS score")
    got = topk.search(odd, asked, 3).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"]) for r in got), key=str) == sorted([(1, 1, 1), (1, 2, 1)] * 2 + [(None, 1, None), (4, 1, 5)], key=str)
    assert topk.search(none, asked).count() == 0
    assert topk.search(odd, asked.where("false")).count() == 0
