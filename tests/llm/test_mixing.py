import glob
import os

import duckdb
import pytest

from tracklathe.llm import mixing


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return sorted(map(tuple, con.execute(mixing.SQL).fetchall()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for p in glob.glob(f"{path}/documents.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = mixing.query(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(mixing.SQL).fetchall(), key=str)


def test_fixed_sizes_and_targets(make):
    docs = make([(i, "word " * (1 + i % 7), "en", "src0" if i % 4 else "other", 0) for i in range(400)])
    rows = mixing.pareto_copies(docs, ratio=0.5).select("source", "copies", "text").collect()
    chars = {}
    for r in rows:
        chars[r["source"]] = chars.get(r["source"], 0) + r["copies"] * len(r["text"])
    total = sum(len(r["text"]) for r in rows)
    assert chars["src0"] / total == pytest.approx(0.5 * 4 / 5, abs=0.03)
    assert chars["other"] / total == pytest.approx(0.5 / 5, abs=0.03)
    out = mixing.mix(docs, ratio=0.5)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)


def test_inclusion_follows_the_odds(make):
    docs = make([(i, "x" * (400 if i % 2 else 4), "en", "s", 0) for i in range(2000)])
    rows = mixing.pareto_copies(docs, ratio=0.2).select("doc_id", "copies").collect()
    long, short = (sum(r["copies"] for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
    assert long / short == pytest.approx(21 / 3, rel=0.35)


def test_repeated_rows_across_the_cut(make):
    docs = make([(1, "same text", "en", "s", 9)] * 10)
    assert sum(r["copies"] for r in mixing.pareto_copies(docs, ratio=0.5).collect()) == 5


def test_odd_rows(odd, none):
    rows = mixing.pareto_copies(odd).collect()
    assert len(rows) == 10 and all(r["copies"] >= 0 for r in rows)
    got = sorted(((r["doc_id"], r["source"], r["copies"]) for r in rows if r["copies"]), key=str)
    plain = odd.select("doc_id", "text", "source").toPandas()
    plain["doc_id"] = plain["doc_id"].astype("Int64")
    assert got == by_sql(plain)
    assert mixing.mix(none).count() == 0 and mixing.mix(none).columns == none.columns


def test_mix_keeps_a_column_called_copies(spark):
    rows = [(i, "some words " * (i % 5 + 1), "src0" if i % 2 else "b", 100 + i) for i in range(40)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, copies long"))
    assert out.columns == ["doc_id", "text", "source", "copies"]
    found = out.collect()
    assert found and all(r["copies"] == 100 + r["doc_id"] for r in found)
