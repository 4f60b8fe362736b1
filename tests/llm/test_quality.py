import numpy as np
import pyarrow as pa
import pytest

from tracklathe.llm import quality


@pytest.fixture(scope="module")
def split(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    rng = np.random.default_rng(0)
    order = rng.permutation(len(rows))
    return [rows[i] for i in order[:2000]], [rows[i] for i in order[2000:3200]]


@pytest.fixture(scope="module")
def model(split):
    return quality.fit([r["text"] for r in split[0]], np.array([r["quality"] for r in split[0]]))


def test_held_out_accuracy(split, model):
    held = split[1]
    score = model.score(pa.array([r["text"] for r in held]))
    keep = ~(score < quality.THRESHOLD)
    truth = np.array([r["quality"] for r in held])
    assert keep[truth == 1].mean() >= 0.99
    assert keep[truth == 0].mean() <= 0.1


def test_votes_equal_brute_force(split, model):
    x = model.embed(pa.array([r["text"] for r in split[1][:40]]))
    got = model.vote(x)
    for i in range(40):
        sims = [float(x[i] @ v) for v in model.vectors]
        near = sorted(range(len(sims)), key=lambda j: -sims[j])[: quality.NEIGHBOURS]
        w = [max(sims[j], 0) * model.weights[model.labels[j]] for j in near]
        assert got[i] == pytest.approx(sum(a * model.labels[j] for a, j in zip(w, near)) / sum(w), abs=0.02)


def test_rows(spark, odd, none, make):
    good = [(100 + i, f"calm and readable prose number {i} about rivers and hills", "en", "a", 0) for i in range(30)]
    bad = [(200 + i, "$$$ ### buy *** now!! " * (3 + i), "en", "a", 0) for i in range(30)]
    known = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 1), (100, 0, 0), (299, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'y' AS id")
    docs = make(good + bad).unionByName(odd)
    out = quality.classify(docs, known).collect()
    assert len(out) == 70
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            assert r["keep"] == (r["doc_id"] < 200)
        if r["doc_id"] in (2, 3):
            assert r["score"] is None and r["keep"]
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in out)
    assert quality.classify(none, known).count() == 0
    assert {(r["score"], r["keep"]) for r in quality.classify(docs, known.where("quality = 1")).collect()} == {(None, True)}
