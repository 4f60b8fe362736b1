from collections import Counter

import pytest

import corpus_pipeline
from tracklathe.llm import mixing, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    names = docs.columns
    wanted = [
        lambda d: {r["doc_id"]: 1 for r in quality.classify(d, labels).where("keep").collect()},
        lambda d: {r["doc_id"]: 1 for r in toxicity.detect(d, labels).where("NOT toxic").collect()},
        lambda d: dict.fromkeys({r["doc_id"] for r in d.collect()} - {i for r in simhash.near_duplicates(d).collect() for i in r["doc_ids"] if i != r["keep_id"]}, 1),
        lambda d: {r["doc_id"]: r["copies"] for r in mixing.pareto_copies(d).where("copies > 0").collect()},
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES, wanted):
        out = stage(spark, docs, SF)
        assert out.columns == names
        counted = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert counted == want(docs)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    segments = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["n_tokens"] for r in segments) == sum(len(r["text"].split()) for r in docs.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, segments), key=str)
    assert packing.WINDOW == max(w["n"] for w in whole.groupBy("window_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect())


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, odd, k):
    """Nulls, blank and long texts, repeats and clashing columns through each stage by itself."""
    out = corpus_pipeline.STAGES[k][1](spark, odd, SF)
    rows = out.collect()
    if k == 4:
        assert sum(r["n_tokens"] for r in rows) == 4 * 2 + 4 + 60_000 + 1 + 3
        return
    assert out.columns == odd.columns and all(r["copies"] == r["row"] == r["key"] == "extra" for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    if k < 2:
        assert len(rows) == 10  # no labels of these documents: all stay
    if k == 2:
        assert ids == {1: 1, 2: 1, None: 2, 3: 1, 5: 1, 6: 1, 7: 1}  # texts without words are copies, null ones aren't
    if k == 3:
        assert set(ids) <= {1, 2, None, 3, 4, 5, 6, 7}


def test_rows_that_repeat_are_judged_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs)
    for k in (0, 1):
        stage = corpus_pipeline.STAGES[k][1]
        found = Counter(r["doc_id"] for r in stage(spark, twice, SF).collect())
        assert set(found.values()) == {2}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if "window_id" in out.columns else out
