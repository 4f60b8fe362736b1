import numpy as np
import pytest

from tracklathe.llm import embeddings as emb


def pairs(x, ids, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= cosine, 1)))}


def test_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 64))
    near = base[:200] + rng.normal(size=(200, 64)) * rng.uniform(0.05, 0.32, (200, 1))
    x = np.concatenate([base, near])
    ids = list(range(600))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int")
    got = {(r["vec_a"], r["vec_b"]) for r in emb.near_pairs(df).collect()}
    wanted = pairs(x.astype(np.float32).astype(float), ids, emb.COSINE)
    assert got <= wanted and len(wanted) > 100 and len(got) / len(wanted) >= 0.95


def test_count_is_calibrated():
    assert emb.needed() == 17
    assert emb.needed(recall=0.5) > emb.needed(recall=0.99)


def test_groups_follow_the_table():
    near = emb.together(0.316, 8 * 0.316)
    assert near == pytest.approx(0.9, abs=0.01)
    sizes = [emb.groups(10**k, 0.57, near) for k in (1, 4, 6, 9)]
    assert sizes == sorted(sizes) and sizes[-1][1] < 20 * sizes[1][1]  # for a hundred thousand times the vectors
    assert all(10**k * 0.57**lines <= emb.MATES for k, (lines, _) in zip((1, 4, 6, 9), sizes))


def test_together_is_the_chance():
    rng = np.random.default_rng(0)
    a, cut = rng.normal(size=100_000) * 0.4, rng.random(100_000)
    same = np.floor(cut) == np.floor(cut + a / 1.0)
    assert same.mean() == pytest.approx(emb.together(0.4, 1.0), abs=0.01)


def test_recall_at_size(spark):
    """Groups of up to fifty near copies among thousands of unrelated vectors: brute force over all pairs."""
    rng = np.random.default_rng(5)
    parts = [rng.normal(size=(3000, 48))]
    for n in [2] * 60 + [10] * 5 + [50]:
        parts.append(rng.normal(size=48) + rng.normal(size=(n, 48)) * rng.uniform(0.02, 0.22))
    x = np.concatenate(parts).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["vec_a"], r["vec_b"]) for r in emb.near_pairs(df).collect()}
    wanted = pairs(x.astype(float), list(range(len(x))), emb.COSINE)
    assert got <= wanted and len(wanted) > 500 and len(got) / len(wanted) >= 0.95


def test_odd_rows(spark):
    v = [0.5] * 8
    nan = float("nan")
    rows = [(1, v), (1, v), (2, v), (None, v), (3, None), (4, []), (5, [0.0] * 8), (6, [nan] * 8), (7, [1.0, None] * 4), (8, [0.5] * 4), (9, [-x for x in v]), (10, [x * 3 for x in v]), (11, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS key", "3 AS a", "4 AS cosine", "5 AS v")
    got = sorted((r["vec_a"], r["vec_b"], r["cosine"]) for r in emb.near_pairs(df).collect())
    assert got == [(1, 2, 1.0), (1, 10, 1.0), (2, 10, 1.0)]
    assert emb.near_pairs(df.where("false")).count() == 0


def classes(x, ids, cosine=emb.COSINE):
    """For each id its class and number of links, by brute force."""
    linked = {i: set() for i in ids}
    for a, b in pairs(x, ids, cosine):
        linked[a].add(b)
        linked[b].add(a)
    found = {}
    for i in sorted(linked):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in found:
                found[j] = i
                stack += linked[j]
    return {(i, found[i], len(linked[i])) for i in ids}


def planted(seed, sizes, unrelated=500, width=48, spread=0.15):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(unrelated, width))] + [rng.normal(size=width) + rng.normal(size=(n, width)) * spread for n in sizes]
    return np.concatenate(parts).astype(np.float32)


def told(df, cosine=emb.COSINE):
    rows = [tuple(r) for r in emb.near_classes(df, cosine).select("vec_id", "class_id", "links").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


VECTORS = "vec_id long, embedding array<float>"


def test_query_has_a_row_for_each_vector(spark, tmp_path):
    """Copies that grow with the table: the pairs would grow with its square."""
    for n in (100, 400):
        x = planted(3, [n], unrelated=n)
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).write.parquet(str(tmp_path / f"{n}" / "embeddings.parquet"))
        got = emb.query(spark, str(tmp_path / f"{n}"))
        assert got.columns == ["vec_id", "class_id", "links"] and got.count() == 2 * n
        assert {tuple(r) for r in got.collect()} == classes(x.astype(float), list(range(2 * n)))


@pytest.mark.parametrize("whole, block", [(emb.WHOLE, emb.BLOCK), (8, 2000)])
def test_classes(spark, monkeypatch, whole, block):
    """With a class over WHOLE, one of many equal vectors, and, the second time, classes of several blocks."""
    monkeypatch.setattr(emb, "WHOLE", whole)
    monkeypatch.setattr(emb, "BLOCK", block)
    x = np.concatenate([planted(7, [300, 90, 12, 12] + [2] * 40), np.repeat(planted(8, [1], 0), 150, axis=0)])
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(x)) - 400]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], VECTORS)
    assert told(df) == classes(x.astype(float), ids)


def test_links_between_first_classes(spark, monkeypatch):
    """Two balls of copies linked by a few pairs of thousands, and single vectors linked to a few of a ball: leaders miss these."""
    monkeypatch.setattr(emb, "WHOLE", 8)
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(48, 10)))[0].T
    at = lambda k, t: q[0] * np.cos(t) + q[k] * np.sin(t)
    balls = [c + rng.normal(size=(n, 48)) * 0.02 for c, n in ((q[0], 100), (at(1, 0.38), 80))]
    x = np.concatenate([*balls, [at(k, 0.32) for k in range(2, 10)], planted(9, [])]).astype(np.float32)
    ids = list(range(len(x)))
    wanted = classes(x.astype(float), ids)
    across = [p for p in pairs(x.astype(float), ids, emb.COSINE) if p[0] < 100 <= p[1]]
    assert sum(b < 180 for _, b in across) in range(1, 10) and len({b for _, b in across if b >= 180}) >= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], VECTORS)
    assert told(df) == wanted


def test_classes_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    x = planted(2, [70, 5, 2, 2])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    con = duckdb.connect()
    con.register("given", frame.toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM given")
    wanted = con.execute(emb.SQL).fetchall()
    assert told(frame) == set(wanted) and len(wanted) == len(x) and max(r[2] for r in wanted) == 69


def test_classes_of_odd_rows(spark):
    v, w = [0.5] * 8, [0.5, -0.5] * 4
    nan = float("nan")
    rows = [(1, v), (1, v), (1, w), (2, v), (2, w), (None, v), (3, None), (4, []), (5, [0.0] * 8), (6, [nan] * 8), (7, [1.0, None] * 4), (8, [0.5] * 4), (9, [-x for x in v]), (10, [x * 3 for x in v]), (11, [float("inf")] * 8), (12, w)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS key", "3 AS a", "4 AS cosine", "5 AS v", "6 AS links", "7 AS whole")
    single = {(i, i, 0) for i in (3, 4, 5, 6, 7, 8, 9, 11)}
    assert told(df) == single | {(1, 1, 3), (2, 1, 3), (10, 1, 2), (12, 1, 2)}
    assert emb.near_classes(df.where("false")).count() == 0
