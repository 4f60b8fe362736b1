import numpy as np
import pytest

from tracklathe.llm import simhash
from tracklathe.llm.graph import components


def brute(rows):
    """Groups by comparing all fingerprints with all."""
    known = [(i, t) for i, t in rows if t is not None]
    prints = simhash.fingerprints([t for _, t in known]).astype(np.uint64)
    parent = list(range(len(known)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(known)):
        bits = np.bitwise_count(prints[a] ^ prints)
        for b in np.flatnonzero((bits.min(1) <= simhash.BITS) & (bits.sum(1) <= simhash.TOTAL)):
            parent[root(int(b))] = root(a)
    groups = {}
    for k, (i, _) in enumerate(known):
        groups.setdefault(root(k), []).append(i)
    return sorted((sorted(g, key=lambda i: (i is None, i or 0)) for g in groups.values() if len(g) > 1), key=str)


def groups(df):
    return sorted((r["doc_ids"] for r in simhash.near_duplicates(df).collect()), key=str)


@pytest.fixture
def copies(make):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for base in range(12):
        words = [word() for _ in range(150)]
        for copy in range(1 + base):
            text = list(words)
            for _ in range(copy % 4):
                text[int(rng.integers(150))] = word()
            rows.append((len(rows), " ".join(text), "en", "a", 0))
    return rows


def test_equals_brute_force(make, copies):
    got = groups(make(copies))
    assert got == brute([r[:2] for r in copies]) and len(got) == 11


def test_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert groups(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_copies_with_some_words_changed(make):
    rng = np.random.default_rng(8)
    rows, pairs = [], 60
    for k in range(pairs):
        n = (30, 100)[k % 2]
        words = [f"w{int(x)}" for x in rng.integers(5000, size=n)]
        copy = list(words)
        for j in rng.choice(n, n // 15, replace=False):
            copy[j] = f"v{int(rng.integers(5000))}"
        rows += [(2 * k, " ".join(words), "en", "a", 0), (2 * k + 1, " ".join(copy), "en", "a", 0)]
    found = [r["doc_ids"] for r in simhash.near_duplicates(make(rows), simhash.NEAR).collect()]
    assert all(ids == [ids[0], ids[0] + 1] for ids in found) and len(found) >= 0.9 * pairs
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(make(rows), simhash.NEAR).collect()) == sorted({r[0] for r in rows} - {ids[1] for ids in found})


def test_close_prints_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(1 << 63))
        b = a
        for bit in rng.choice(64, simhash.BITS, replace=False):
            b ^= 1 << int(bit)
        same = [(a >> 8 * k & 255) == (b >> 8 * k & 255) for k in range(8)]
        assert sum(same) >= simhash.SHARED and max(sum(same[:4]), sum(same[4:])) >= 3


def test_one_of_each_group_stays(make, copies):
    docs = make([*copies, copies[5], copies[5]])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    gone = {i for g in brute([r[:2] for r in copies]) for i in g[1:]}
    assert ids == [r[0] for r in copies if r[0] not in gone]


def test_odd_rows(odd, none):
    assert groups(odd) == [[1, 1], [3, 4]]
    kept = simhash.drop_near_duplicates(odd)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 6, 7, None, None], key=str)
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_long_lists_take_several_rows(make, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 2)
    rows = simhash.near_duplicates(make([(i, "one text for all of them", "en", "a", 0) for i in range(5)])).collect()
    assert sorted(r["doc_ids"] for r in rows) == [[0, 1], [2, 3], [4]] and {r["keep_id"] for r in rows} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102, 200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
