import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklathe.llm import language_model as lm

WORD = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}|(?:(?![\xe3-\xed])[0-9a-z\x80-\xff])+|[^\x00-\x20\x7f]")


def words(text):
    return WORD.findall((text or "").lower().encode())


@pytest.fixture
def docs(make):
    rng = np.random.default_rng(0)
    some = "the a cat dog sat on mat, ran é 東京 x1 to the, hill and back".split()
    texts = [" ".join(rng.choice(some, int(rng.integers(0, 40)))) for _ in range(300)]
    return make([(i, t, "en", "a", 0) for i, t in enumerate(texts + texts[:5])])


@pytest.mark.parametrize("text", ["", "  ", "one", "one, two\tthree.", "東京タワーa 東b", "é1-é2 \x00x", "a" * 300 + " " + "b" * 50])
def test_words(text, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 7)
    raw = text.encode()
    places, hashes = lm.hashed(np.frombuffer(raw, np.uint8))
    found = list(WORD.finditer(raw))
    assert places.tolist() == [m.start() for m in found]
    assert len(set(hashes.tolist())) == len({m[0] for m in found})


def test_packed_round_trip():
    x = np.array([0, 1, 255, 256, 2**40, 2**62], np.uint64)
    assert (lm.unpacked(lm.packed(x)) == x).all() and len(lm.unpacked(lm.packed(x[:0]))) == 0


@pytest.mark.parametrize("bits", [8, 40, 50, 62])
def test_codes_are_ranked_by_a_plain_sort(bits, monkeypatch):
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << bits, 50_000, np.uint64)
    code[::7] = code[3]
    order = np.argsort(code, kind="stable")
    sizes = rng.integers(0, 40, 500)
    shard = lm.Shard(sizes, rng.integers(0, 1 << 62, 300, np.uint64), rng.integers(0, 300, int(sizes.sum())))
    wanted = [np.unique(lm.mixed(shard.grams[k - 1][shard.scored if k == lm.ORDER else shard.asked] + np.uint64(k)) >> np.uint64(24), return_counts=True) for k in (1, 2, 3)]
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: pytest.fail("stable sort of places"))
    found = lm.ranked(code, bits)
    assert (found[0] == code[order]).all() and (found[1] == order).all()
    for k in (1, 2, 3):
        for got in (shard.kinds(k, 40), shard.counted(k, 40)):
            assert (got[0] == wanted[k - 1][0]).all() and (got[1] == wanted[k - 1][1]).all()
    monkeypatch.setattr(np, "argsort", argsort)
    near = (np.uint64(1) << np.uint64(61)) + rng.integers(0, 3, 50_000, np.uint64)  # differ in bits that don't fit beside the place
    assert (lm.ranked(near, 62)[1] == np.argsort(near, kind="stable")).all()
    assert [len(x) for x in lm.ranked(code[:0], bits)] == [0, 0]


def grams(text, k):
    row = ["<", "<", *words(text), ">"] if words(text) else []
    return [tuple(row[i - k + 1 : i + 1]) for i in range(2 if k == lm.ORDER else 1, len(row))]


def brute(texts, held):
    """Scores by dictionaries: estimates, expectation-maximisation and scoring by the counts of other texts."""
    count = lambda some: [Counter(g for t in some for g in grams(t, k)) for k in (1, 2, 3)]
    every, train = count(texts), count([t for t, h in zip(texts, held) if not h])
    distinct = len(every[0]) - 1

    def estimates(text, have):
        row = ["<", "<", *words(text), ">"]
        for i in range(2, len(row)):
            total = sum(have[0].values()) - have[0][("<",)]
            contexts = [total, have[0][(row[i - 1],)], have[1][(row[i - 2], row[i - 1])]]
            p, bucket = [1 / (distinct + 1)], 0
            for k in range(3):
                p.append(have[k][tuple(row[i - k : i + 1])] / contexts[k] if contexts[k] > 0 else 0.0)
                if contexts[k] > 0:
                    bucket = 64 * (k + 1) + int(math.log2(contexts[k]))
            yield bucket, p

    rows = [e for t, h in zip(texts, held) if h and words(t) for e in estimates(t, train)]
    weights = {b: [1 / (b // 64 + 1) if k <= b // 64 else 0.0 for k in range(4)] for b in range(256)}
    before, history = -math.inf, []
    for _ in range(lm.ROUNDS):
        sums, n, bits = {}, Counter(), 0.0
        for b, p in rows:
            mix = sum(w * x for w, x in zip(weights[b], p))
            bits += math.log2(mix)
            n[b] += 1
            sums[b] = [s + w * x / mix for s, w, x in zip(sums.get(b, [0.0] * 4), weights[b], p)]
        weights |= {b: [s / n[b] for s in sums[b]] for b in sums}
        bits /= len(rows)
        history.append(bits)
        if bits - before < lm.GAIN:
            break
        before = bits
    out = []
    for t in texts:
        rest = [Counter({g: n for g, n in (c - Counter(grams(t, k + 1))).items()}) for k, c in enumerate(every)]
        own = [math.log2(sum(w * x for w, x in zip(weights[b], p))) for b, p in estimates(t, rest)] if words(t) else []
        out.append(-sum(own) / len(own) if own else None)
    return out, history


def test_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 6)
    rows = docs.select("doc_id", "text", (F.pmod(F.xxhash64("text"), F.lit(lm.HELD)) == 0).alias("held")).orderBy("doc_id").collect()
    wanted, history = brute([r["text"] for r in rows], [r["held"] for r in rows])
    assert len(history) > 2 and all(b >= a - 1e-12 for a, b in zip(history, history[1:]))
    got = lm.score(docs).orderBy("doc_id").collect()
    for r, w in zip(got, wanted):
        assert r["bits"] == (None if w is None else pytest.approx(w, abs=1e-6))
        assert r["perplexity"] == (None if w is None else pytest.approx(2**w, rel=1e-5))


def test_shards_are_cut(docs, monkeypatch):
    batches = docs.where("doc_id < 100").select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("held")).toArrow().to_batches()
    monkeypatch.setattr(lm, "SHARD", 500)
    found = list(lm.shards(iter(batches)))
    assert len(found) > 10 and len({f[0] for f in found}) == len(found)
    assert sorted(i for f in found for i in f[2]) == list(range(100))
    assert all(i % 3 == 0 for f in found if f[1] for i in f[2])


def test_copies_foresee_each_other(make):
    rng = np.random.default_rng(1)
    invented = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(invented, 30)) for _ in range(60)]
    out = {r["doc_id"]: r["bits"] for r in lm.score(make([(i, t, "en", "a", 0) for i, t in enumerate(texts + texts[:5])])).collect()}
    once = [out[i] for i in range(5, 60)]
    assert all(out[i] < min(once) and out[i] == pytest.approx(out[60 + i]) for i in range(5))


def test_shuffled_table(docs):
    same = lm.score(docs.repartition(5)).orderBy("doc_id").collect()
    assert [r["bits"] for r in same] == [None if r["bits"] is None else pytest.approx(r["bits"]) for r in lm.score(docs).orderBy("doc_id").collect()]


def test_odd_rows(odd, none):
    rows = lm.score(odd).collect()
    assert len(rows) == 10
    assert sorted(r["n_words"] for r in rows if r["bits"] is None) == [0, 0, 0, 0]
    assert lm.score(none).count() == 0
    assert {r["bits"] for r in lm.score(odd.where("text IS NULL")).collect()} == {None}
