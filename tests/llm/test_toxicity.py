import itertools

import numpy as np
import pytest

from tracklathe.llm import toxicity as tox


def kernel(a, b):
    """The string kernel by enumeration, normalised as the operator does."""

    def features(w):
        c = [ord(ch) for ch in w.translate(tox.ALPHABET)]
        out = {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i <= tox.SPAN and j - i < tox.SPAN and k - j < tox.SPAN:
                key = (c[i], c[j], c[k])
                out[key] = out.get(key, 0) + tox.DECAY ** (k - i - 2)
        norm = sum(tox.DECAY ** (2 * (k - i - 2)) for i, _, k in itertools.combinations(range(len(c)), 3) if k - i <= tox.SPAN)
        return out, norm**0.5

    (fa, na), (fb, nb) = features(a), features(b)
    return sum(v * fb.get(k, 0) for k, v in fa.items()) / (na * nb) if na and nb else 0.0


def test_kernel_is_the_sum_over_subsequences():
    words = ["idiot", "id-iot", "idxiot", "banana", "a", "ab", "éàü", "1d10t", "thththth"]
    made = tox.dense(words)
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert made[i] @ made[j] == pytest.approx(kernel(words[i], words[j]), abs=1e-4)
    theta = 0.5 * made[0] - 0.2 * made[3]
    wanted = [0.5 * kernel(w, "idiot") - 0.2 * kernel(w, "banana") + 0.1 for w in words]
    assert np.allclose(tox.apply(theta, 0.1, words), wanted, atol=1e-4)


@pytest.mark.parametrize("first, count", [(0x431, 30), (0x3B2, 22), (0x628, 28), (0x4E00, 3000)])
def test_words_of_other_scripts_differ(first, count):
    rng = np.random.default_rng(5)
    letters = [chr(first + k) for k in range(count) if chr(first + k).isalpha()]
    made = tox.dense(["".join(rng.choice(letters, 8)) for _ in range(40)])
    apart = (made @ made.T)[np.triu_indices(40, 1)]
    assert apart.mean() < 0.02 and apart.max() < 0.6


def test_accents_and_look_alikes_are_folded():
    made = tox.dense(["idiot", "ïdîöt", "іdіоt", "ｉｄｉｏｔ"])
    assert all(np.allclose(row, made[0], atol=1e-6) for row in made)


SYLLABLES = "the and of ing tion er ed re st en or ti ha nd wh".split()
INSULTS = ["idiot", "moron", "scumbag", "worthless", "pathetic"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES, int(rng.integers(1, 4)))) for _ in range(40)]
        bad = i % 3 == 0
        for _ in range(2 * bad):
            words.insert(int(rng.integers(len(words))), str(rng.choice(INSULTS)))
        texts.append(" ".join(words) + ".")
        labels.append(int(bad))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return tox.fit(*corpus(400, 1))


def test_held_out_accuracy(model):
    texts, labels = corpus(150, 2)
    caught = model.score(texts, {}) > 0
    assert caught[labels == 1].mean() >= 0.95
    assert caught[labels == 0].mean() <= 0.03


def test_altered_insults(model):
    base = "the and tion there ending whrest "
    for word in ("i.d.i.o.t", "m o r o n", "1d10t", "path-etic", "worthlesss", "IDIOT!!", "scumxbag"):
        assert model.score([base + word], {})[0] > 0, word
    assert model.score([base], {})[0] < 0


def test_insults_with_a_space_put_in(model):
    base = "the and tion there ending whrest "
    for phrase in ("mo ron", "id iot", "path etic", "scum bag"):
        assert model.score([base + phrase], {})[0] > 0, phrase


def test_phrases_of_ordinary_words():
    rng = np.random.default_rng(6)
    names = ["".join(rng.choice(SYLLABLES, 3)) for _ in range(600)]

    def made(bad):
        words = [str(w) for w in rng.choice(names, 60)]
        words[5], words[25] = rng.permutation(["jump", "off"]).tolist()
        return " ".join([*words[:40], "jump", "off", *words[40:]] if bad else words) + "."

    labels = np.array([int(i % 3 == 0) for i in range(600)])
    fitted = tox.fit([made(y) for y in labels[:450]], labels[:450])
    caught = fitted.score([made(y) for y in labels[450:]], {}) > 0
    assert caught[labels[450:] == 1].mean() >= 0.9 and caught[labels[450:] == 0].mean() <= 0.1


def test_units_are_scored_as_words():
    codes, first, last, owner = tox.units(["ab cde. Fg!", "", "m o r o n é"])
    got = [(tox.spell(codes[a:b]), int(o)) for a, b, o in zip(first, last, owner)]
    assert {("ab", 0), ("abcde", 0), ("fg", 0), ("morone", 2)} <= set(got) and ("cdefg", 0) not in got
    theta = np.random.default_rng(7).normal(size=tox.SIZE)
    assert np.allclose(tox.totals(theta, codes, first, last), tox.apply(theta, 0.0, [u for u, _ in got]))


def test_rows(spark, odd, none, make):
    texts, labels = corpus(120, 3)
    rows = [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    known = spark.createDataFrame([(100 + i, 1, int(y)) for i, y in enumerate(labels)] + [(None, None, None), (100, 1, int(labels[0])), (101, 1, 1 - int(labels[1]))], "doc_id long, quality int, toxic int")
    docs = make(rows).unionByName(odd)
    out = tox.detect(docs, known).collect()
    assert len(out) == len(rows) + 10
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 100:
            assert not r["toxic"] and (r["score"] is None) == (r["doc_id"] in (2, 3, 4))
    kept = tox.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["toxic"] for r in out)
    assert tox.detect(none, known).count() == 0
    assert {(r["score"], r["toxic"]) for r in tox.detect(odd, known.where("false")).collect()} == {(None, False)}
