"""Toxicity: support vector machine on a gapped-subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.llm._shared import table
from tracklathe.llm.quality import sample

#: Production parameters. PER_CLASS bounds the labelled documents of each class whose sentences the machine learns from.
PER_CLASS = 2000
#: Landmarks: words most tied to toxic documents, and random others.
LANDMARKS = (160, 64)
#: Subsequences of three characters within SPAN; each character skipped costs a factor DECAY.
SPAN = 6
DECAY = 0.6
PENALTY = 0.02
#: A word always counts as toxic in training if at least this share of toxic documents has it, this many times as often as clean ones.
TELLING = (0.015, 15.0)
#: An error on a clean document weighs this much against one on a toxic document.
CAUTION = 5.0
#: Weight of toxic documents with a letter put into their worst word against those as they are, where the threshold is set.
DODGED = 0.25
#: Where in the gap between clean and toxic the threshold lies: nearer to clean, as altered insults score less than plain ones.
PLACE = 0.35
#: Adjacent words of a sentence that are also read as one, at most.
WINDOW = 3
#: Toxic documents that a phrase must be in to be learned as one.
PHRASE = 3
#: Digits of values that are compared in the fit, so that the last bits, which differ by machine, don't decide ties.
EXACT = 5
#: Characters of text scored at once.
CHUNK = 1 << 18
ROUNDS = 4
SEED = 11

#: Symbols of a to z, whose triples have places of their own in the table of weights, and places for the hashed triples with other letters.
SYMBOLS = 32
HASHED = 1 << 20
SIZE = SYMBOLS**3 + HASHED
#: Letters that look like others, or are written for them.
ALIKE = dict(zip("аеорсухіјѕһԁԛԝοαινρκυχıłøđðɑɡ", "aeopcyxijshdqwoaivpkuxiloddag")) | {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SENTENCE = re.compile(r"[.!?]+\s|\n+")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


class Alphabet(dict):
    """str.translate table: letters to 1..26, digits to the letters they stand for, the rest but letters dropped.

    Accents are dropped and look-alikes folded to the letters they look like; every other letter is its own symbol.
    """

    def __missing__(self, code: int):
        plain = unicodedata.normalize("NFKD", DIGITS.get(chr(code), chr(code))).lower()
        folded = "".join(ALIKE.get(c, c) for c in plain)
        self[code] = "".join(chr(ord(c) - 96) if "a" <= c <= "z" else c for c in folded if c.isalpha() or signs_vowel(c)) or None
        return self[code]


def signs_vowel(c: str) -> bool:
    """Marks that spell a sound, as in Indic scripts, and not an accent."""
    return (0x900 <= ord(c) < 0x1B00 or c in "\u3099\u309a") and unicodedata.category(c)[0] == "M"


ALPHABET = Alphabet()
TEXT, LINE, STOP, SPACE = 28, 29, 30, 31


class Marked(Alphabet):
    """The same with white space, line ends and stops kept as symbols."""

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = chr(LINE if c == "\n" else STOP if c in ".!?" else SPACE) if c in ".!?" or c.isspace() else ALPHABET[code]
        return self[code]


MARKED = Marked()


def tokens(text: str) -> list[str]:
    """Lower-case words; a run of four or more single characters also counts as the word it spells."""
    text = text.lower()
    found = text.split()
    if len(found) > 3 and "1111" in "".join(["1" if len(w) == 1 else "0" for w in found]):
        found += [re.sub(r"\s", "", m) for m in SPACED.findall(text)]
    return found


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in a row, and the length of each."""
    coded = [w.translate(ALPHABET) for w in words]
    return np.frombuffer("".join(coded).encode("utf-32-le", "replace"), np.uint32).astype(np.int64), np.fromiter(map(len, coded), np.int64, len(coded))


def scale(lengths: np.ndarray) -> np.ndarray:
    """1 / norm of a word's subsequence weights, by its length; 0 for words under three symbols."""
    n = np.arange(int(lengths.max(initial=0)) + 1)
    square = sum(np.maximum(n - a - b, 0) * DECAY ** (2 * (a + b - 2)) for a, b in GAPS)
    return np.where(square > 0, 1 / np.sqrt(np.maximum(square, 1e-12)), 0.0)[lengths]


def places(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Place of each triple of symbols in the table of weights."""
    at = (x * SYMBOLS + y) * SYMBOLS + z
    other = np.flatnonzero((x | y | z) >= SYMBOLS)
    if len(other):
        x, y, z = (v[other].astype(np.uint64) for v in (x, y, z))
        h = x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F) + z * np.uint64(0x165667B19E3779F9)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        at[other] = SYMBOLS**3 + (h >> np.uint64(44)).astype(np.int64)
    return at


def subsequences(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: the word, the place of the three symbols, and the weight, of every subsequence."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    for a, b in GAPS:
        if len(codes) > a + b:
            m = np.flatnonzero(word[: -a - b] == word[a + b :])
            yield word[m], places(codes[m], codes[m + a], codes[m + a + b]), DECAY ** (a + b - 2)


def used(words: list[str]) -> np.ndarray:
    """Places in the table of weights that the words' subsequences have."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *[index for _, index, _ in subsequences(*encode(words))]]))


def dense(words: list[str], columns: np.ndarray | None = None) -> np.ndarray:
    """Normalised weights of all subsequences, or those with places in ``columns``, a row for each word. Their products are the string kernel."""
    codes, lengths = encode(words)
    size = SIZE if columns is None else len(columns)
    out = np.zeros(len(words) * size, np.float32)
    for word, index, weight in subsequences(codes, lengths):
        if columns is not None:
            at = np.minimum(np.searchsorted(columns, index), size - 1)
            known = columns[at] == index if size else np.zeros(len(index), bool)
            word, index = word[known], at[known]
        at, count = np.unique(word * size + index, return_counts=True)
        out[at] += np.float32(weight) * count.astype(np.float32)
    out = out.reshape(len(words), size)
    out *= scale(lengths)[:, None].astype(np.float32)
    return out


def apply(theta: np.ndarray, bias: float, words: list[str]) -> np.ndarray:
    """Decision values: sum over landmarks of weight times kernel, folded into one weight for each subsequence."""
    codes, lengths = encode(words)
    total = np.zeros(len(words))
    for word, index, weight in subsequences(codes, lengths):
        total += np.bincount(word, weights=theta[index], minlength=len(words)) * weight
    return total * scale(lengths) + bias


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, without spaces; first and last-plus-one symbol of each unit, and its text.

    Units are the words, each two to WINDOW adjacent words of a sentence, and runs of four or more words of one letter.
    """
    marked = chr(TEXT).join(t.lower().translate(MARKED) for t in texts)
    row = np.frombuffer(marked.encode("utf-32-le", "replace"), np.uint32)
    space = (row == SPACE) | (row == LINE) | (row == TEXT)
    ends = (row == LINE) | (row == TEXT)
    ends[:-1] |= (row[:-1] == STOP) & space[1:]
    letter = ~space & (row != STOP)
    codes, word = row[letter].astype(np.int64), np.cumsum(space)[letter]
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    end = np.append(begin[1:], len(codes))[: len(begin)]
    sentence, text = np.cumsum(ends)[letter][begin], np.cumsum(row == TEXT)[letter][begin]
    first, last, owner = [begin], [end], [text]
    for n in range(2, WINDOW + 1):
        m = np.flatnonzero(sentence[: 1 - n] == sentence[n - 1 :])
        first, last, owner = [*first, begin[m]], [*last, end[m + n - 1]], [*owner, text[m]]
    single = end - begin == 1
    new = np.ones(len(begin), bool)
    new[1:] = ~(single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(begin))[: len(start)]
    m = single[start] & (stop - start >= 4)
    first, last, owner = [*first, begin[start[m]]], [*last, end[stop[m] - 1]], [*owner, text[start[m]]]
    return codes, np.concatenate(first), np.concatenate(last), np.concatenate(owner)


def totals(theta: np.ndarray, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """As apply() without bias, for units that may overlap: differences of running sums, one for each span."""
    out = np.zeros(len(first))
    for span in range(2, SPAN + 1):
        n = len(codes) - span
        if n <= 0:
            break
        sums = np.zeros(n)
        for a in range(1, span):
            sums += theta[places(codes[:n], codes[a : a + n], codes[span:])]
        sums = np.concatenate([[0.0], np.cumsum(sums)]) * DECAY ** (span - 2)
        out += sums[np.minimum(np.maximum(last - span, first), n)] - sums[np.minimum(first, n)]
    return out * scale(last - first)


def spell(codes: np.ndarray) -> str:
    return "".join(chr(c + 96 if c < SYMBOLS else c) for c in codes.tolist())


def worst_units(theta: np.ndarray, bias: float, text: str, top: int) -> tuple[list[str], float]:
    """The units of a text with the highest values, and the highest."""
    codes, first, last, _ = units([text])
    if not len(first):
        return [], bias
    values = totals(theta, codes, first, last).round(EXACT)
    best = np.argsort(-values, kind="stable")[:top]
    return [spell(codes[first[k] : last[k]]) for k in best], float(values[best[0]]) + bias


def phrases(rows: list[np.ndarray], bad: list[int], good: list[int], words: np.ndarray) -> list[tuple[tuple[int, ...], float, int, int, np.ndarray]]:
    """Adjacent words in PHRASE toxic documents that are tied to them more than any of the words: words, association, documents.

    rows: for each document its words in order, -1 between sentences; words: their association.
    """
    out = []
    for n in range(2, WINDOW + 1):

        def keys(i: int, n: int = n) -> np.ndarray:
            parts = [rows[i][k : len(rows[i]) - n + 1 + k] for k in range(n)]
            key = sum(p << 21 * k for k, p in enumerate(parts))
            return np.unique(key[np.min(parts, axis=0) >= 0]) if len(rows[i]) >= n else np.zeros(0, np.int64)

        own = {i: keys(i) for i in bad}
        known, count = np.unique(np.concatenate([np.zeros(0, np.int64), *own.values()]), return_counts=True)
        known, count = known[count >= PHRASE], count[count >= PHRASE]
        in_good = sum((np.isin(known, keys(i), assume_unique=True).astype(np.int64) for i in good), np.zeros(len(known), np.int64))
        tie = (np.log((count + 0.3) / (len(bad) + 1)) - np.log((in_good + 0.3) / (len(good) + 1))) * np.sqrt(count)
        parts = np.stack([known >> 21 * k & (1 << 21) - 1 for k in range(n)], 1)
        for k in np.flatnonzero(tie > np.maximum(words[parts].max(1), 0)) if len(known) else []:
            out.append((tuple(parts[k].tolist()), float(tie[k]), int(count[k]), int(in_good[k]), np.array([i for i in bad if known[k] in own[i]], np.int64)))
    return out


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton's method; deterministic."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = penalty * 1e-3
    w = np.zeros(x.shape[1])
    before = None
    for _ in range(steps):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        c = cost[active]
        xa = x[active]
        w = np.linalg.solve(xa.T @ (xa * c[:, None]) + np.diag(ridge), xa.T @ (c * y[active]))
    return w[:-1], float(w[-1])


@dataclass
class Model:
    theta: np.ndarray
    bias: float
    threshold: float

    def score(self, texts: list[str | None], cache: dict[str, float] | None = None) -> np.ndarray:
        """Highest decision value of each text's units, less the threshold; NaN for blank texts."""
        out = np.array([self.bias - self.threshold if t and not t.isspace() else np.nan for t in texts], np.float64)
        full = np.flatnonzero(~np.isnan(out)).tolist()
        while full:
            size, k = 0, 0
            while k < len(full) and (not k or size + len(texts[full[k]]) <= CHUNK):
                size, k = size + len(texts[full[k]]), k + 1
            now, full = np.array(full[:k]), full[k:]
            codes, first, last, owner = units([texts[i] for i in now])
            best = np.full(k, -np.inf)
            np.maximum.at(best, owner, totals(self.theta, codes, first, last))
            out[now] = np.where(np.isinf(best), 0.0, best) + self.bias - self.threshold
        return out


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Latent machine over sentences: a sentence counts as its most telling unit, a toxic document as its worst sentence.

    A unit is a word or up to WINDOW adjacent ones. In toxic documents, adjacent words are candidates if they are tied to
    toxic documents more than each of them alone; in clean ones and for the threshold all of them count.

    The labels are of documents. Every sentence of a clean one is clean; of a toxic one, some sentence is toxic, and
    each round picks the one that the machine so far finds worst (at first by association). Clean sentences that score
    high join as counter-examples. A third of the documents sets the
    threshold, with the toxic ones also as they would be with a letter put into their worst word.
    """
    labels = np.asarray(labels)
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(texts)) % 3
    place: dict[str, int] = {}
    ids, rows = [], []
    for t in texts:
        sentences = SENTENCE.split(t)
        bag = sorted({w for s in sentences for w in tokens(s)})
        ids.append(np.array([place.setdefault(w, len(place)) for w in bag], np.int32))
        rows.append(np.array([j for s in sentences for j in [*map(place.get, s.lower().split()), -1]], np.int64))
    vocabulary = list(place)
    del place
    first = originals(ids, len(vocabulary), rng)
    train = np.flatnonzero((part > 0) & first)
    bad = [i for i in train if labels[i] == 1 and len(ids[i])]
    good = [i for i in train if labels[i] == 0 and len(ids[i])]
    count = lambda docs: np.bincount(np.concatenate([ids[i] for i in docs] or [np.zeros(0, np.int32)]), minlength=len(vocabulary))
    in_bad, in_good = count(bad), count(good)
    score = np.log((in_bad + 0.3) / (len(bad) + 1)) - np.log((in_good + 0.3) / (len(good) + 1))
    score = np.where(in_bad >= 2, score * np.sqrt(in_bad), 0.0)
    for parts, tie, n, m, docs in phrases(rows, bad, good, score) if len(vocabulary) < 1 << 21 else []:
        for i in docs:
            ids[i] = np.append(ids[i], np.int32(len(vocabulary)))
        vocabulary.append("".join(vocabulary[j] for j in parts))
        score, in_bad, in_good = np.append(score, tie), np.append(in_bad, n), np.append(in_good, m)
    del rows
    telling = np.flatnonzero((in_bad >= max(3, TELLING[0] * len(bad))) & (in_bad * len(good) >= TELLING[1] * (in_good + 0.3) * len(bad)))
    top = np.argsort(-score, kind="stable")[: LANDMARKS[0]]
    chosen = np.unique(np.concatenate([top[score[top] > 0], rng.choice(len(vocabulary), min(LANDMARKS[1], len(vocabulary)), replace=False)]))
    columns = used([vocabulary[i] for i in chosen])
    marks = dense([vocabulary[i] for i in chosen], columns)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])  # Nyström: kernel to landmarks times this
    active: Counter = Counter()
    hard: dict[str, None] = {}
    theta, bias = np.zeros(SIZE), 0.0
    for turn in range(ROUNDS):
        positive = Counter(int(ids[i][np.argmax(score[ids[i]])]) for i in bad)
        positive.update({int(j): int(in_bad[j]) for j in telling})
        negative = {int(j) for i in good for j in ids[i][np.argsort(-score[ids[i]], kind="stable")[:3]]}
        active.update(dict.fromkeys(negative.difference(positive), 1))
        for j in positive:
            active.pop(j, None)
        if turn:
            hard.update(dict.fromkeys(u for i in good for u in worst_units(theta, bias, texts[i], 3)[0]))
        taken = {vocabulary[j].translate(ALPHABET) for j in [*positive, *active]}
        more = [u for u in hard if u.translate(ALPHABET) not in taken]
        y = np.array([1.0] * len(positive) + [-1.0] * (len(active) + len(more)))
        cost = np.array(list(positive.values()) + [max(1, int(in_good[j])) for j in active] + [1] * len(more), np.float64)
        cost = np.minimum(cost, 50.0)
        cost = np.where(y > 0, cost / cost[y > 0].sum(), cost / cost[y < 0].sum()) * 100
        words = [vocabulary[j] for j in [*positive, *active]] + more
        # beside each toxic word its copies with a letter put in, one for each place; together they weigh as much as the word
        altered = [(alter(words[k], turn, at), cost[k] / (len(words[k]) - 1)) for k in range(len(positive)) if len(words[k]) >= 5 for at in range(1, len(words[k]))]
        words += [a for a, _ in altered]
        y, cost = np.concatenate([y, np.ones(len(altered))]), np.concatenate([cost, [c for _, c in altered]])
        z = np.concatenate([dense(words[k : k + 256], columns) @ marks.T for k in range(0, len(words), 256)]).astype(np.float64) @ root
        w, bias = svm(z, y, cost, PENALTY)
        theta[columns] = (root @ w) @ marks
        score = np.concatenate([apply(theta, bias, vocabulary[k : k + 20_000]) for k in range(0, len(vocabulary), 20_000)]).round(EXACT)
    held = [i for i in np.flatnonzero(part == 0) if len(ids[i])] or [i for i in range(len(texts)) if len(ids[i])]
    found = [worst_units(theta, bias, texts[i], 1) for i in held]
    worst = np.array([value for _, value in found])
    told = ["".join(unit) for i, (unit, _) in zip(held, found) if labels[i] == 1]
    dodged = apply(theta, bias, [alter(w, ROUNDS) for w in told if len(w) >= 5]).round(EXACT)
    weight = np.where(labels[held] == 1, (1 - DODGED) / max(len(told), 1), CAUTION / max(len(held) - len(told), 1))
    scores, truth = np.concatenate([worst, dodged]), np.concatenate([labels[held], np.ones(len(dodged), np.int64)])
    return Model(theta, bias, cut(scores, truth, np.concatenate([weight, np.full(len(dodged), DODGED / max(len(dodged), 1))])))


def alter(word: str, turn: int, at: int | None = None) -> str:
    """The word with a letter put in at a place, any if none is given, as those who dodge filters write it; the same for the same word and turn."""
    rng = np.random.default_rng([SEED, turn, at or 0, zlib.crc32(word.encode("utf-8", "replace"))])
    at = at or int(rng.integers(1, len(word)))
    return word[:at] + chr(97 + int(rng.integers(26))) + word[at:]


def originals(ids: list[np.ndarray], size: int, rng: np.random.Generator) -> np.ndarray:
    """False for all but the first of each family of near copies, whose rare words would pass for telling ones.

    Copies agree in one of six keys, each the least of three random orders of a document's words.
    """
    keys = []
    for _ in range(6):
        three = [rng.permutation(np.arange(size, dtype=np.int32)) for _ in range(3)]
        keys.append([tuple(int(o[words].min()) for o in three) if len(words) else None for words in ids])
    seen: set[tuple] = set()
    out = np.ones(len(ids), bool)
    for i, words in enumerate(ids):
        own = [(k, key[i]) for k, key in enumerate(keys)] if len(words) else []
        out[i] = not seen.intersection(own)
        seen.update(own)
    return out


def cut(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """PLACE of the widest gap among thresholds with the least weight of errors."""
    order = np.argsort(scores, kind="stable")
    s, miss, alarm = scores[order], (weights * (labels == 1))[order], (weights * (labels == 0))[order]
    errors = np.concatenate([[0], np.cumsum(miss)]) + alarm.sum() - np.concatenate([[0], np.cumsum(alarm)])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    widths = np.where(errors <= errors.min() + 1e-9, np.diff(edges), -1)
    k = int(np.argmax(widths))
    return float(edges[k] + (edges[k + 1] - edges[k]) * PLACE)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Model | None:
    rows = sorted(sample(docs, labels, "toxic", per_class, seed).where("length(trim(text)) > 0").collect(), key=lambda r: r["id"])
    if len({r["label"] for r in rows}) < 2:
        return None
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows]), seed)


def scorer(spark: SparkSession, model: Model | None):
    """A column function: the toxicity score, above 0 for toxic; NULL without a model and for texts without words."""
    if model is None:
        return lambda text: F.lit(None).cast("double")
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def worst(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [held.value.score(texts.slice(k, 1000).to_pylist()) for k in range(0, len(texts), 1000)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64(), from_pandas=True)

    return worst


def toxic(score: Column) -> Column:
    return F.coalesce(score > 0, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score and toxic for every row of ``docs``; a document is as toxic as its worst sentence.

    The kernel of two words is the sum over all subsequences of three characters within a span of six, each skipped
    character costing a factor, so insults match with characters dropped, put in or set apart; punctuation is dropped,
    digits, accented letters and look-alikes read as the letters they stand for, and letters set apart by spaces are joined. The machine, with landmarks by Nyström, is
    trained on the sentences of at most ``per_class`` labelled documents of each class, a documented bound, and folded
    into a weight for each subsequence. Whole texts are scored in one pass without a shuffle. The kernel is taken
    of words and of each two and three adjacent words of a sentence, read without the spaces between them.

    Defined results: null, empty and blank texts score NULL and aren't toxic; null doc_id is kept; repeated rows score
    alike, as often as they occur; contradicting labels of one id are dropped, and of repeated ids in the documents the
    greatest text is learned. Without labelled documents of both classes every score is NULL and nothing is toxic. An
    empty table gives an empty table. Other columns are ignored.
    """
    worst = scorer(docs.sparkSession, train(docs, labels, per_class))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), worst(F.col("text")).alias("score"))
    return scored.withColumn("toxic", toxic(F.col("score")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns."""
    worst = scorer(docs.sparkSession, train(docs, labels))
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), worst(F.col("text")).alias("score"))
    return scored.where(~toxic(F.col("score"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
