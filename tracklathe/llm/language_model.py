"""Language-model scoring by deleted interpolation of word n-grams."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.llm._shared import checkpointed, table

#: Production parameters: words of the longest n-gram; one of HELD texts (by hash) is held out for the mixture weights;
#: rounds of expectation-maximisation, and the gain in bits a word at which they end.
ORDER = 3
HELD = 32
ROUNDS = 30
GAIN = 1e-4
#: Bytes of text whose distinct n-grams are asked for together; a longer text is a shard of its own.
SHARD = 4 << 20
#: Bytes of text split into words at once.
CHUNK = 1 << 20
#: Codes have this many bits more than the corpus has bytes, so under one n-gram in 2,000 shares its code with another.
SPARE = 10
BUCKETS = 64

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BEGIN, END = np.uint64(1), np.uint64(2)
#: 0 for white space and controls, 1 for parts of words, 2 for signs, each a word by itself.
KIND = np.full(256, 2, np.uint8)
KIND[:33], KIND[127], KIND[128:] = 0, 0, 1
KIND[ord("0") : ord("9") + 1] = KIND[ord("a") : ord("z") + 1] = 1
#: First bytes of characters, of three bytes each, that are words by themselves: kana, ideographs, syllables.
WIDE = (np.arange(256) >= 0xE3) & (np.arange(256) <= 0xED)

BODY = "shard long, ids array<long>, sizes array<long>, words binary, places binary"
REQUEST = "part long, shard long, held boolean, n1 long, n2 long, n3 long, codes binary, counts binary"
REPLY = "part long, shard long, total binary, train binary, mark long, distinct long, words long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@functools.cache
def coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair a process: messages are many and small, and a new pair costs more than most of them."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; planes of zeros take no room."""
    return coders()[0].compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(coders()[1].decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel().astype(np.uint64, copy=False)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


@functools.cache
def usual_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, n), powers(INVERSE, n)


def ranked(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``bits`` bits in order, and the places they came from, in order within a code.

    A plain sort of numbers that hold a code and, below it, its place is several times as fast as a stable sort of
    places. Where both have no room in 64 bits the code's last ones are left out, and seldom make a difference.
    """
    low = max(1, (len(code) - 1).bit_length())
    spare = max(0, bits + low - 64)
    both = np.sort(code >> np.uint64(spare) << np.uint64(low) | np.arange(len(code), dtype=np.uint64))
    order = (both & np.uint64((1 << low) - 1)).astype(np.int64)
    found = code[order] if spare else both >> np.uint64(low)
    if spare and (found[1:] < found[:-1]).any():
        order = np.argsort(code, kind="stable")
        found = code[order]
    return found, order


def pieces(row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end at white space."""
    at = 0
    while at < len(row):
        end = at + CHUNK
        while end < len(row):
            blank = np.flatnonzero(KIND[row[end : end + CHUNK]] == 0)
            end += int(blank[0]) if len(blank) else CHUNK
            if len(blank):
                break
        yield at, min(end, len(row))
        at = min(end, len(row))


def hashed(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word of a run of bytes, which holds whole words."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in pieces(row):
        b = row[lo:hi]
        kind, wide = KIND[b], WIDE[b]
        start = kind > 0
        start[1:] &= (kind[1:] == 2) | (kind[:-1] != 1) | wide[1:]
        start[3:] |= wide[:-3] & (kind[3:] == 1) & (b[3:] & 0xC0 != 0x80)
        first = np.flatnonzero(start)
        edge = start | (kind == 0)
        stops = np.append(np.flatnonzero(edge), len(b))
        last = stops[np.searchsorted(stops, first, "right")] if len(first) else first
        power, inverse = usual_powers(2 * CHUNK) if len(b) <= 2 * CHUNK else (powers(BASE, len(b)), powers(INVERSE, len(b)))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
        places.append(first + lo)
        hashes.append(mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
    return np.concatenate(places), np.concatenate(hashes)


class Shard:
    """Texts in a row: for each text that has words two marks of the beginning, its words, and a mark of the end."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, places: np.ndarray | slice):
        """sizes: words of each text; words: distinct hashes; places: of each word of all texts in ``words``, or a slice of it."""
        self.sizes = sizes
        full = np.flatnonzero(sizes > 0)
        length = sizes[full] + 3
        end = np.cumsum(length)
        row = np.full(int(length.sum()), BEGIN, np.uint64)
        row[end - 1] = END
        spot = np.repeat(end - length + 2, sizes[full]) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes[full]) - sizes[full], sizes[full])
        row[spot] = words[places]
        self.text = np.repeat(full, length)
        two = np.zeros(len(row), np.uint64)
        two[1:] = mixed(row[:-1] * np.uint64(3) + row[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        three = np.zeros(len(row), np.uint64)
        three[2:] = mixed(two[1:-1] * np.uint64(5) + row[2:] * np.uint64(0x165667B19E3779F9))
        place = np.arange(len(row)) - np.repeat(end - length, length)
        self.scored = np.flatnonzero(place >= 2)
        self.asked = np.flatnonzero(place >= 1)  # contexts too, the last of which is the second mark of the beginning
        self.grams = (row, two, three)

    def kinds(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams of k words: distinct codes in order, their counts, and for each place its code's place and count in its own text."""
        code, at, new, first = self.sorted(k, bits)
        text = self.text[at]
        fresh = new.copy()
        fresh[1:] |= text[1:] != text[:-1]
        run = np.flatnonzero(fresh)
        size = np.diff(np.append(run, len(code)))
        place, own = np.zeros(len(self.text), np.int64), np.zeros(len(self.text), np.int64)
        place[at] = np.cumsum(new) - 1
        own[at] = np.repeat(size, size)
        return code[first], np.diff(np.append(first, len(code))), place, own

    def counted(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The first two of kinds()."""
        code, _, _, first = self.sorted(k, bits)
        return code[first], np.diff(np.append(first, len(code)))

    def sorted(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes in order, their places in the row, whether a code is another than the one before, and where that is so."""
        at = self.scored if k == ORDER else self.asked
        code = mixed(self.grams[k - 1][at] + np.uint64(k)) >> np.uint64(64 - bits)
        code, order = ranked(code, bits)  # texts stay in order within a code
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        return code, at[order], new, np.flatnonzero(new)


def shown(docs: DataFrame) -> DataFrame:
    """doc_id, lower-cased text, and whether the text is held out."""
    held = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"), held.alias("held"))


def shards(batches: Iterator[pa.RecordBatch], sides: tuple[bool, ...] = (False, True), distinct: bool = True) -> Iterator[tuple[int, bool, list, np.ndarray, np.ndarray, np.ndarray | slice]]:
    """Shards of one partition, cut in the order of its rows: id, held, doc_ids, words of each text, distinct words and their places.

    Without ``distinct`` the words are given as they come, in place of distinct ones.

    A shard's texts are all held out or none is. An id tells the partition, the side and the shard's number.
    """
    task = TaskContext.get()
    home = task.partitionId() if task else 0
    parts: dict[bool, list] = {s: [] for s in sides}
    size, number = dict.fromkeys(sides, 0), dict.fromkeys(sides, 0)

    def close(side: bool):
        ids = [i for found, _, _ in parts[side] for i in found]
        sizes = np.concatenate([n for _, n, _ in parts[side]])
        words, places = np.concatenate([h for _, _, h in parts[side]]), slice(None)
        if distinct:
            words, places = np.unique(words, return_inverse=True)
        shard = (home << 24) + (number[side] << 1) + side
        parts[side], size[side], number[side] = [], 0, number[side] + 1
        return shard, side, ids, sizes, words, places

    for b in batches:
        held = np.asarray(b.column(2).to_pylist(), bool)
        for side in sides:
            rows = np.flatnonzero(held == side)
            texts = b.column(1).take(pa.array(rows)).cast(pa.large_binary())
            data = texts.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            ids = b.column(0).take(pa.array(rows)).to_pylist()
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(ends[i:] - ends[i], SHARD - size[side], "right")) + i - 1)
                lengths = np.diff(ends[i : j + 1])
                row = np.zeros(int(lengths.sum()) + j - i, np.uint8)  # a blank after each text
                starts = np.cumsum(lengths + 1) - lengths - 1
                for k in range(j - i):
                    row[starts[k] : starts[k] + lengths[k]] = data[ends[i + k] : ends[i + k + 1]]
                places, hashes = hashed(row)
                parts[side].append((ids[i:j], np.diff(np.append(np.searchsorted(places, starts), len(places))), hashes))
                size[side] += len(row)
                i = j
                if size[side] >= SHARD:
                    yield close(side)
    for side in sides:
        if parts[side]:
            yield close(side)


def batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in names.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def requests(bits: int, parts: int):
    """mapInArrow function: of each shard and part, the codes of its distinct n-grams by length, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(p << bits) // parts for p in range(parts + 1)], np.uint64)
        for number, held, _, *body in shards(batches, distinct=False):
            shard = Shard(*body)
            found = [shard.counted(k, bits) for k in range(1, ORDER + 1)]
            cuts = [np.searchsorted(code, edges) for code, _ in found]
            rows = []
            for p in range(parts):
                own = [(code[c[p] : c[p + 1]], n[c[p] : c[p + 1]]) for (code, n), c in zip(found, cuts)]
                sizes = [len(code) for code, _ in own]
                if sum(sizes):
                    steps = np.concatenate([np.diff(code, prepend=edges[p]) for code, _ in own])
                    rows.append((p, number, held, *sizes, packed(steps), packed(np.concatenate([n for _, n in own]))))
            if rows:
                yield batch(rows, REQUEST)

    return run


def answers(bits: int, parts: int):
    """applyInArrow function: to each shard's request the counts of its n-grams in all texts, and, if it is held out, in the others.

    Where codes of all shards are added up, the part also tells how many distinct words it has and how many words in all.
    """

    def run(asked: pa.Table) -> pa.Table:
        edges = np.array([(int(asked["part"][0].as_py()) << bits) // parts], np.uint64)
        width = ((1 << bits) // parts + 1).bit_length()
        shard, held = asked["shard"].to_numpy(), asked["held"].to_numpy()
        sizes = np.stack([asked[f"n{k}"].to_numpy() for k in range(1, ORDER + 1)], 1)
        steps, counts = ([unpacked(x.as_py()) for x in asked[c]] for c in ("codes", "counts"))
        total, train = [[] for _ in shard], [[] for _ in shard]
        distinct = words = 0
        for k in range(ORDER):
            lo, hi = sizes[:, :k].sum(1), sizes[:, : k + 1].sum(1)
            code = np.concatenate([np.cumsum(s[a:b]) for s, a, b in zip(steps, lo, hi)])
            n = np.concatenate([c[a:b] for c, a, b in zip(counts, lo, hi)]).astype(np.int64)
            code, order = ranked(code, width)
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            known, place = code[new] + edges, np.empty(len(code), np.int64)
            place[order] = np.cumsum(new) - 1
            whole = np.bincount(place, n, len(known)).astype(np.int64)
            out = np.bincount(place, n * np.repeat(held, hi - lo), len(known)).astype(np.int64)
            if k == 0:
                mark = mixed(np.array([BEGIN + np.uint64(1)])) >> np.uint64(64 - bits)
                distinct, words = int((known != mark).sum()), int(whole[known != mark].sum())
            ends = np.cumsum(hi - lo)
            for i, (a, b) in enumerate(zip(ends - (hi - lo), ends)):
                total[i].append(whole[place[a:b]])
                if held[i]:
                    train[i].append((whole - out)[place[a:b]])
        # the part's own figures go with its first shard
        rows = [(asked["part"][0].as_py(), int(s), packed(np.concatenate(t)), packed(np.concatenate(u)) if u else None, int(np.sum(c)), distinct * (i == 0), words * (i == 0)) for i, (s, t, u, c) in enumerate(zip(shard, total, train, steps))]
        return pa.Table.from_batches([batch(rows, REPLY)])

    return run


def bodies(sides: tuple[bool, ...]):
    """mapInArrow function: a row for each shard, its texts as places in the list of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, ids, sizes, words, places in shards(batches, sides):
            yield batch([(number, ids, sizes.tolist(), packed(np.diff(words, prepend=np.uint64(0))), packed(places))], BODY)

    return run


def estimated(body: pa.Table, replies: pa.Table, bits: int, parts: int, words: int, distinct: int, train: bool) -> tuple[pa.Array, Shard, np.ndarray, np.ndarray]:
    """doc_ids, the shard, and for each word scored its bucket and its maximum-likelihood estimates p0 .. pORDER.

    Counts are those of all other texts: a text's own are taken off; with ``train``, those of the texts held out too. A
    bucket is the number of words of the longest context seen, and the binary logarithm of its count.
    """
    ids = body["ids"].combine_chunks().flatten() if body.num_rows else pa.array([], pa.int64())
    shard = Shard(np.array(body["sizes"][0].as_py(), np.int64), np.cumsum(unpacked(body["words"][0].as_py())), unpacked(body["places"][0].as_py()).astype(np.int64))
    edges = np.array([(p << bits) // parts for p in range(parts + 1)], np.uint64)
    found = [shard.kinds(k, bits) for k in range(1, ORDER + 1)]
    cuts = [np.searchsorted(code, edges) for code, *_ in found]
    counts = [np.zeros(len(code), np.int64) for code, *_ in found]
    seen = 0
    for p, data, mark in zip(replies["part"].to_pylist(), replies["train" if train else "total"].to_pylist(), replies["mark"].to_pylist()):
        told, at = unpacked(data).astype(np.int64), 0
        steps = 0
        for (code, *_), c, n in zip(found, cuts, counts):
            size = int(c[p + 1] - c[p])
            n[c[p] : c[p + 1]] = told[at : at + size]
            steps += int(code[c[p + 1] - 1] - edges[p]) if size else 0
            at += size
        if at != len(told) or steps != mark:
            raise ValueError("the rows of a partition came in another order than before; checkpoint the table first")
        seen += at
    if seen != sum(len(n) for n in counts):
        raise ValueError("the rows of a partition came in another order than before; checkpoint the table first")
    have = [n[place] - (0 if train else own) for (_, _, place, own), n in zip(found, counts)]  # of the n-gram that ends at each place
    at = shard.scored
    length = np.repeat(shard.sizes[shard.sizes > 0] + 1, shard.sizes[shard.sizes > 0] + 1) if len(at) else np.zeros(0)
    contexts = [words - (0 if train else length), have[0][at - 1], have[1][at - 1]]
    p = np.empty((ORDER + 1, len(at)))
    p[0] = 1 / (distinct + 1)
    bucket = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        c = np.asarray(contexts[k], np.float64) * np.ones(len(at))
        p[k + 1] = np.where(c > 0, have[k][at] / np.maximum(c, 1), 0.0)
        bucket = np.where(c > 0, BUCKETS * (k + 1) + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), bucket)
    return ids, shard, bucket, p


def learn(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by bucket: expectation-maximisation on the words held out, one aggregation a round.

    A bucket without words held out keeps equal weights for the estimates of its length of context and shorter ones.
    """
    spark, n = rows.sparkSession, ORDER + 1
    weights = np.array([[1 / (b // BUCKETS + 1) if k <= b // BUCKETS else 0.0 for k in range(n)] for b in range(BUCKETS * n)])
    before = -math.inf
    used = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    for _ in range(rounds if used else 0):
        now = spark.createDataFrame([(b, *map(float, weights[b])) for b in used], "bucket int, " + ", ".join(f"w{k} double" for k in range(n)))
        p = sum((F.col(f"w{k}") * F.col(f"p{k}") for k in range(n)), F.lit(0.0))
        mix = rows.join(F.broadcast(now), "bucket").withColumn("p", p)  # a row for each bucket: some hundred at most
        parts = [F.sum(F.col(f"w{k}") * F.col(f"p{k}") / F.col("p")).alias(f"e{k}") for k in range(n)]
        found = mix.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.log2("p")).alias("bits"), *parts).collect()
        for r in found:
            weights[r["bucket"]] = [r[f"e{k}"] / r["n"] for k in range(n)]
        bits = sum(r["bits"] for r in found) / sum(r["n"] for r in found)
        if bits - before < GAIN:
            break
        before = bits
    return weights


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows come from files or memory, in the same order every time; else a checkpoint of it."""
    plan = docs.select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    return checkpointed(docs.select("doc_id", "text")) if "Exchange" in plan else docs


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, bits (mean negative log2 probability of a word or the end) and perplexity (2 ** bits) for every row.

    The model is of words given up to two before, with marks where a text begins and ends. Words are runs of letters and
    digits of the lower-cased text; other signs, and kana, ideographs and syllables, are words by themselves. Counts are
    of every n-gram of every whole text, with the whole vocabulary: what is gathered grows with the corpus. Estimates of
    all lengths of context are mixed with weights by bucket of context frequency, learned from one text in HELD, held
    out of the counts for that. Every text is then scored by the counts of all other texts, those held out among them:
    its own are taken off, so no text is judged by itself, and one that occurs twice is foreseen by its copy.

    A shard of some megabytes of text asks for its distinct n-grams by packed codes, sent to parts by range of code; a
    part adds up the counts of all shards and sends them back; the shard's words, packed, meet the answers. Neither the
    model nor a document's words are ever rows of their own, nothing is broadcast, a frequent n-gram costs each shard one
    code, and the plan is one for all sizes. Codes are hashes; SPARE says how many n-grams share one.

    Defined results: null, empty and blank texts score NULL with n_words 0; null doc_id is kept; repeated rows score
    alike, as often as they occur, each with the others among the other texts. If no text is held out, buckets keep equal
    weights. An empty table gives an empty table. Other columns are ignored.
    """
    docs = shown(settled(docs))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(62, max(32, size.bit_length() + SPARE))
    parts = math.isqrt(size // 8192) + 1  # as many as shards, about; both grow with the root or in proportion
    asked = docs.mapInArrow(requests(bits, parts), REQUEST)
    told = checkpointed(asked.groupBy("part").applyInArrow(answers(bits, parts), REPLY))
    words, distinct = told.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    told = told.drop("words", "distinct")

    def held_out(body: pa.Table, replies: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), **{f"p{k}": pa.array([], pa.float64()) for k in range(ORDER + 1)}})
        if not body.num_rows:
            return none
        _, _, bucket, p = estimated(body, replies, bits, parts, words - kept_out, distinct, True)
        return pa.table({"bucket": pa.array(bucket.astype(np.int32)), **{f"p{k}": pa.array(p[k]) for k in range(ORDER + 1)}})

    aside = docs.mapInArrow(bodies((True,)), BODY)
    kept_out = aside.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x + F.when(x > 0, 1).otherwise(0)).alias("n")).agg(F.sum("n")).first()[0] or 0
    both = aside.groupBy("shard").cogroup(told.where("train IS NOT NULL").groupBy("shard"))
    weights = learn(checkpointed(both.applyInArrow(held_out, "bucket int, " + ", ".join(f"p{k} double" for k in range(ORDER + 1)))))

    def scored(body: pa.Table, replies: pa.Table) -> pa.Table:
        if not body.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "bits": pa.array([], pa.float64())})
        ids, shard, bucket, p = estimated(body, replies, bits, parts, words, distinct, False)
        logs = -np.log2(np.einsum("kn,nk->n", p, weights[bucket]))
        total = np.bincount(shard.text[shard.scored], logs, len(shard.sizes))
        mean = np.where(shard.sizes > 0, total / (shard.sizes + 1), np.nan)
        return pa.table({"doc_id": ids, "n_words": pa.array(shard.sizes), "bits": pa.array(mean, from_pandas=True)})

    every = docs.mapInArrow(bodies((False, True)), BODY)
    out = every.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(scored, "doc_id long, n_words long, bits double")
    return out.withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
