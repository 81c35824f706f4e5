"""MinHash near-duplicate detection with odd sketches.

A document's set holds its distinct word shingles as 64-bit hashes. MinHash samples are banded for
candidates and folded into a parity bitmap, the odd sketch: the population count of the XOR of two
bitmaps estimates their similarity, most precisely where it is high. Equal sets are one class.

Candidates: classes that share a band are joined to the band's least key, and the components of
these edges are candidate groups; a link that shares a band lies within one group. With 48 bands of
6 rows a pair at similarity 0.8 shares none with probability 5e-7.

Links: a group whose sets fit a task is solved there: pairs not yet connected are compared by odd
sketch, and if the estimate is within ``SLACK`` of the threshold, on full sets. Of a larger group, all
members are first compared with one pivot, on full sets. Jaccard distance is a metric, so members
linked to the pivot can link to others only where the triangle inequality allows it, and the rest
leave. Pivots go on while they take a tenth of what is left; after ``ROUNDS`` that don't, what is left
is solved in pairs of blocks. So no link is dropped for size, and no task holds more than
``GROUP_SHINGLES`` shingles (or one document), where a document counts for at least
``DOC_SHINGLES``: that bounds the pairs of short documents as well.

A band, or a node of a component, that many documents share is a hot key: its rows are spread over tasks.

Edge cases: a text without words is linked with nothing; one of fewer words than a shingle has one
shingle, its whole sequence; a very long text is one set, held whole by a task; of equal sets the least
key stands for all; a null key has no component and is kept; equal keys share a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpointed, spread_join, text_bytes
from gridloom.llm.graph import components

BANDS, ROWS = 48, 6
SKETCH_WORDS = 8  # of 64 bits
SLACK = 0.2
GROUP_SHINGLES = 4_000_000
DOC_SHINGLES = 200
ROUNDS = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, _K, np.uint32) | np.uint32(1)).astype(np.uint32)
_XOR = _RNG.integers(0, 1 << 32, _K, np.uint32)
_SALT = _RNG.integers(0, 1 << 63, _K, np.uint64)


class WordHashes(dict):
    """Words to their hashes; one for each task, so that a worker holds none between tasks."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(_K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, ((x[i : i + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples."""
    bits = mix(least.astype(np.uint64) ^ _SALT) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    out = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of a sketch with each row of b."""
    n = 64.0 * SKETCH_WORDS
    odd = np.bitwise_count(a ^ b).sum(axis=-1)
    share = np.maximum(1 - 2 * odd / n, 1e-9)
    return 1 + n / 2 * np.log(share) / (2 * _K)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def solve(sets: list[np.ndarray], percent: int, other: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect, as (lower, higher) places; with other, links within one side of that place are left out."""
    n = len(sets)
    sketches = np.array([odd_sketch(minhashes(s)) for s in sets]) if n > 2 else None
    sizes = np.array([len(s) for s in sets])
    root = np.arange(n)
    out = []
    for i in range(n if other is None else other):
        rest = np.arange(i + 1 if other is None else other, n)
        rest = rest[root[rest] != root[i]]
        if sketches is not None and len(rest):
            lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[100 * lo >= percent * hi]
            rest = rest[estimate(sketches[i], sketches[rest]) >= percent / 100 - SLACK]
        for j in rest.tolist():
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def signatures(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(key, n, cls, bands): the set's size, a hash of the set and its band keys; both null without words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, cls, bands = [], [], []
            for t in text_bytes(b.column(1)):
                s = shingles(t, size, hashes)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(minhashes(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["key", "n", "cls", "bands"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n bigint, cls binary, bands array<bigint>")


def stars(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(least place of its component, place) of each linked place that isn't the least."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return [(top(i), i) for i in range(n) if top(i) != i]


def _solver(size: int, percent: int):
    """Streams rows (g, side, key, text) sorted by g and yields each group's links as (u, v): of a whole group, each linked key with the least of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sides, sets, kind, hashes = None, [], [], [], None, WordHashes()

        def links() -> list[tuple]:
            order = sorted(range(len(keys)), key=lambda i: (sides[i], keys[i]))
            two = sides[order[0]] != sides[order[-1]] if order else False
            found = solve([sets[i] for i in order], percent, sides.count(0) if two else None)
            found = found if two else stars(len(order), found)
            return [(keys[order[i]], keys[order[j]]) for i, j in found]

        for b in batches:
            out, kind = [], b.schema.field(2).type
            for g, side, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    out += links()
                    group, keys, sides, sets = g, [], [], []
                keys.append(key)
                sides.append(side)
                sets.append(shingles((text or "").encode(), size, hashes))
            yield _links(out, kind)
        if kind is not None:
            yield _links(links(), kind)

    return run


def _links(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in range(2)], ["u", "v"])


def _solved(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of groups; rows: g, side, key, text."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.repartition("g").sortWithinPartitions("g").select("g", "side", "key", "text").mapInArrow(_solver(size, percent), f"u {kind}, v {kind}")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """rows (g, key, text) with the text replaced by s, its shingle hashes."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, size, hashes).view(np.int64) for t in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["g", "key", "s"])

    return rows.select("g", "key", "text").mapInArrow(run, f"g {kind}, key {kind}, s array<bigint>")


def _pivot_round(members: DataFrame, sets: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Links of each group's pivot, and the members that may have further links; members: g, key, root, n."""
    t = percent / 100
    pick = members.groupBy("g").agg(F.min(F.struct(F.col("root").isNotNull().alias("linked"), "key")).getField("key").alias("key"), F.ceil(F.sum("n") / most).cast("int").alias("salts"))
    pivots = pick.join(sets.select("key", "s"), "key").select("g", F.col("key").alias("p"), F.col("s").alias("ps"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt"), "salts")
    dealt = members.join(pick.select("g", "salts"), "g").join(sets.select("key", "s"), "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts") + 1).cast("int"))
    both = F.size(F.array_intersect("s", "ps"))
    near = dealt.join(pivots.drop("salts"), ["g", "salt"]).filter("key <> p").withColumn("both", both)
    near = checkpointed(near.select("g", "key", "root", "n", "p", (F.col("both") / (F.size("s") + F.size("ps") - F.col("both"))).alias("j"), (100 * F.col("both") >= percent * (F.size("s") + F.size("ps") - F.col("both"))).alias("linked")))
    links = near.filter("linked").select(F.least("p", "key").alias("u"), F.greatest("p", "key").alias("v"))
    # with distance 1 - j, a link x-z needs d(x) - d(z) <= 1 - t
    open_ = near.filter(~F.col("linked") & (F.col("j") >= 1 - 2 * (1 - t) - 1e-9)).groupBy("g").agg(F.max("j").alias("top"))
    left = near.join(open_, "g", "left").filter(~F.col("linked") | (F.col("j") <= F.col("top") + (1 - t) + 1e-9))
    left = left.select("g", "key", F.when(F.col("linked"), F.coalesce("root", "p")).otherwise(F.col("root")).alias("root"), "n")
    # a group all linked to one root is finished
    alive = left.groupBy("g").agg(F.count_distinct("root").alias("roots"), F.count(F.when(F.col("root").isNull(), 1)).alias("free")).filter("roots > 1 OR free > 0")
    return links, checkpointed(left.join(alive.select("g"), "g", "left_semi"))


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """Members dealt into pairs of blocks: (g, a, b, side, key); two blocks together hold about ``most`` shingles."""
    sized = members.join(members.groupBy("g").agg(F.ceil(2 * F.sum("n") / most).cast("int").alias("m")), "g")
    block = sized.withColumn("k", F.pmod(F.xxhash64("key", F.lit(3)), F.col("m")).cast("int"))
    pairs = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return pairs.select("g", F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"), F.when(F.col("k") <= F.col("o"), 0).otherwise(1).alias("side"), "key")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", most: int = GROUP_SHINGLES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least key reachable by links), kept."""
    sig = checkpointed(signatures(docs, size, text, key))
    classes = sig.filter("cls IS NOT NULL AND key IS NOT NULL").groupBy("cls").agg(F.min("key").alias("rep"))
    reps = sig.join(classes.select("cls", F.col("rep").alias("key")), ["cls", "key"], "left_semi").select("key", "n", "bands").dropDuplicates(["key"])
    banded = reps.select("key", F.explode("bands").alias("band"))
    hubs = checkpointed(banded.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    edges = spread_join(banded, hubs, ["band"], "m", "key", BANDS * sig.count())
    groups = components(edges.filter("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")))
    weight = F.greatest("n", F.lit(DOC_SHINGLES)).alias("n")
    groups = checkpointed(groups.select(F.col("component").alias("g"), F.col("node").alias("key")).join(reps.select("key", weight), "key"))
    large = groups.groupBy("g").agg(F.sum("n").alias("total")).filter(F.col("total") > most).select("g")
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    small = groups.join(large, "g", "left_anti")
    found = _solved(small.join(texts, "key").select("g", F.lit(0).alias("side"), "key", "text"), size, percent).select(F.col("v").alias("node"), F.col("u").alias("component"))
    members = checkpointed(groups.join(large, "g", "left_semi").select("g", "key", F.lit(None).cast(sig.schema["key"].dataType).alias("root"), "n"))
    if not members.isEmpty():
        sets = checkpointed(_sets(members.join(texts, "key").select("g", "key", "text"), size))
        links, left, idle = [], None, 0
        while idle < rounds:
            some, members = _pivot_round(members, sets, percent, most)
            links.append(some)
            now = members.agg(F.sum("n")).first()[0] or 0
            if not now:
                break
            idle = 0 if left and now <= 0.9 * left else idle + 1
            left = now
        dealt = _blocks(members, most).withColumn("g", F.xxhash64("g", "a", "b"))
        links.append(_solved(dealt.join(texts, "key").select("g", "side", "key", "text"), size, percent))
        found = found.union(components(reduce(DataFrame.union, links)))
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("c"))
    out = sig.select("key", "n", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("c", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def pipeline_stage(docs: DataFrame) -> DataFrame:
    """The document of least key of each group of near duplicates."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]], size: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """key to (set size, component) by comparing all pairs; for tests."""
    import re

    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(size, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((top(a), top(b)))
                root[v] = u
    return {k: (len(sets[k]), top(k)) for k in keys}
