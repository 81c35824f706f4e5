"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Normalisation lower-cases A-Z and takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; it works on UTF-8
bytes by a length-preserving table, so offsets map straight back to the text. A window is WINDOW
consecutive item words; an item of fewer words is one window. The automaton holds each item cut into
blocks of BLOCK words, framed by blanks: a window contains a whole block, so a document's words are read
once, and where a block occurs the words around it are compared with the item's, up to the windows that
contain the block. So the automaton has about one node for each byte of the benchmark, not one for
each byte of each window.

The automaton goes to the executors, so the benchmark is measured first: up to ``MAX_BENCHMARK_BYTES``
make one automaton (some 100 bytes of memory each); items of more are dealt by hash into several, each
scanned alone, and their hits merged by row.

Edge cases: null or empty text has no words, no hits and isn't contaminated; null or wordless items
and items with a null id are no windows; items that share a window are all reported; a repeated
item_id counts once; an empty benchmark contaminates nothing; every row has its own result, also
where keys repeat or are null; very long texts are read whole, one at a time; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import built, checkpointed, text_bytes

WINDOW = 13
#: The most words for which each window holds a whole block.
BLOCK = (WINDOW + 1) // 2
MAX_BENCHMARK_BYTES = 2 << 20
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Maps each byte to itself in a word (A-Z to a-z) and to a blank elsewhere.
TABLE = bytes(c if c in _WORD or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_AT = re.compile(rb"[^ ]+")


class Benchmark:
    """Items (id, words) and the automaton of their blocks; a block's value is the places (item, word) where it stands."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items = [(k, tuple(t.translate(TABLE).split())) for k, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(self.items):
            n = BLOCK if len(words) >= WINDOW else len(words)
            for at in range(0, len(words) - n + 1, n) if n else ():
                places.setdefault(f" {b' '.join(words[at : at + n]).decode('latin-1')} ", []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for k, v in places.items():
            self.automaton.add_word(k, (k.count(" ") - 1, tuple(v)))
        self.automaton.make_automaton()

    def run(self, words: list[bytes], p: int, n: int, item: int, at: int) -> tuple[int, int] | None:
        """The run of document words in windows that hold the block of n words at p, which is the item's at ``at``; none if too few words around it agree."""
        other = self.items[item][1]
        if len(other) < WINDOW:
            return p, p + n
        lo, most = 0, min(p, at, WINDOW - n)
        while lo < most and words[p - lo - 1] == other[at - lo - 1]:
            lo += 1
        hi, most = n, min(len(words) - p, len(other) - at, WINDOW)
        while hi < most and words[p + hi] == other[at + hi]:
            hi += 1
        return (p - lo, p + hi) if lo + hi >= WINDOW else None


def code_points(text: bytes, places: list[int]) -> list[int]:
    """The numbers of code points before ascending byte places."""
    out, at, n = [], 0, 0
    for p in places:
        n += len(text[at:p].decode("utf-8", "replace"))
        at = p
        out.append(n)
    return out


def scan(bench: Benchmark, text: bytes) -> tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]:
    """Number of words, hit runs in word numbers, items, and the same runs as code point spans of the text."""
    flat = text.translate(TABLE)
    words = flat.split()
    if not words or not len(bench.automaton):
        return len(words), [], set(), []
    blocks = list(bench.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not blocks:
        return len(words), [], set(), []
    ends: dict[int, int] = {}
    at = 0
    for i, w in enumerate(words):
        at += len(w) + 1
        ends[at] = i + 1  # place of the blank after word i
    hits, items = set(), set()
    for end, (n, places) in blocks:
        for item, at in places:
            if run := bench.run(words, ends[end] - n, n, item, at):
                hits.add(run)
                items.add(bench.items[item][0])
    runs: list[list[int]] = []
    for lo, hi in sorted(hits):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    where = [m.span() for m in _AT.finditer(flat)] if runs else []
    chars = code_points(text, [p for lo, hi in runs for p in (where[lo][0], where[hi - 1][1])])
    return len(words), [(lo, hi) for lo, hi in runs], items, list(zip(chars[::2], chars[1::2], strict=True))


def _scanner(items):
    token = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = built(token, lambda: Benchmark(items.value))
        pair = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            got = [scan(bench, t) for t in text_bytes(b.column(1))]
            pairs = lambda k, got=got: pa.array([[{"lo": x, "hi": y} for x, y in g[k]] for g in got], pair)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pairs(1), pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())), pairs(3)], ["key", "n_words", "runs", "items", "spans"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """Per row of docs: key, n_words, n_hit, items (sorted as strings), spans (lo, hi code points of hit runs), contaminated."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // max_bytes))
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    if blocks > 1:  # rows get numbers that stay: each is scanned several times
        texts, kind = checkpointed(texts.select(F.struct(F.monotonically_increasing_id().alias("row"), "key").alias("key"), "text")), f"struct<row:bigint,key:{kind}>"
    schema = f"key {kind}, n_words bigint, runs array<struct<lo:bigint,hi:bigint>>, items array<string>, spans array<struct<lo:bigint,hi:bigint>>"
    parts = []
    for n in range(blocks):
        some = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n)
        held = spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in some.collect()])
        parts.append(texts.mapInArrow(_scanner(held), schema))
    out = parts[0]
    if blocks > 1:
        lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("runs", "items", "spans")]
        out = reduce(DataFrame.unionByName, parts).groupBy("key.row").agg(F.first("key.key").alias("key"), F.max("n_words").alias("n_words"), *lists)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    n_hit = F.aggregate("runs", start, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(r["lo"], a["to"]))).alias("n"), F.greatest(a["to"], r["hi"]).alias("to")))["n"]
    out = out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), "items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def pipeline_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated."""
    bad = decontaminate(docs, benchmark).filter("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, list[str]]]:
    """doc_id to (n_words, n_hit, items) by comparing every window with every place; for tests."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(WINDOW, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            sets[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in sets}:
            for k in range(len(w) - n + 1):
                if ids := sets.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found))
    return out
