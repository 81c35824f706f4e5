"""Order-preserving packing by dynamic programming over cut points.

Documents are tokenised in scan order into one stream per chunk of a partition. A window may end at
a document's end, at a sentence's end (a small penalty) or, inside long sentences, at every
``HARD_STEP``-th token (a larger penalty). The cost of a window is its padding plus its end's penalty
plus a constant; its length is at most ``LENGTH`` and it is padded to that, or not at all at a power
of two. The least cost up to a cut is the minimum over the cuts at most ``LENGTH`` tokens before, kept
in a monotone queue, and over the few cuts a power of two before.

Chunks are independent, so a task holds one chunk of text, and losing an executor repeats only its
partitions; sequence ids join the partition's number and a count in it, and are the same after that.

Edge cases: null or empty text is the end token alone; ties take the earliest cut; repeated rows are
packed again; a null doc_id is packed and stays null; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import chunks

LENGTH = 2048
END = 1
SENTENCE_PENALTY, HARD_PENALTY, WINDOW_COST = 4, 24, 8
HARD_STEP = 64
CHUNK_BYTES = 4 << 20
#: Words whose ids a worker remembers, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 150_000, 48
_CODERS: dict[str, Coder] = {}


class _NoWord(Exception):
    """A blank that doesn't begin a word: white space or the end follows. Python's white space holds all that the tokenizer's does."""


class _Words(dict):
    """A word to the ids of a blank and that word, as little-endian bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _NoWord
        out = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class Coder:
    """Ids of a byte-level BPE tokenizer file, the same as its library's, faster for texts of words.

    A blank before a character that isn't white space begins a piece, so a text in which every blank
    stands so is the ids of its words, each with its blank. Other texts, with a blank before white space of
    any kind or at the end, are encoded whole; those with a special
    token's string, and all where the file isn't plain byte-level BPE, by the library itself, which
    is loaded for the first of them only: a worker holds one coder.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        self.sentence = np.zeros(max([END, *vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1, bool)
        for token, i in vocab.items():
            self.sentence[i] = token.endswith((".", "!", "?", "Ċ"))  # the last is how byte-level vocabularies write a line break
        pre = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if self.plain:
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(c): c for c in shown} | {chr(256 + n): c for n, c in enumerate(x for x in range(256) if x not in set(shown))}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            # the byte-level library's split, with possessive runs so that long ones aren't tried twice
            split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
            self.whole = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.words = _Words(self.whole)

    def forget(self) -> None:
        """Drops the remembered words, so that a worker keeps them for a task only."""
        if self.plain:
            self.words.clear()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.plain or any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " not in text:
            first, *rest = text.split(" ")
            try:
                return np.array(self.whole(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))
            except _NoWord:
                pass
        return np.array(self.whole(text), "<u4").tobytes()


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end and their penalties; the first is 0, the last the stream's end."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[1:][sentence[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    for k in np.flatnonzero(gaps > step):
        penalty[at[k] + step : at[k + 1] : step] = HARD_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """The window ends of least cost; at starts with 0."""
    best, back = [0], [0]
    place = {0: 0}
    queue = deque([(0, 0)])  # (best + at, index), ascending in the first
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1)]
    first = 0
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        cost, i = queue[0]
        cost += length - here
        for p in powers:
            k = place.get(here - p)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += penalty[j] + WINDOW_COST
        best.append(cost)
        back.append(i)
        place[here] = j
        while at[first] < here - length:
            del place[at[first]]
            first += 1
        value = cost + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def pack_chunk(texts: list[str], path: str) -> list[tuple[int, int, int, int, int, int, int]]:
    """(document, start, length, crc32, doc_tokens, window, offset) of each piece, in order."""
    c = coder(path)
    parts = [c.encode(t) + END.to_bytes(4, "little") for t in texts]
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = np.cumsum([len(p) // 4 for p in parts])
    at, penalty = cut_points(ids, ends, c.sentence)
    out, doc, lo = [], 0, 0
    begins = [0, *ends.tolist()]
    for window, hi in enumerate(best_cuts(at.tolist(), penalty.tolist())):
        begin = lo
        while lo < hi:
            to = min(hi, begins[doc + 1])
            out.append((doc, lo - begins[doc], to - lo, zlib.crc32(ids[lo:to].tobytes()), begins[doc + 1] - begins[doc], window, lo - begin))
            lo = to
            doc += lo == begins[doc + 1]
    return out


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for chunk in chunks(batches, "text", chunk_bytes):
            pieces = pack_chunk(chunk.column("text").to_pylist(), tokenizer_path)
            doc, start, length, crc, tokens, window, offset = map(np.array, zip(*pieces, strict=True))
            keys = chunk.column("key").combine_chunks().take(pa.array(doc))
            columns = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens, window + sequence, offset)]
            sequence += int(window[-1]) + 1
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        coder(tokenizer_path).forget()

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("key", key)
