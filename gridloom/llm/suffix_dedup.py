"""Exact substring dedup by merged Burrows-Wheeler transforms.

Every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus goes.

1. Segments. A text's windows of LENGTH bytes are cut into runs of one minimizer, the least hash of
   the 16-byte strings in a window. Equal windows have equal minimizers, so all repeats of a window
   lie in the segments of one minimizer. Equal segments are one class; within a chunk of a task all
   but the first go at once, which pre-aggregates copies and hot passages before the shuffle.
2. Classes. Segments are dealt by minimizer and streamed in order: all but the first of a class are
   repeats as a whole. A minimizer with one class, whose minimum occurs once in it, has no others.
3. Transforms. The first segments of the other minimizers get their bytes, and jobs of some KB of whole
   minimizers are solved: each shard of a job is sorted once into its Burrows-Wheeler transform, and
   the shards are merged by refining their interleave, two symbols a round: stably ordering rows by the
   symbols before them turns the order by t symbols into that by t + 2, and where rows part, their
   common prefix is known to two symbols. Rows alone in their interval leave the refinement. The intervals that are
   left after LENGTH rounds are the repeated strings.
4. The removed spans are merged per document and cut from its bytes.

A minimizer whose classes exceed HOT_BYTES is split again by three more minimizers with other seeds, and
what still exceeds it into single windows, dealt by a hash of their bytes; of equal single windows only
the earliest waits in a task. So no job holds more than HOT_BYTES and one job's worth of segments.

Edge cases: null text is empty; texts under LENGTH bytes and empty ones lose nothing; a very long text
is cut into pieces of CHUNK_BYTES that overlap by LENGTH - 1 bytes, so that each window lies in one;
keys are integers (others raise an error); rows that share a key are at the same places, so they remove
nothing of each other and share their spans; null keys keep all bytes and remove nothing; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridloom.llm._common import checkpointed, chunks, text_bytes

LENGTH = 100
KMER = 24
CHUNK_BYTES = 3 << 20
#: Small enough that a job's tables stay in a core's cache.
JOB_BYTES = 64 << 10
SHARD_BYTES = 16 << 10
#: Rows alone in their interval leave the refinement after each so many rounds.
LEAVE_EVERY = 4
#: Bytes of one minimizer's segments beyond which it is split; solving them takes some 50 times as much memory.
HOT_BYTES = 4 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def kmer_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the KMER bytes from each place, from the eight-byte words that they hold."""
    x = data.astype(_U)
    for width, bits in ((1, 8), (2, 16), (4, 32)):
        x = x[:-width] | (x[width:] << _U(bits))
    n = len(x) - KMER + 8
    out = _mix(x[:n] + _U(seed))
    for at in range(8, KMER, 8):
        out = _mix(out * _U(3) + x[at : at + n])
    return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each ``width`` places in a row."""
    done = 1
    out = x
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base to each power, by squaring."""
    out = np.ones(len(n), _U)
    for bit in range(int(n.max(initial=0)).bit_length()):
        out[(n >> bit & 1) == 1] *= _U(base)
        base = base * base & 0xFFFFFFFFFFFFFFFF
    return out


def segments(data: np.ndarray, bounds: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(minimizer, class hash, place, windows, self) of each segment of texts laid end to end; bounds: their starts, and the end.

    self: the minimum occurs twice, so the segment may repeat itself.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(_U), none.astype(_U), none, none, none.astype(bool)
    h = kmer_hashes(data, seed)
    width = LENGTH - KMER + 1
    least = sliding(h, width, np.minimum)  # of each window
    valid = np.ones(len(least) + 1, bool)
    for b in bounds[1:-1].tolist() + [len(data)]:
        valid[max(0, b - LENGTH + 1) : b] = False
    valid = valid[: len(least)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    new[np.asarray(bounds[:-1])[np.asarray(bounds[:-1]) < len(new)]] &= True
    start = np.flatnonzero(new)
    if not len(start):
        return none.astype(_U), none.astype(_U), none, none, none.astype(bool)
    # a run ends before the next start or where windows stop being valid
    runs = np.add.reduceat(valid.astype(np.int64), start)
    power = np.full(len(h), _BASE, _U)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * power, out=total[1:])
    del power
    value = least[start]
    cls = _mix((total[start + runs + width - 1] - total[start]) * _powers(_BASE_INVERSE, start) + runs.astype(_U))
    del total
    # places of minima: those equal to the greatest of the window minima around them
    least[~valid] = 0
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)])
    del least
    minima = np.flatnonzero(sliding(padded, width, np.maximum) == h)
    del padded
    lo, hi = np.searchsorted(minima, start), np.searchsorted(minima, start + runs + width - 1)
    of = np.repeat(np.arange(len(start)), hi - lo)
    at = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    twice = np.bincount(of, weights=h[minima[at]] == value[of], minlength=len(start)) > 1
    return value, cls, start, runs, twice


def transform(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform (as a ring) of symbols 0..256, by prefix doubling from 7 packed symbols."""
    n = len(s)
    x = np.zeros(n, np.int64)
    ext = np.concatenate([s.astype(np.int64), np.zeros(7, np.int64)])
    for i in range(7):
        x = (x << 9) | ext[i : n + i]
    width = 7
    while True:
        order = np.argsort(x)  # equal keys share a rank, in any order
        y = x[order]
        step = np.concatenate([[0], np.cumsum(y[1:] != y[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or width >= n:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        x = rank * (n + 1) + after
        width *= 2
    return order, s[order - 1]


def _coded(shards: list[np.ndarray]) -> list[np.ndarray]:
    """The shards' symbols numbered in order, from 1, with 0 for the separator, as bytes where 255 numbers do."""
    there = np.zeros(1 << 16, bool)
    for s in shards:
        there[s] = True
    there[0] = False
    code = np.cumsum(there)
    code[~there] = 0
    return [code.astype(np.uint8 if code[-1] < 256 and there.sum() < 256 else np.uint16)[s] for s in shards]


def repeated_intervals(shards: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' transforms: (places, interval) of the suffixes, in shards laid end to end, whose first ``length`` symbols occur twice or more.

    Places are ordered by those symbols; suffixes with equal ones share an interval.
    """
    tables, lf, place, base = [], [], [], 0
    for s in _coded(shards):
        order, bwt = transform(s)
        # the r-th row that symbol c precedes is the r-th row that begins with c
        to = np.empty(len(s), np.int32)
        to[np.argsort(bwt, kind="stable")] = np.arange(len(s), dtype=np.int32)
        tables.append(bwt)
        lf.append(to + np.int32(base))
        place.append(order + base)
        base += len(s)
    bwt, lf, place = np.concatenate(tables), np.concatenate(lf), np.concatenate(place)
    # two symbols a round where a pair of them fits 16 bits: the pair before a row, and the row two places before
    step = 2 if bwt.dtype == np.uint8 else 1
    before, back = bwt, lf
    if step == 2:
        there = bwt[lf]
        before, back = there.astype(np.uint16) << 8 | bwt, lf[lf]
        before[(there == 0) | (bwt == 0)] = 0
    rows = np.arange(base, dtype=np.int32)  # by no symbols: the shards one after the other
    interval = np.zeros(base, np.int32)
    depth = 0
    while depth < length and len(rows):
        one = step == 1 or (length - depth) % 2 == 1  # an odd length begins with a single symbol
        c = (bwt if one else before)[rows]
        order = np.argsort(c, kind="stable")
        c = c[order]
        past = int(np.searchsorted(c, 1))  # a separator precedes the first rows: their strings would cross it
        order, c = order[past:], c[past:]
        interval, rows = interval[order], (lf if one else back)[rows[order]]
        new = np.ones(len(rows) + 1, bool)
        np.logical_or(c[1:] != c[:-1], interval[1:] != interval[:-1], out=new[1:-1])
        interval = np.cumsum(new[:-1], dtype=np.int32)
        depth += 1 if one else 2
        if depth % LEAVE_EVERY < step or depth == length:
            held = ~(new[:-1] & new[1:])  # not alone
            rows, interval = rows[held], interval[held]
    return place[rows], interval


def solve_job(doc: np.ndarray, start: np.ndarray, parts: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """Removed spans (document, start, stop) of segments, judged among them; the earliest of equal windows stays."""
    shards, held, size = [], [], 0
    for p in parts:
        held.append(np.frombuffer(p, np.uint8).astype(np.uint16) + np.uint16(1))
        held.append(np.zeros(1, np.uint16))
        size += len(p) + 1
        if size >= shard_bytes:
            shards.append(np.concatenate(held))
            held, size = [], 0
    if held:
        shards.append(np.concatenate(held))
    at, interval = repeated_intervals(shards, length)
    lengths = np.array([len(p) for p in parts])
    begins = np.cumsum(lengths + 1) - lengths - 1
    of = np.searchsorted(begins, at, side="right") - 1
    offset = at - begins[of]
    fits = offset + length <= lengths[of]
    at, interval, of, offset = at[fits], interval[fits], of[fits], offset[fits]
    where = start[of] + offset
    order = np.lexsort((where, doc[of], interval))
    first = np.ones(len(order), bool)
    first[1:] = interval[order][1:] != interval[order][:-1]
    gone = order[~first & ~_same_place(first, doc[of][order], where[order])]
    gone = gone[np.lexsort((offset[gone], of[gone]))]
    if not len(gone):
        return []
    o, k = of[gone], where[gone]
    split = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1] + 1)]))
    last = np.concatenate([split[1:], [len(gone)]]) - 1
    return list(zip(doc[o[split]].tolist(), k[split].tolist(), (k[last] + length).tolist(), strict=True))


ROW = pa.schema([("kind", pa.int8()), ("m", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
ROW_SQL = "kind tinyint, m bigint, s bigint, doc bigint, start bigint, n bigint"
PART_SQL = "m bigint, doc bigint, start bigint, part binary"
SEGMENT, SELF, GONE = 0, 1, 2  # kinds: a segment, one that may repeat itself, removed bytes (start, n of them)


def _rows(kind, m, s, doc, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), t) for x, t in zip((kind, m, s, doc, start, n), ROW.types, strict=True)], schema=ROW)


def _pieces(chunk: pa.Table) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(documents, starts, bytes) of a chunk's texts by document, some CHUNK_BYTES at a time."""
    chunk = chunk.sort_by("doc")
    held: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for doc, text in zip(chunk.column("doc").to_pylist(), chunk.column("text").cast(pa.binary()).to_pylist(), strict=True):
        for lo in range(0, max(1, len(text) - LENGTH + 1), CHUNK_BYTES):
            part = text[lo : lo + CHUNK_BYTES + LENGTH - 1]
            if held[0] and size + len(part) > 2 * CHUNK_BYTES:
                yield held
                held, size = ([], [], []), 0
            for x, v in zip(held, (doc, lo, part), strict=True):
                x.append(v)
            size += len(part)
    if held[0]:
        yield held


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, starts, texts in (p for chunk in chunks(batches, "text", CHUNK_BYTES) for p in _pieces(chunk)):
        ids, begins = np.array(docs, np.int64), np.array(starts, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        value, cls, place, n, twice = segments(np.frombuffer(b"".join(texts), np.uint8), bounds)
        of = np.searchsorted(bounds, place, side="right") - 1
        doc, start = ids[of], place - bounds[of] + begins[of]
        order = np.lexsort((np.arange(len(cls)), cls, value))
        first = np.ones(len(order), bool)
        first[1:] = (value[order][1:] != value[order][:-1]) | (cls[order][1:] != cls[order][:-1])
        keep, gone = np.sort(order[first]), np.sort(order[~first & ~_same_place(first, doc[order], start[order])])
        yield _rows(twice[keep].astype(np.int8), value[keep].view(np.int64), cls[keep].view(np.int64), doc[keep], start[keep], n[keep])
        if len(gone):
            # neighbouring segments of a document are one span
            cut = np.concatenate([[True], (doc[gone][1:] != doc[gone][:-1]) | (start[gone][1:] > (start + n)[gone][:-1] + LENGTH - 1)])
            at = np.flatnonzero(cut)
            end = (start + n)[gone][np.concatenate([at[1:], [len(gone)]]) - 1] + LENGTH - 1
            begin = start[gone][at]
            yield _rows(np.full(len(at), GONE), begin + (doc[gone][at] << 20), np.zeros(len(at), np.int64), doc[gone][at], begin, end - begin)


def _same_place(first: np.ndarray, doc: np.ndarray, start: np.ndarray, held: tuple[int, int] | None = None) -> np.ndarray:
    """Whether each row stands where the first of its class does: a row that its table repeats; held: where the class of rows before any first began."""
    of = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
    d, k = np.where(of < 0, held[0] if held else 0, doc[of]), np.where(of < 0, held[1] if held else 0, start[of])
    return (doc == d) & (start == k)


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m, s, doc, start): repeats of a class become removed bytes; firsts stay only where a transform must judge them."""
    held = None  # the last first so far, whose minimizer may go on: (m, s, doc, start, n, self, whether to judge)
    for b in batches:
        kind, m, s, doc, start, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        pass_on = kind == GONE
        if pass_on.any():
            yield b.filter(pa.array(pass_on))
            kind, m, s, doc, start, n = (x[~pass_on] for x in (kind, m, s, doc, start, n))
        if not len(m):
            continue
        first = np.ones(len(m), bool)
        first[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
        if held is not None:
            first[0] = (m[0], s[0]) != held[:2]
        again = ~first & ~_same_place(first, doc, start, held[2:4] if held is not None else None)
        if again.any():
            yield _rows(np.full(again.sum(), GONE), m[again], s[again], doc[again], start[again], n[again] + LENGTH - 1)
        rows = [x[first] for x in (m, s, doc, start, n)]
        judge = kind[first] == SELF
        if held is not None:
            rows = [np.concatenate([[h], x]) for h, x in zip(held[:5], rows, strict=True)]
            judge = np.concatenate([[held[5]], judge])
        if not len(judge):
            continue
        same = rows[0][1:] == rows[0][:-1]
        judge[1:] |= same
        judge[:-1] |= same
        held = (*(x[-1] for x in rows), judge[-1])
        out = judge[:-1]
        if out.any():
            yield _rows(np.zeros(out.sum(), np.int8), *[x[:-1][out] for x in rows])
    if held is not None and held[5]:
        yield _rows([SEGMENT], *[[x] for x in held[:5]])


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted: list of m, start, n) to (m, doc, start, part)."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for doc, text, wanted in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            for w in wanted:
                for x, v in zip(out, (w["m"], doc, w["start"], text[w["start"] : w["start"] + w["n"] + LENGTH - 1]), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["m", "doc", "start", "part"])


def _split_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments cut again into runs of three more minimizers; equal windows stay together."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for m, doc, start, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
            pieces = [(m & 0xFFFFFFFFFFFFFFFF, 0, len(part) - LENGTH + 1)]
            for seed in (1, 2, 3):
                finer = []
                for key, lo, n in pieces:
                    data = np.frombuffer(part[lo : lo + n + LENGTH - 1], np.uint8)
                    value, _, place, runs, _ = segments(data, np.array([0, len(data)]), seed * 7919)
                    finer += [(int(_mix(np.array([key], _U) * _BASE + v)[0]), lo + p, r) for v, p, r in zip(value, place.tolist(), runs.tolist(), strict=True)]
                pieces = finer
            for key, lo, n in pieces:
                for x, v in zip(out, (key - (1 << 64) if key >> 63 else key, doc, start + lo, part[lo : lo + n + LENGTH - 1]), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, b.schema.types, strict=True)], schema=b.schema)


def _split_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as single windows under a hash of their bytes, of equal ones in a batch the earliest; the later ones come without bytes, which marks them as removed."""
    for b in batches:
        first: dict[bytes, tuple[int, int]] = {}
        gone: list[tuple[int, int]] = []
        for doc, start, part in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            for i in range(len(part) - LENGTH + 1):
                w, at = part[i : i + LENGTH], (doc, start + i)
                was = first.setdefault(w, at)
                if was != at:
                    first[w] = min(was, at)
                    gone.append(max(was, at))
        rows = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), *at, w) for w, at in first.items()] + [(doc + start, doc, start, b"") for doc, start in gone]
        out = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, b.schema.types, strict=True)], schema=b.schema)


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "stop"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, doc, start, part) sorted by m, solved in jobs of whole minimizers; of equal parts of one window the earliest waits, and a part without bytes is a removed window."""
    doc, start, parts, single, size, last = [], [], [], {}, 0, None
    for b in batches:
        gone = []
        for m, d, k, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if m != last and size >= JOB_BYTES:
                yield _spans(solve_job(np.array(doc, np.int64), np.array(start, np.int64), parts))
                doc, start, parts, single, size = [], [], [], {}, 0
            last = m
            if not part:
                gone.append((d, k, k + LENGTH))
                continue
            if len(part) == LENGTH:
                at = single.setdefault(part, len(parts))
                if at < len(parts):
                    sooner, later = sorted([(doc[at], start[at]), (d, k)])
                    doc[at], start[at] = sooner
                    if sooner != later:
                        gone.append((*later, later[1] + LENGTH))
                    continue
            doc.append(d)
            start.append(k)
            parts.append(part)
            size += len(part)
        yield _spans(gone)
    if parts:
        yield _spans(solve_job(np.array(doc, np.int64), np.array(start, np.int64), parts))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, text): the side that both joins below read, so that its one shuffle serves both."""
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).filter("doc IS NOT NULL")


def removed_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc, spans): per document with removed bytes, an array of (start, stop), unmerged."""
    rows = _texts(docs, text, key)
    dealt = rows.filter(F.octet_length("text") >= LENGTH).mapInArrow(_segmented, ROW_SQL).repartition("m").sortWithinPartitions("m", "s", "doc", "start")
    classed = checkpointed(dealt.mapInArrow(_classed, ROW_SQL))
    judge = classed.filter(F.col("kind") != GONE)
    wanted = judge.groupBy("doc").agg(F.collect_list(F.struct("m", "start", "n")).alias("wanted"))
    parts = rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_cut_bytes, PART_SQL)
    hot = judge.groupBy("m").agg(F.sum(F.col("n") + (LENGTH - 1)).alias("bytes")).filter(F.col("bytes") > hot_bytes).select("m")
    if not hot.isEmpty():
        columns = parts.columns
        finer = checkpointed(parts.join(hot, "m", "left_semi").select(*columns).mapInArrow(_split_hot, PART_SQL))
        still = finer.groupBy("m").agg(F.sum(F.octet_length("part")).alias("bytes")).filter(F.col("bytes") > hot_bytes).select("m")
        windows = finer.join(still, "m", "left_semi").select(*columns).mapInArrow(_split_windows, PART_SQL)
        parts = parts.join(hot, "m", "left_anti").select(*columns).union(finer.join(still, "m", "left_anti").select(*columns)).union(windows)
    judged = parts.repartition("m").sortWithinPartitions("m").mapInArrow(_judged, "doc bigint, start bigint, stop bigint")
    gone = classed.filter(F.col("kind") == GONE).select("doc", "start", (F.col("start") + F.col("n")).alias("stop"))
    return gone.union(judged).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, spans (merged, in bytes); with_text adds kept, the remaining bytes."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer: places are ordered by it")
    spans = removed_spans(docs, text, key, hot_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            sizes, removed, counts, digests, merged, kept = [], [], [], [], [], []
            for t, found in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                spans = merge_spans([(x["start"], x["stop"]) for x in found or ()])
                left, at = [], 0
                for lo, hi in spans:
                    left.append(t[at:lo])
                    at = hi
                left = b"".join([*left, t[at:]])
                for x, v in zip((sizes, removed, counts, digests, merged), (len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": lo, "stop": hi} for lo, hi in spans]), strict=True):
                    x.append(v)
                kept.append(left if with_text else None)
            columns = [b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(digests, pa.string()), pa.array(merged, pair), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    keyless = docs.filter(F.col(key).isNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    out = _texts(docs, text, key).join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(run, schema).union(keyless.mapInArrow(run, schema))
    out = out.withColumn("doc", F.col("doc").cast(docs.schema[key].dataType)).withColumnRenamed("doc", key)
    return out if with_text else out.drop("kept")


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256), from a set of all strings seen; for tests."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=False) if not g)
        out[d] = (len(data), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(data)]).sum()), hashlib.sha256(kept).hexdigest())
    return out
