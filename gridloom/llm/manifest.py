"""A Merkle manifest of a dataset: per group a tree over its rows in key order, and one over the groups' roots.

A row's rank in its group comes from hierarchical histograms of the key's digits: counts of the key's upper digits,
summed within the next upper digit and so on, give each bucket of 2^LOW keys the number of rows before it, so
nothing is sorted as a whole; within a bucket rows are ranked by a window. A bucket of more than MOST rows
(a key that many rows share) is split further by its low digit and by digits of the leaf. The rank's digits to
the base of the fanout are the path of the leaf in a trie. Nodes are reduced by longest prefix first: leaves that share all but
the last LEVELS digits form a block, reduced in a task; the blocks' roots form the next blocks. On the way back
each block hands its nodes the digests beside their path, so a leaf has its proof without joining level by level.

Equal rows are one leaf with a count until they are ranked; their places are interchangeable. Blocks are rows
of bounded size, whatever the groups are.

Edge cases: null fields are ``-``, which differs from any value; a null group is the first; null keys come first
in their group; rows that share a key stand in order of their leaf; a null key is never tampered with; a text is hashed
whole; an empty table gives no rows; columns other than the fields play no part. Groups are one row each in the
window that orders them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import checkpointed, spread_join

FANOUT = 2
#: Digits of the rank that are reduced in one task, at fanout 2: blocks of 256.
LEVELS = 8
#: Bits of the key's lowest digit, and of the ones above.
LOW, UPPER = 12, 16
#: Rows of a bucket from which it is split by digits of the leaf.
MOST = 1 << 17
TAMPER_SHARE = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, key: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(grp, id, leaf, tampered, c): each different row once with its number; tampered is null where nothing changed."""
    leaf = F.sha2(F.concat(*[_field(F.col(f)) for f in fields]), 256)
    more = F.sha2(F.concat(*[_field(F.col(f).cast("decimal(20,0)") + 1 if f == count else F.col(f)) for f in fields]), 256)
    touched = (F.crc32(F.col(key).cast("string")) % TAMPER_SHARE == 0) & F.col(count).isNotNull()
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(grp.alias("grp"), F.col(key).cast("bigint").alias("id"), leaf.alias("leaf"), F.when(touched, more).alias("tampered"))
    return rows.groupBy("grp", "id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("c"))


def _before(by: list[str], order: list[str], count: str) -> Column:
    """Sum of count over the rows of a window before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def ranked(items: DataFrame, most: int = MOST) -> DataFrame:
    """items with rank (of the first of c equal rows in the group) and n (rows of the group)."""
    # a null key has a bucket of its own before all others
    bucket = F.coalesce(F.shiftright("id", LOW), F.lit(-(1 << (64 - LOW))))
    items = checkpointed(items.withColumn("p0", bucket))
    low = items.groupBy("grp", "p0").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m")).withColumn("p1", F.shiftright("p0", UPPER)).withColumn("p2", F.shiftright("p0", 2 * UPPER))
    mid = low.groupBy("grp", "p1", "p2").agg(F.sum("c").alias("c"))
    top = mid.groupBy("grp", "p2").agg(F.sum("c").alias("c"))
    top = top.select("grp", "p2", _before(["grp"], ["p2"], "c").alias("at2"), F.sum("c").over(Window.partitionBy("grp")).alias("n"))
    mid = mid.select("grp", "p1", "p2", _before(["grp", "p2"], ["p1"], "c").alias("at1")).join(top, ["grp", "p2"]).select("grp", "p1", (F.col("at1") + F.col("at2")).alias("at1"), "n")
    low = low.select("grp", "p0", "p1", "m", _before(["grp", "p1"], ["p0"], "c").alias("at0")).join(mid, ["grp", "p1"]).select("grp", "p0", "m", "n", (F.col("at0") + F.col("at1")).alias("at"))
    total = items.count()
    placed = spread_join(items, low, ["grp", "p0"], "m", "leaf", total)
    few = placed.filter(F.col("m") <= most).withColumn("rank", F.col("at") + _before(["grp", "p0"], ["id", "leaf", "tampered"], "c"))
    # buckets with many rows a key: the same by the low digit, here the key, and by four digits of the leaf
    many = placed.filter(F.col("m") > most).withColumn("d", F.substring("leaf", 1, 4))
    fine = many.groupBy("grp", "p0", "id", "d").agg(F.sum("c").alias("c"))
    keys = fine.groupBy("grp", "p0", "id").agg(F.sum("c").alias("c")).select("grp", "p0", "id", _before(["grp", "p0"], ["id"], "c").alias("at_id"))
    fine = fine.select("grp", "p0", "id", "d", _before(["grp", "p0", "id"], ["d"], "c").alias("at_d"))
    same = lambda a, b, *on: [a[x].eqNullSafe(b[x]) for x in on]
    fine = fine.join(keys, same(fine, keys, "grp", "p0", "id")).select(fine["grp"], fine["p0"], fine["id"], "d", (F.col("at_id") + F.col("at_d")).alias("at_d"))
    many = many.withColumn("in_d", _before(["grp", "p0", "id", "d"], ["leaf", "tampered"], "c"))
    many = many.join(fine, same(many, fine, "grp", "p0", "id", "d")).select(*[many[x] for x in ("grp", "id", "leaf", "tampered", "c", "n")], (many["at"] + fine["at_d"] + many["in_d"]).alias("rank"))
    names = ["grp", "id", "leaf", "tampered", "c", "n", "rank"]
    return few.select(*names).union(many.select(*names))


def depth(n: int, fanout: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def reduced(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """Level by level the nodes of a block, its leaves first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def beside(levels: list[list[str]], i: int, fanout: int) -> list[str]:
    """The digests of the other nodes of the runs on the path from place i, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % fanout
        out += nodes[first:i] + nodes[i + 1 : first + fanout]
        i //= fanout
    return out


def fold(node: str, rank: int, n: int, others: list[str], fanout: int) -> tuple[str, int]:
    """The root of n nodes from the one at rank and the digests beside its path; and how many of these were taken."""
    used = 0
    while n > 1:
        first = rank - rank % fanout
        left, right = rank - first, min(fanout, n - first) - (rank - first) - 1
        node = digest([*others[used : used + left], node, *others[used + left : used + left + right]])
        used, rank, n = used + left + right, rank // fanout, -(-n // fanout)
    return node, used


def _size(fanout: int) -> int:
    """Ranks of a block: the power of the fanout next above 2^(LEVELS - 1)."""
    size = fanout
    while size < 1 << LEVELS:
        size *= fanout
    return size


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """(grp, prefix, n, nodes): nodes of (grp, rank, n, node) by all but the last digits of their rank."""
    prefix = F.floor(F.col("rank") / size).cast("bigint").alias("prefix")
    return nodes.groupBy("grp", prefix, "n").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("nodes"))


def _climb(blocks: DataFrame, size: int, fanout: int) -> DataFrame:
    """The roots of blocks, as (grp, rank, n, node) of the level above."""
    block_levels = depth(size, fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, prefix, n, nodes = (b.column(k).to_pylist() for k in ("grp", "prefix", "n", "nodes"))
            roots = [reduced(_expanded(x), min(block_levels, depth(k, fanout)), fanout)[-1][0] for x, k in zip(nodes, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(prefix, pa.int64()), pa.array([max(1, -(-k // size)) for k in n], pa.int64()), pa.array(roots, pa.string())], ["grp", "rank", "n", "node"])

    return blocks.mapInArrow(run, "grp string, rank bigint, n bigint, node string")


def _expanded(nodes: list[dict]) -> list[str]:
    """The digests of a block in order; a leaf with a count stands that often."""
    return [x["node"] for x in nodes for _ in range(x.get("c") or 1)]


def _descend(blocks: DataFrame, above: DataFrame, size: int, fanout: int) -> DataFrame:
    """(grp, rank, up) for the nodes of blocks, from the (grp, rank, up) of their roots: up is the digests beside the path to the top."""
    block_levels = depth(size, fanout)
    joined = blocks.join(above.withColumnRenamed("rank", "prefix"), ["grp", "prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, prefix, n, nodes, up = (b.column(k).to_pylist() for k in ("grp", "prefix", "n", "nodes", "up"))
            for i, x in enumerate(nodes):
                levels = reduced(_expanded(x), min(block_levels, depth(n[i], fanout)), fanout)
                ups = ["".join(beside(levels, k, fanout)) + up[i] for k in range(len(levels[0]))]
                yield pa.RecordBatch.from_arrays([pa.array([g[i]] * len(ups), pa.string()), pa.array(range(prefix[i] * size, prefix[i] * size + len(ups)), pa.int64()), pa.array(ups, pa.string())], ["grp", "rank", "up"])

    return joined.select("grp", "prefix", "n", "nodes", "up").mapInArrow(run, "grp string, rank bigint, up string")


def _tree(nodes: DataFrame, most: int, size: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each stage, leaves first, and the one node (grp, rank 0, n 1, node) of each group; ``most`` is the greatest group."""
    stages = []
    while most > 1:
        stages.append(checkpointed(_blocks(nodes, size)))
        nodes, most = _climb(stages[-1], size, fanout), -(-most // size)
    return stages, nodes


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, most: int = MOST) -> DataFrame:
    """One row per row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified."""
    size, kind = _size(fanout), docs.schema[key].dataType.simpleString()
    schema = "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    items = ranked(leaves(docs, key, group, count, fields), most)
    # equal rows are cut where blocks end, not multiplied
    first, last = F.floor(F.col("rank") / size).cast("bigint"), F.floor((F.col("rank") + F.col("c") - 1) / size).cast("bigint")
    cut = items.withColumn("prefix", F.explode(F.sequence(first, last)))
    start, stop = F.greatest("rank", F.col("prefix") * size), F.least(F.col("rank") + F.col("c"), (F.col("prefix") + 1) * size)
    held = F.struct(start.alias("rank"), (stop - start).alias("c"), F.col("leaf").alias("node"), "tampered", "id")
    bottom = checkpointed(cut.groupBy("grp", "prefix", "n").agg(F.array_sort(F.collect_list(held)).alias("nodes")))
    greatest = bottom.agg(F.max("n")).first()[0]
    if greatest is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key).withColumn(key, F.col(key).cast(kind))
    stages, subroots = _tree(_climb(bottom, size, fanout), -(-greatest // size), size, fanout)
    subroots = checkpointed(subroots.select("grp", F.col("node").alias("subroot")))
    groups = subroots.count()
    # the groups' own tree; groups take one row each here
    order = Window.orderBy("grp")
    subroots = subroots.withColumn("place", F.row_number().over(order).cast("bigint") - 1)
    upper, root = _tree(subroots.select(F.lit("").alias("grp"), F.col("place").alias("rank"), F.lit(groups).cast("bigint").alias("n"), F.col("subroot").alias("node")), groups, size, fanout)
    up = root.select("grp", "rank", F.lit("").alias("up"))
    for blocks in reversed(upper):
        up = _descend(blocks, up, size, fanout)
    tops = subroots.join(up.select(F.col("rank").alias("place"), "up"), "place")
    tops = checkpointed(tops.select("grp", "subroot", "place", F.lit(root.first()["node"]).alias("root"), "up"))
    up = tops.select("grp", F.lit(0).cast("bigint").alias("rank"), "up")
    for blocks in reversed(stages):
        up = _descend(blocks, up, size, fanout)
    block_levels = depth(size, fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ("prefix", "n", "nodes", "up", "subroot", "place", "root")
            for prefix, n, nodes, above, subroot, place, top in zip(*(b.column(k).to_pylist() for k in names), strict=True):
                levels = reduced(_expanded(nodes), min(block_levels, depth(n, fanout)), fanout)
                out, i, above = [], 0, [above[k : k + 64] for k in range(0, len(above), 64)]
                for x in nodes:
                    for _ in range(x["c"]):
                        others = beside(levels, i, fanout) + above
                        folded, used = fold(x["tampered"] or x["node"], prefix * size + i, n, others, fanout)
                        folded, _ = fold(folded, place, groups, others[used:], fanout)
                        out.append((x["id"], x["node"], subroot, top, digest(others), folded, folded == top))
                        i += 1
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = bottom.join(up.select("grp", F.col("rank").alias("prefix"), "up"), ["grp", "prefix"])
    # a group may hold most blocks: it has as many rows there, so its row of tops goes to them by hash of the block
    blocks_of = tops.drop("up").join(bottom.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")), "grp")
    rows = spread_join(rows, blocks_of, ["grp"], "rows", "prefix", bottom.count())
    out = rows.select("prefix", "n", "nodes", "up", "subroot", "place", "root").mapInArrow(run, schema)
    return out.withColumnRenamed("key", key).withColumn(key, F.col(key).cast(kind))


def brute_force(rows: list[dict], key: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> list[tuple]:
    """The rows of ``manifest`` by building every tree whole; for tests."""
    import zlib

    def leaf(r: dict) -> str:
        return digest(["-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in fields])

    def changed(r: dict) -> str:
        hit = r[key] is not None and r[count] is not None and zlib.crc32(str(r[key]).encode()) % TAMPER_SHARE == 0
        return leaf({**r, count: r[count] + 1}) if hit else leaf(r)

    def paths(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
        where, path = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for k, w in enumerate(where):
                run = runs[w // fanout]
                path[k].append((run[: w % fanout], run[w % fanout + 1 :]))
            nodes, where = [digest(r) for r in runs], [w // fanout for w in where]
        return nodes[0], path

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[group], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in names:
        held = sorted(groups[g], key=lambda r: (r[key] is not None, r[key] or 0, leaf(r)))
        built[g] = held, *paths([leaf(r) for r in held])
    root, tops = paths([built[g][1] for g in names]) if names else ("", [])
    out = []
    for g, top in zip(names, tops, strict=True):
        held, subroot, path = built[g]
        for r, p in zip(held, path, strict=True):
            node, others = changed(r), []
            for left, right in [*p, *top]:
                node = digest([*left, node, *right])
                others += left + right
            out.append((r[key], leaf(r), subroot, root, digest(others), node, node == root))
    return out
