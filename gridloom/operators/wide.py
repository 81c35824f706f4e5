"""Sparse decompositions of matrices with any number of columns, without a matrix of products.

A matrix is a table of tiles, SIDE rows by SIDE columns, each a row with its entries; a vector is a table of blocks of SIDE
numbers. A product with a vector joins blocks to tiles, multiplies in Arrow batches, where a task adds up what it holds, and sums
per block. Only blocks move: a vector of at most NEAR blocks is broadcast, and for a longer one the tiles are kept (persisted until a
decomposition ends) dealt by its blocks, and its blocks are dealt likewise. One round of a decomposition is X v and then X' of that.
Centring, and regressing columns out, is a correction of rank q: with G the constant and the columns given,
X'(I - G (G'G)^-1 G')X v = X'(X v) - (X'G)(G'G)^-1 (X'G)'v, where X'G are q vectors beside the columns.

No vector of more than NEAR blocks comes to the driver, which holds numbers a component. The threshold of a round is the exact order statistic of
the absolute values: their bits are counted by 16 bits at a time, until the values left are few.

Edge cases: entries that are null count as 0, those of one place are added; rows and columns are any whole numbers; a share keeps
one column at least; a matrix without variance gives components of variance 0; equal values at the threshold all go (soft) or
all stay (hard).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.lineage import checkpointed

SIDE = 512
#: Values of one histogram digit that may come to the driver.
FEW = 1 << 16
#: Blocks up to which a vector is broadcast: 256 KB.
NEAR = 64
#: Columns that may be regressed out.
MAX_GIVEN = 256
_HELD = 2048


class Tiles:
    """The tiles (rb, cb, i, j, x) of a matrix, and, by each of rb and cb that has more than NEAR blocks, dealt by it."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        counts = rows.agg(F.count_distinct("rb"), F.count_distinct("cb")).first()
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.tasks = {key: max(1, min(most, n)) for key, n in zip(("rb", "cb"), counts, strict=True)}
        self.dealt = {key: rows.repartition(self.tasks[key], key) for key, n in zip(("rb", "cb"), counts, strict=True) if n > NEAR}

    def keep(self) -> None:
        for df in self.dealt.values():
            if not df.is_cached:
                df.persist()

    def release(self) -> None:
        for df in self.dealt.values():
            df.unpersist()

    def beside(self, vector: DataFrame, at: str, to: str) -> DataFrame:
        """Each tile with the block w of its number ``at``."""
        blocks = vector.select(F.col("b").alias(at), "w")
        if at in self.dealt:
            return self.dealt[at].join(blocks.repartition(self.tasks[at], at).hint("shuffle_hash"), at)
        return self.dealt.get(to, self.rows).join(F.broadcast(blocks), at)


@dataclass(frozen=True)
class Wide:
    """tiles: their layouts; cross: b, g (an array of q arrays, X'G) and var (of the columns); k: (G'G)^-1."""

    tiles: Tiles
    cross: DataFrame
    k: np.ndarray
    n: int
    columns: int


def entries(df: DataFrame, row: str, values: str) -> DataFrame:
    """(row, col, value) of a table with an array a row."""
    return df.select(F.col(row).alias("row"), F.posexplode(values).alias("col", "value"))


def _sums(parts: DataFrame, tasks: int) -> DataFrame:
    """Blocks (b, w) from partial sums (b, k, s); partitioned by block once."""
    sums = parts.repartition(tasks, "b").groupBy("b", "k").agg(F.sum("s").alias("s"))
    return sums.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("w"))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of tiles (key, a, c, x) with their blocks w, added up by key in the task: rows (b, k, s)."""
    held: dict[int, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for key, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(SIDE, key)), pa.array(np.arange(SIDE, dtype=np.int32)), pa.array(s)], ["b", "k", "s"])
        held.clear()

    for b in batches:
        whole = {name: b.column(name) for name in ("a", "c", "x", "w")}
        for r, key in enumerate(b.column("key").to_pylist()):
            a, c, x, w = (whole[name][r].values.to_numpy(zero_copy_only=False) for name in ("a", "c", "x", "w"))
            s = np.bincount(a, x * w[c], SIDE)
            held[key] = held[key] + s if key in held else s
        if len(held) > _HELD:
            yield from out()
    yield from out()


def _times(tiles: Tiles, vector: DataFrame, forward: bool) -> DataFrame:
    """Blocks of X v (forward) or of X' u."""
    at, to, a, c = ("cb", "rb", "i", "j") if forward else ("rb", "cb", "j", "i")
    rows = tiles.beside(vector, at, to)
    return _sums(rows.select(F.col(to).alias("key"), F.col(a).alias("a"), F.col(c).alias("c"), "x", "w").mapInArrow(_added, "b bigint, k int, s double"), tiles.tasks[to])


def _less(p: Column, q: Column, by: float) -> Column:
    """p - q * by, entry by entry."""
    return F.zip_with(p, q, lambda x, y: x - y * by)


def _dot(p: Column, q: Column) -> Column:
    """Sum over all blocks of the products of two block columns."""
    return F.coalesce(F.sum(F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))


def wide(cells: DataFrame, given: DataFrame | None = None) -> Wide:
    """The matrix of cells (row, col, value), with the columns of ``given`` (row, col, value), at most MAX_GIVEN, regressed out beside the constant."""
    floor = lambda c: F.floor(F.col(c) / SIDE).cast("bigint")
    place = lambda c: F.pmod(F.col(c), F.lit(SIDE)).cast("int")
    # cells are shuffled once: those of a tile meet in a task, where those of one place are added
    all_ = cells.select(floor("row").alias("rb"), floor("col").alias("cb"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    once = all_.repartition("rb", "cb").groupBy("rb", "cb", "row", "col").agg(F.sum("value").alias("value"))
    tiles = once.groupBy("rb", "cb").agg(F.collect_list(F.struct(place("row").alias("i"), place("col").alias("j"), F.col("value").alias("x"))).alias("e"))
    tiles = checkpointed(tiles.select("rb", "cb", F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.x").alias("x")))
    laid = Tiles(tiles)
    laid.keep()
    # the given columns as vectors over the rows, after the constant over the rows that there are
    rows = tiles.select("rb", F.explode(F.array_distinct("i")).alias("i")).distinct()
    n = rows.count()
    ones = rows.select(F.col("rb").alias("b"), F.col("i").alias("k"), F.lit(0).alias("g"), F.lit(1.0).alias("s"))
    names = [] if given is None else sorted(r[0] for r in given.select("col").distinct().limit(MAX_GIVEN + 1).collect())
    if len(names) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given columns")
    if names:
        code = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i + 1)])
        more = given.select(floor("row").alias("b"), place("row").alias("k"), code[F.col("col")].alias("g"), F.col("value").cast("double").alias("s"))
        ones = ones.unionByName(more.join(rows.select(F.col("rb").alias("b"), F.col("i").alias("k")), ["b", "k"], "left_semi"))
    q = len(names) + 1
    dense = lambda e: F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda g: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.aggregate(F.filter(e, lambda x: (x["g"] == g) & (x["k"] == k)), F.lit(0.0), lambda s, x: s + x["s"])))
    if q == 1:
        filled = F.array(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.array_contains(F.col("e.k"), k).cast("double")))
    else:
        filled = dense(F.col("e"))
    g = checkpointed(ones.groupBy("b").agg(F.collect_list(F.struct("k", "g", "s")).alias("e")).select("b", filled.alias("g")))
    gram = g.agg(*[_dot(F.col("g")[i], F.col("g")[j]).alias(f"{i}_{j}") for i in range(q) for j in range(q)]).first()
    crossed = None
    for i in range(q):
        one = _times(laid, g.select("b", F.col("g")[i].alias("w")), False).withColumnRenamed("w", f"g{i}")
        crossed = one if crossed is None else crossed.join(one, "b")
    squares = _sums(tiles.select(F.col("cb").alias("b"), F.explode(F.arrays_zip("j", "x")).alias("e")).groupBy("b", F.col("e.j").alias("k")).agg(F.sum(F.col("e.x") ** 2).alias("s")).unionByName(tiles.select(F.col("cb").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("k"), F.lit(0.0).alias("s")).distinct()), laid.tasks["cb"])
    crossed = crossed.join(squares.withColumnRenamed("w", "sq"), "b")
    var = F.zip_with("sq", "g0", lambda s, m: F.greatest(s / max(n, 1) - (m / max(n, 1)) ** 2, F.lit(0.0)))
    cross = checkpointed(crossed.select("b", F.array(*[f"g{i}" for i in range(q)]).alias("g"), var.alias("var")))
    columns = tiles.select("cb", F.explode(F.array_distinct("j")).alias("j")).distinct().count()
    k = np.array([gram[f"{i}_{j}"] for i in range(q) for j in range(q)], float).reshape(q, q)
    return Wide(laid, cross, np.linalg.pinv(k), n, columns)


def kth_largest(vector: DataFrame, k: int, columns: int, few: int = FEW) -> float:
    """The k-th largest absolute value of the blocks, k from 1, of a vector over so many columns; 0 beyond the last."""

    def bits(column: pa.Array) -> np.ndarray:
        return np.abs(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)

    prefix, shift, left = 0, 64, columns
    while shift and left > few:
        shift -= 16

        def count(batches, prefix=prefix, shift=shift):
            total = np.zeros(1 << 16, np.int64)
            for b in batches:
                v = bits(b.column("w"))
                if shift < 48:
                    v = v[v >> np.uint64(shift + 16) == prefix]
                total += np.bincount(((v >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["d", "n"])

        seen = sorted(vector.select("w").mapInArrow(count, "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n")).collect(), reverse=True)
        for r in seen:
            if k <= r["n"]:
                prefix, left = prefix << 16 | r["d"], r["n"]
                break
            k -= r["n"]
        else:
            return 0.0

    def values(batches):
        for b in batches:
            v = bits(b.column("w"))
            v = v[v > 0] if shift == 64 else v[v >> np.uint64(shift) == prefix]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.float64))], ["v"])

    if shift == 0:
        return float(np.array([prefix], np.uint64).view(np.float64)[0])
    found = np.sort([r["v"] for r in vector.select("w").mapInArrow(values, "v double").collect()])[::-1]
    return float(found[k - 1]) if k <= len(found) else 0.0


def thresholded(vector: DataFrame, columns: int, share: float, hard: bool = False) -> DataFrame:
    """Blocks w, soft- (or hard-) thresholded so that about a share of the columns stays."""
    keep = max(1, round(share * columns))
    if keep >= columns:
        return vector
    if hard:
        cut = kth_largest(vector, keep, columns)
        return vector.withColumn("w", F.transform("w", lambda x: F.when(F.abs(x) >= cut, x).otherwise(0.0)))
    cut = kth_largest(vector, keep + 1, columns)
    return vector.withColumn("w", F.transform("w", lambda x: F.signum(x) * F.greatest(F.abs(x) - cut, F.lit(0.0))))


def _scalars(vector: DataFrame, m: Wide, also: tuple[str, ...] = ()) -> tuple[float, np.ndarray, list[float]]:
    """The length of the blocks, their products with X'G, and those with other columns of vector."""
    q = len(m.k)
    rows = vector.join(m.cross, "b")
    r = rows.agg(_dot(F.col("w"), F.col("w")), *[_dot(F.col("w"), F.col("g")[i]) for i in range(q)], *[_dot(F.col("w"), F.col(c)) for c in also]).first()
    return float(np.sqrt(r[0])), np.array(r[1 : q + 1], float), list(r[q + 1 :])


def _corrected(z: DataFrame, m: Wide, coefficients: np.ndarray, scale: float) -> DataFrame:
    """(z - (X'G) coefficients) * scale, over the columns of m."""
    out = z.join(m.cross.select("b", "g"), "b")
    w = F.col("w")
    for i, c in enumerate(coefficients.tolist()):
        w = _less(w, F.col("g")[i], c)
    return out.select("b", F.transform(w, lambda x: x * scale).alias("w"))


def product(x: Wide, y: Wide, vector: DataFrame, along: np.ndarray) -> DataFrame:
    """Y' M X v / n for blocks v over the columns of x; ``along`` is (X'G)'v. M takes out the constant and the given columns."""
    z = _times(y.tiles, _times(x.tiles, vector, True), False)
    return _corrected(z, y, x.k @ along, 1.0 / max(x.n, 1))


def _scaled(vector: DataFrame, size: float) -> DataFrame:
    return vector.withColumn("w", F.transform("w", lambda x: x / size)) if size else vector


def _loadings(vector: DataFrame, **marks) -> DataFrame:
    """(marks, col, loading) of the entries that aren't 0."""
    long = vector.select(*[F.lit(v).alias(k) for k, v in marks.items()], "b", F.posexplode("w").alias("k", "loading"))
    return long.filter("loading <> 0").select(*marks, (F.col("b") * SIDE + F.col("k")).alias("col"), "loading")


def _start(m: Wide) -> tuple[DataFrame, np.ndarray]:
    """The columns' variances as a unit vector, and its products with X'G."""
    v = m.cross.select("b", F.col("var").alias("w"))
    size, along, _ = _scalars(v, m)
    return _scaled(v, size), along / size if size else along


def sparse_svd(m: Wide, k: int, share: float, rounds: int = 30, hard: bool = False) -> tuple[list[float], DataFrame]:
    """Variances of the k leading sparse components, and their loadings (component, col, loading), the greatest positive.

    Each component is ``rounds`` thresholded power rounds of the covariance less the components before, from the columns' variances.
    """
    variances, found = [], []
    basis = None
    m.tiles.keep()
    for c in range(k):
        v, along = _start(m)
        before = [0.0] * c
        if c:
            v = checkpointed(v.join(basis, "b"))
            _, _, before = _scalars(v, m, tuple(f"v{i}" for i in range(c)))
        for last in range(rounds + 1):
            z = product(m, m, v.select("b", "w"), along)
            if c:
                z = z.join(basis, "b")
                w = F.col("w")
                for i in range(c):
                    w = _less(w, F.col(f"v{i}"), variances[i] * before[i])
                z = z.withColumn("w", w)
            if last == rounds:
                variances.append(float(z.withColumnRenamed("w", "z").join(v.select("b", "w"), "b").agg(_dot(F.col("z"), F.col("w"))).first()[0]))
                break
            v = thresholded(checkpointed(z), m.columns, share, hard)
            size, along, before = _scalars(v, m, tuple(f"v{i}" for i in range(c)))
            size = size or 1.0
            v, along, before = _scaled(v, size), along / size, [b / size for b in before]
        sign = v.select(F.explode("w").alias("w")).agg(F.max_by("w", F.abs("w"))).first()[0]
        v = checkpointed(_scaled(v.select("b", "w"), -1.0 if sign is not None and sign < 0 else 1.0))
        found.append(_loadings(v, component=c))
        one = v.withColumnRenamed("w", f"v{c}")
        basis = one if basis is None else basis.join(one, "b")
    m.tiles.release()
    loadings = found[0]
    for f in found[1:]:
        loadings = loadings.union(f)
    return variances, loadings


def sparse_cca(x: Wide, y: Wide, share_x: float, share_y: float, rounds: int = 20, hard: bool = False) -> tuple[float, DataFrame]:
    """The correlation of the leading pair of sparse directions, and its loadings (side, col, loading).

    Alternately v = Y'MXu and u = X'MYv, each thresholded and scaled to length 1, from the variances of x. Both matrices have the same rows, and
    the same columns given: a partial correlation where there are any.
    """
    if x.n != y.n:
        raise ValueError(f"{x.n} and {y.n} rows")
    x.tiles.keep()
    y.tiles.keep()
    u, along_u = _start(x)
    v, along_v = u, along_u
    for _ in range(rounds):
        v = thresholded(checkpointed(product(x, y, u, along_u)), y.columns, share_y, hard)
        size, along_v, _ = _scalars(v, y)
        v, along_v = _scaled(v, size or 1.0), along_v / (size or 1.0)
        u = thresholded(checkpointed(product(y, x, v, along_v)), x.columns, share_x, hard)
        size, along_u, _ = _scalars(u, x)
        u, along_u = _scaled(u, size or 1.0), along_u / (size or 1.0)
    a, b = _times(x.tiles, u, True).withColumnRenamed("w", "a"), _times(y.tiles, v, True).withColumnRenamed("w", "c")
    aa, ac, cc = a.join(b, "b").agg(_dot(F.col("a"), F.col("a")), _dot(F.col("a"), F.col("c")), _dot(F.col("c"), F.col("c"))).first()
    x.tiles.release()
    y.tiles.release()
    aa, ac, cc = aa - along_u @ x.k @ along_u, ac - along_u @ x.k @ along_v, cc - along_v @ x.k @ along_v
    r = float(ac / np.sqrt(aa * cc)) if aa > 0 and cc > 0 else 0.0
    return r, _loadings(u, side="x").union(_loadings(v, side="y"))
