"""Iterative operations: each round is a plan over the cells, cut by a reliable checkpoint."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import axes_of, box, faces, scattered, unbroadcast
from gridloom.operators.fronts import travel
from gridloom.plans.lineage import checkpointed

#: Bits of the cells along a tile's side within which components are joined at once, by the number of axes.
TILE_BITS = {1: 12, 2: 6, 3: 4, 4: 3}


def connected_components(df: DataFrame, full: bool = False) -> DataFrame:
    """(axes, component) of the cells of df: components by face contacts, or corner contacts with ``full``; a component is named by its least cell in scan order.

    A tile's cells are joined in one Arrow batch, so that only contacts across the borders of tiles are
    edges, and label minima jump by pointers; rounds grow with the logarithm of the tiles a component crosses.
    """
    axes = axes_of(df)
    bits = TILE_BITS[len(axes)]
    tiles = [F.shiftright(F.col(a).cast("bigint"), bits).alias(f"_t{a}") for a in axes]
    reach = [o for o in (box(axes, 1, centre=False) if full else faces(axes)) if next(d for d in reversed(o) if d) > 0]
    kinds = {a: df.schema[a].dataType.simpleString() for a in axes}
    local = df.select(*axes, *tiles).groupBy(*[f"_t{a}" for a in axes]).applyInArrow(_joined_in_tile(axes, reach), ", ".join([*(f"{a} {k}" for a, k in kinds.items()), *(f"_n{a} {k}" for a, k in kinds.items())]))
    # a node's name orders as scan order does
    named = checkpointed(local.select(*axes, F.struct(*[F.col(f"_n{a}").alias(a) for a in reversed(axes)]).alias("node")))
    last = (1 << bits) - 1
    border = named.filter(reduce(or_, [F.col(a).cast("bigint").bitwiseAND(F.lit(last)).isin(0, last) for a in axes]))
    moved = scattered(border.withColumnRenamed("node", "other"), reach, axes).select(*axes, "other")
    edges = checkpointed(border.join(unbroadcast(moved), axes).select(F.col("node").alias("u"), F.col("other").alias("v")).filter("u <> v").distinct())
    comp = _least_reachable(edges)
    out = named.join(unbroadcast(comp), named["node"] == comp["u"], "left")
    return out.select(*axes, F.coalesce("c", "node").alias("component"))


def _joined_in_tile(axes: list[str], reach: list[tuple[int, ...]]):
    """Rows (axes, _n<axis>) of a tile's cells, each once: the least cell in scan order that a cell reaches within the tile."""

    def run(table: pa.Table) -> pa.Table:
        at = np.stack([table.column(a).to_numpy().astype(np.int64) for a in axes])
        at -= (least := at.min(axis=1, keepdims=True))
        # a place beyond each border, so that a step never lands on another line
        stride = np.cumprod([1, *(at.max(axis=1)[:-1] + 3)])
        key, first = np.unique(stride @ at, return_index=True)
        place = at[:, first]
        label, pairs = np.arange(len(key)), []
        for o in reach:
            to = key + int(np.dot(stride, o))
            j = np.minimum(np.searchsorted(key, to), len(key) - 1)
            i = np.flatnonzero(key[j] == to)
            pairs.append((i, j[i]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while (label[i] != label[j]).any():
            p, q = label[i], label[j]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
        columns = [pa.array(x).cast(table.column(a).type) for place_ in (place + least, place[:, label] + least) for a, x in zip(axes, place_, strict=True)]
        return pa.Table.from_arrays(columns, [*axes, *(f"_n{a}" for a in axes)])

    return run


def _least_reachable(edges: DataFrame) -> DataFrame:
    """(u, c): c the least node that u reaches; alternating large and small stars."""
    now, mark = edges, None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(unbroadcast(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unbroadcast(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = checkpointed(small)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.groupBy("u").agg(F.min("v").alias("c"))
        mark = new


def component_sizes(df: DataFrame, full: bool = False) -> DataFrame:
    """(axes, component, size)."""
    cc = checkpointed(connected_components(df, full))
    return cc.join(cc.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")


def largest_component(df: DataFrame, level: float = 0.25, min_size: int = 50, v: str = "v") -> DataFrame:
    """The cells of the largest face-connected component of v >= level with at least min_size cells; equals all stay."""
    sized = component_sizes(df.filter(F.col(v) >= level)).filter(F.col("size") >= min_size)
    top = sized.agg(F.max("size").alias("_top"))
    return sized.crossJoin(F.broadcast(top)).filter("size = _top").select(*axes_of(df))


def label_clusters(df: DataFrame, min_size: int = 1, full: bool = False) -> DataFrame:
    """(axes, label): components of the cells of at least min_size, numbered by falling size and then scan order.

    Components are numbered within their size, and sizes by the number of larger components: of
    sizes there are at most the square root of twice the cells.
    """
    sized = checkpointed(component_sizes(df, full).filter(F.col("size") >= min_size))
    comps = sized.groupBy("component", "size").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    by_size = comps.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    before = by_size.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("size"))) - F.col("n")).select("size", "before")
    ranks = _numbered(comps).join(F.broadcast(before), "size").select("component", (F.col("before") + F.col("k")).alias("label"))
    return sized.join(ranks, "component").select(*axes_of(df), F.col("label").cast("bigint").alias("label"))


def _numbered(comps: DataFrame) -> DataFrame:
    """Adds k, the place from 1 of each component among those of its size, counted along the slowest axis of its name first, so that many small components don't meet in one task."""
    slow = F.col(f"component.{comps.schema['component'].dataType.fieldNames()[0]}")
    part = comps.withColumn("_slow", slow)
    counts = part.groupBy("size", "_slow").agg(F.count(F.lit(1)).alias("_n"))
    above = counts.withColumn("_above", F.sum("_n").over(Window.partitionBy("size").orderBy("_slow")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("size", "_slow").orderBy("component"))
    return part.withColumn("_k", own).join(above, ["size", "_slow"]).withColumn("k", F.col("_above") + F.col("_k")).drop("_k", "_above", "_slow")


def cluster_statistics(df: DataFrame, level: float, min_size: int = 1, v: str = "v", w: str = "w") -> DataFrame:
    """Per face-connected cluster of v >= level: label (as label_clusters), size, mean, max, and w where v is greatest (its least there)."""
    axes = axes_of(df)
    found = label_clusters(df.filter(F.col(v) >= level), min_size)
    return found.join(df.select(*axes, F.col(v).alias("v"), F.col(w).alias("w")), axes).groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("v").alias("mean"), F.max("v").alias("max"), (-F.max(F.struct("v", (-F.col("w")).alias("w"))).getField("w")).alias("w_at_max"))


def cluster_threshold(df: DataFrame, mask: str, min_size: int, v: str = "v") -> DataFrame:
    """v, zeroed where its mask cluster has at most min_size cells, or outside the mask."""
    axes = axes_of(df)
    big = component_sizes(df.filter(F.col(mask) != 0)).filter(F.col("size") > min_size).select(*axes, F.lit(1).alias("_k"))
    return df.join(big, axes, "left").select(*axes, F.when(F.col("_k").isNotNull(), F.col(v)).otherwise(0.0).alias("v"))


def fill_holes(df: DataFrame, size: dict[str, int], v: str = "v") -> DataFrame:
    """A binary image with background components that don't touch the border set to 1."""
    axes = axes_of(df)
    cc = checkpointed(connected_components(df.filter(F.col(v) == 0)))
    edge = F.lit(False)
    for a in axes:
        edge = edge | (F.col(a) == 0) | (F.col(a) == size[a] - 1)
    holes = cc.join(cc.filter(edge).select("component").distinct(), "component", "left_anti").select(*axes, F.lit(1.0).alias("_f"))
    return df.join(holes, axes, "left").select(*axes, F.coalesce("_f", F.col(v).cast("double")).alias("v"))


def distance_map(df: DataFrame, v: str = "v", spacing: tuple[float, ...] | None = None) -> DataFrame:
    """Exact Euclidean distance of each cell to the nearest cell with v != 0, axis by axis.

    Along the first axis the distance is that to the object cells before and after, by windows. Along
    each further axis it is a lower envelope of parabolas over one line, solved per line in Arrow
    batches; a line of cells, not the image, bounds a task. Cells of an image without objects are null.
    """
    axes = axes_of(df)
    step = spacing or (1.0,) * len(axes)
    a = axes[0]
    w = Window.partitionBy(*axes[1:]).orderBy(a)
    hit = F.when(F.col(v) != 0, F.col(a))
    before = F.last(hit, ignorenulls=True).over(w)
    after = F.first(hit, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    gap = F.least(F.col(a) - before, after - F.col(a))
    now = df.select(*axes, ((gap * step[0]) ** 2).cast("double").alias("d2"))
    for i, a in enumerate(axes[1:], 1):
        rest = [b for b in axes if b != a]
        now = now.groupBy(*rest).applyInArrow(_envelope(a, step[i]), now.schema)
    return now.select(*axes, F.sqrt("d2").alias("v"))


def _envelope(axis: str, step: float):
    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by(axis)
        x = table.column(axis).to_numpy().astype(float) * step
        f = np.array([np.inf if q is None else q for q in table.column("d2").to_pylist()])
        out = np.full(len(x), np.inf)
        held: list[int] = []
        cuts: list[float] = []
        for q in np.flatnonzero(np.isfinite(f)):
            s = -np.inf
            while held:
                p = held[-1]
                s = ((f[q] + x[q] ** 2) - (f[p] + x[p] ** 2)) / (2 * (x[q] - x[p]))
                if s > cuts[-1]:
                    break
                held.pop()
                cuts.pop()
            held.append(int(q))
            cuts.append(s if len(held) > 1 else -np.inf)
        if held:
            k = np.searchsorted(np.array(cuts), x, side="right") - 1
            p = np.array(held)[np.maximum(k, 0)]
            out = (x - x[p]) ** 2 + f[p]
        got = pa.array([None if np.isinf(v) else float(v) for v in out], pa.float64())
        return table.set_column(table.schema.get_field_index("d2"), "d2", got)

    return run


def signed_distance(df: DataFrame, foreground: float = 1.0, v: str = "v", spacing: tuple[float, ...] | None = None) -> DataFrame:
    """Distance to the object outside it, and minus the distance to the background inside."""
    axes = axes_of(df)
    bit = df.select(*axes, (F.col(v) == foreground).cast("int").alias("v"))
    out = distance_map(bit, "v", spacing).withColumnRenamed("v", "_o")
    ins = distance_map(bit.withColumn("v", 1 - F.col("v")), "v", spacing).withColumnRenamed("v", "_i")
    return out.join(ins, axes).select(*axes, F.when(F.col("_o") > 0, F.col("_o")).otherwise(-F.col("_i")).alias("v"))


def perona_malik(df: DataFrame, rounds: int, conductance: float = 0.25, step: float | None = None, v: str = "v") -> DataFrame:
    """Anisotropic diffusion: v += step * sum over axes of the flux differences exp(-(d / (conductance * mean |d|))^2) d."""
    axes = axes_of(df)
    dt = step if step is not None else 0.4 / 2 ** (len(axes) + 1)
    now = df.select(*axes, F.col(v).cast("double").alias("v"))
    for _ in range(rounds):
        near, parts = now, []
        for a in axes:
            w = Window.partitionBy(*[b for b in axes if b != a]).orderBy(a)
            near = near.withColumns({f"_p{a}": F.coalesce(F.lead("v").over(w) - F.col("v"), F.lit(0.0)), f"_m{a}": F.coalesce(F.lag("v").over(w) - F.col("v"), F.lit(0.0))})
            parts += [f"_p{a}", f"_m{a}"]
        near = checkpointed(near)
        mean = near.agg(F.avg(sum((F.col(p) ** 2 for p in parts), F.lit(0.0)) / len(parts)).alias("_g"))
        flux = sum((F.col(p) * F.exp(-(F.col(p) ** 2) / (2 * conductance**2 * F.greatest("_g", F.lit(1e-12)))) for p in parts), F.lit(0.0))
        now = near.crossJoin(F.broadcast(mean)).select(*axes, (F.col("v") + dt * flux).alias("v"))
    return now


def inpaint(df: DataFrame, rounds: int, v: str = "v") -> DataFrame:
    """Cells with v <= 0 filled from 3^D neighbours by inverse squared distance, repeatedly; positive cells keep their value."""
    axes = axes_of(df)
    offsets = box(axes, 1, centre=False)
    weights = [1.0 / sum(d * d for d in o) for o in offsets]
    first = checkpointed(df.select(*axes, F.col(v).cast("double").alias("v0")))
    now = first.withColumn("v", F.col("v0"))
    for _ in range(rounds):
        near = scattered(now.filter("v > 0").select(*axes, F.col("v").alias("_v")), offsets, axes, {"_k": weights}).groupBy(*axes).agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("_n"))
        now = checkpointed(now.join(near, axes, "left").select(*axes, "v0", F.when(F.col("v0") > 0, F.col("v0")).otherwise(F.coalesce("_n", "v")).alias("v")))
    return now.select(*axes, "v")


def poisson_diffusion(df: DataFrame, source: str, label: str, rounds: int = 500, threshold: float = 1e-10) -> DataFrame:
    """Smoothing by the mean of face neighbours and the cell, with source cells >= 0.2 restored and 0 outside the label, until the mean in the label rises by less than the threshold."""
    axes = axes_of(df)
    base = checkpointed(df.filter(F.col(label) != 0).select(*axes, F.col(source).cast("double").alias("s")))
    now, before = base.withColumn("v", F.col("s")), None
    offsets = [(0,) * len(axes), *faces(axes)]
    for _ in range(rounds):
        near = scattered(now.select(*axes, F.col("v").alias("_v")), offsets, axes).groupBy(*axes).agg((F.sum("_v") / len(offsets)).alias("_n"))
        now = checkpointed(now.join(near, axes).select(*axes, "s", F.when(F.col("s") >= 0.2, F.col("s")).otherwise(F.col("_n")).alias("v")))
        mean = now.agg(F.avg("v")).first()[0]
        if before is not None and mean - before < threshold:
            break
        before = mean
    return now.select(*axes, "v")


def propagate_labels(mask: DataFrame, seeds: DataFrame, rounds: int | None = None, label: str = "label") -> DataFrame:
    """(axes, label, steps): each mask cell gets the label of the seed nearest by face steps inside the mask, the least label of equals; cells unreached, or not within ``rounds`` steps, have none."""
    axes = axes_of(mask)
    cells = mask.select(*axes).distinct().withColumn("s", F.lit(1.0))
    start = seeds.select(*axes, F.lit(0.0).alias("time"), F.col(label).alias("tag"))
    got = travel(cells, start, float("inf") if rounds is None else float(rounds))
    return got.select(*axes, F.col("tag").cast(seeds.schema[label].dataType).alias("label"), F.round("time").cast("int").alias("steps"))


def staple(df: DataFrame, raters: int, rounds: int = 20, decision: str = "d", rater: str = "rater", prior: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Expectation maximisation of a binary truth: (axes, p) and (rater, sensitivity, specificity).

    Cells with one pattern of decisions share a probability, so rounds run over patterns, of which
    there are at most 2^raters, and the cells are read twice only.
    """
    axes = axes_of(df)
    pattern = df.groupBy(*axes).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rater, decision))), lambda s: s[decision].cast("string")), "").alias("pattern"))
    rows = [(r[0], r[1]) for r in pattern.groupBy("pattern").agg(F.count(F.lit(1))).collect()]
    names = sorted(r[0] for r in df.select(rater).distinct().collect())
    n = sum(c for _, c in rows)
    g = prior if prior is not None else sum(p.count("1") * c for p, c in rows) / (n * raters)
    sens, spec = [0.99999] * raters, [0.99999] * raters
    truth: dict[str, float] = {}
    for _ in range(rounds):
        for p, _c in rows:
            a, b = g, 1 - g
            for j, d in enumerate(p):
                a *= sens[j] if d == "1" else 1 - sens[j]
                b *= 1 - spec[j] if d == "1" else spec[j]
            truth[p] = a / (a + b) if a + b else 0.0
        on, off = sum(truth[p] * c for p, c in rows), sum((1 - truth[p]) * c for p, c in rows)
        sens = [sum(truth[p] * c for p, c in rows if p[j] == "1") / max(on, 1e-300) for j in range(raters)]
        spec = [sum((1 - truth[p]) * c for p, c in rows if p[j] == "0") / max(off, 1e-300) for j in range(raters)]
    spark = df.sparkSession
    held = spark.createDataFrame([(k, float(x)) for k, x in truth.items()], "pattern string, p double")
    return pattern.join(held, "pattern").select(*axes, "p"), spark.createDataFrame([(names[j], float(sens[j]), float(spec[j])) for j in range(raters)], f"rater {df.schema[rater].dataType.simpleString()}, sensitivity double, specificity double")
