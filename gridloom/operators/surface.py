"""Level sets, simple points and smoothing that stays inside a mask: windows and neighbour sums over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of, box, faces, scattered
from gridloom.operators.neighborhood import central_differences
from gridloom.plans.lineage import checkpointed


def curvature(df: DataFrame, v: str = "v") -> DataFrame:
    """Curvatures of the level set through each cell, from central differences: in 2-D kappa; in 3-D mean and gaussian. 0 where the gradient vanishes."""
    axes = axes_of(df)
    first = central_differences(df.select(*axes, F.col(v).cast("double").alias("v")))
    both = first
    for a in axes:
        d = central_differences(first.select(*axes, F.col(f"g{a}").alias("v"))).select(*axes, *[F.col(f"g{b}").alias(f"g{a}{b}") for b in axes])
        both = both.join(d, axes)
    g = {a: F.col(f"g{a}") for a in axes}
    h = lambda a, b: (F.col(f"g{a}{b}") + F.col(f"g{b}{a}")) / 2
    size2 = sum((x**2 for x in g.values()), F.lit(0.0))
    ok = size2 > 1e-12
    bent = sum((g[a] * g[b] * h(a, b) for a in axes for b in axes), F.lit(0.0))
    trace = sum((h(a, a) for a in axes), F.lit(0.0))
    mean = (size2 * trace - bent) / F.pow(size2, F.lit(1.5))
    if len(axes) == 2:
        return both.select(*axes, F.when(ok, mean).otherwise(0.0).alias("kappa"))
    x, y, z = axes
    # the adjugate of the second derivatives between the gradients
    adj = {(x, x): h(y, y) * h(z, z) - h(y, z) ** 2, (y, y): h(x, x) * h(z, z) - h(x, z) ** 2, (z, z): h(x, x) * h(y, y) - h(x, y) ** 2}
    adj |= {(x, y): h(x, z) * h(y, z) - h(x, y) * h(z, z), (x, z): h(x, y) * h(y, z) - h(x, z) * h(y, y), (y, z): h(x, y) * h(x, z) - h(y, z) * h(x, x)}
    total = sum((g[a] * g[b] * q * (1 if a == b else 2) for (a, b), q in adj.items()), F.lit(0.0))
    return both.select(*axes, F.when(ok, mean / 2).otherwise(0.0).alias("mean"), F.when(ok, total / size2**2).otherwise(0.0).alias("gaussian"))


#: The neighbours of a cell in 2-D, around it.
_RING = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def topological_numbers(df: DataFrame, v: str = "v") -> DataFrame:
    """(x, y, number, simple) of the nonzero cells of a 2-D image: the components of the object around a cell that touch it (by corners); a cell is simple, so that its removal changes no topology, where that is 1."""
    on = df.filter(F.col(v) != 0).select("x", "y")
    near = scattered(on, _RING, ["x", "y"], {"_k": list(range(8))}).groupBy("x", "y").agg(F.collect_set("_k").alias("_s"))
    bit = lambda k: F.array_contains("_s", k % 8).cast("int")
    rows = on.join(near, ["x", "y"], "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<int>")))
    number = sum(((1 - bit(k)) - (1 - bit(k)) * (1 - bit(k + 1)) * (1 - bit(k + 2)) for k in (0, 2, 4, 6)), F.lit(0))
    return rows.select("x", "y", number.cast("bigint").alias("number")).withColumn("simple", (F.col("number") == 1).cast("bigint"))


def smooth_in_mask(df: DataFrame, mask: str, rounds: int = 1, v: str = "v") -> DataFrame:
    """v with each mask cell replaced by the mean of itself and its face neighbours in the mask, repeatedly; other cells stay."""
    axes = axes_of(df)
    now = checkpointed(df.filter(F.col(mask) != 0).select(*axes, F.col(v).cast("double").alias("v")))
    offsets = [(0,) * len(axes), *faces(axes)]
    for _ in range(rounds):
        near = scattered(now.withColumnRenamed("v", "_v"), offsets, axes).groupBy(*axes).agg(F.avg("_v").alias("v"), F.max("_self").alias("_in"))
        now = checkpointed(near.filter("_in").drop("_in"))
    return df.select(*axes, F.col(v).cast("double").alias("_o")).join(now, axes, "left").select(*axes, F.coalesce("v", "_o").alias("v"))


def masked_gaussian(df: DataFrame, mask: str, sigma: float, v: str = "v") -> DataFrame:
    """Gaussian smoothing that reads mask cells only, weights rescaled; 0 outside the mask. A time axis is smoothed as any other."""
    from gridloom.operators.neighborhood import _kernel

    axes = axes_of(df)
    out = df.filter(F.col(mask) != 0).select(*axes, F.col(v).cast("double").alias("v"))
    for a in axes:
        weights = _kernel(sigma)
        offsets = [tuple(d if b == a else 0 for b in axes) for d, _ in weights]
        rows = scattered(out.withColumnRenamed("v", "_v"), offsets, axes, {"_k": [w for _, w in weights]})
        out = rows.groupBy(*axes).agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("v"), F.max("_self").alias("_in")).filter("_in").drop("_in")
    return df.select(*axes).join(out, axes, "left").select(*axes, F.coalesce("v", F.lit(0.0)).alias("v"))


def skeleton(df: DataFrame, rounds: int = 100, v: str = "v") -> DataFrame:
    """(x, y) left of a 2-D object when simple border cells go from the four sides in turn until none does; end points stay."""
    now = checkpointed(df.filter(F.col(v) != 0).select("x", "y", F.lit(1).alias("v")))
    for _ in range(rounds):
        before = now.count()
        for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0)):
            for parity in (0, 1):
                there = now.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(1).alias("_t"))
                count = scattered(now.select("x", "y"), box(["x", "y"], 1, centre=False), ["x", "y"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("_c"))
                marks = topological_numbers(now).join(there, ["x", "y"], "left").join(count, ["x", "y"], "left")
                # cells of one parity along the side are judged at once: they don't touch along it
                along = F.col("x") if dy else F.col("y")
                gone = marks.filter((F.col("simple") == 1) & F.col("_t").isNull() & (F.coalesce("_c", F.lit(0)) > 1) & (F.pmod(along, F.lit(2)) == parity))
                now = checkpointed(now.join(gone.select("x", "y"), ["x", "y"], "left_anti"))
        if now.count() == before:
            break
    return now.select("x", "y")
