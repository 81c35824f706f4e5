"""Point sets: nearest neighbours by buckets, densities, divergences, and correspondences of blobs.

A point is compared with those in its own and the touching buckets only; buckets are as wide as the
reach of the kernel, so what lies further off has no weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = ("px", "py")


def _near(points: DataFrame, targets: DataFrame, reach: float, p: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, p.., to, q.., d, and the kept columns of both as a_ and b_) of pairs within reach."""
    n = len(p)
    cell = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    offsets: list[tuple[int, ...]] = [()]
    for _ in range(n):
        offsets = [(*o, d) for o in offsets for d in (-1, 0, 1)]
    around = F.explode(F.array(*[F.struct(*[(cell(c) + d).alias(f"_{i}") for i, (c, d) in enumerate(zip(p, o, strict=True))]) for o in offsets]))
    left = points.select("id", *p, *[F.col(k).alias(f"a_{k}") for k in keep], around.alias("_c")).select("id", *p, *[f"a_{k}" for k in keep], "_c.*")
    right = targets.select(F.col("id").alias("to"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(p)], *[F.col(k).alias(f"b_{k}") for k in keep], *[cell(c).alias(f"_{i}") for i, c in enumerate(p)])
    d2 = F.lit(0.0)
    for i, c in enumerate(p):
        d2 = d2 + (F.col(c) - F.col(f"q{i}")) ** 2
    return left.join(right, [f"_{i}" for i in range(n)]).withColumn("d", F.sqrt(d2)).filter(F.col("d") <= reach).drop(*[f"_{i}" for i in range(n)])


def neighbours(points: DataFrame, targets: DataFrame, k: int, reach: float, p: tuple[str, ...] = P) -> DataFrame:
    """(id, rank from 1, to, d): the k nearest targets within reach, of equal ones (to nine digits) the least id."""
    got = _near(points, targets, reach, p).withColumn("d", F.round("d", 9)).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "to"))), 1, k).alias("n"))  # a bucket's points bound the list
    return got.select("id", F.posexplode("n").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.to").alias("to"), F.col("x.d").alias("d"))


def _kernel(d: Column, sigma: float, n: int) -> Column:
    import math

    return F.exp(-(d**2) / (2 * sigma**2)) / (2 * math.pi * sigma**2) ** (n / 2)


def density(points: DataFrame, samples: DataFrame, sigma: float, p: tuple[str, ...] = P) -> DataFrame:
    """(id, density): the mean of gaussian kernels at the samples within four sigmas."""
    n = samples.agg(F.count(F.lit(1)).alias("_n"))
    got = _near(points, samples, 4 * sigma, p).groupBy("id").agg(F.sum(_kernel(F.col("d"), sigma, len(p))).alias("s"))
    return points.select("id").join(got, "id", "left").crossJoin(F.broadcast(n)).select("id", (F.coalesce("s", F.lit(0.0)) / F.col("_n")).alias("density"))


def expectation(points: DataFrame, targets: DataFrame, sigma: float, p: tuple[str, ...] = P) -> DataFrame:
    """(id, e0.., d): the targets' mean around each point, weighted by a gaussian of their distance, and the point's distance to it."""
    w = F.exp(-(F.col("d") ** 2) / (2 * sigma**2))
    got = _near(points, targets, 4 * sigma, p).groupBy("id", *p).agg(F.sum(w).alias("_w"), *[(F.sum(w * F.col(f"q{i}")) / F.sum(w)).alias(f"e{i}") for i in range(len(p))])
    d2 = F.lit(0.0)
    for i, c in enumerate(p):
        d2 = d2 + (F.col(c) - F.col(f"e{i}")) ** 2
    return got.select("id", *[f"e{i}" for i in range(len(p))], F.sqrt(d2).alias("d"))


def pse(points: DataFrame, targets: DataFrame, sigma: float, p: tuple[str, ...] = P) -> DataFrame:
    """The point-set expectation metric: the mean distance of the points to what they expect."""
    return expectation(points, targets, sigma, p).agg(F.avg("d").alias("metric"), F.count(F.lit(1)).alias("n"))


def jhct(points: DataFrame, targets: DataFrame, sigma: float, alpha: float = 2.0, p: tuple[str, ...] = P) -> DataFrame:
    """The Jensen divergence of order alpha (Havrda, Charvat and Tsallis) of two point sets' densities: of the pooled set less the mean of each one's own; alpha 1 is Shannon's."""
    tag = lambda df, s: df.select(F.concat_ws(":", F.lit(s), F.col("id").cast("string")).alias("id"), *p)
    a, b = tag(points, "a"), tag(targets, "b")
    pooled = a.union(b)

    def entropy(df: DataFrame, name: str) -> DataFrame:
        f = F.col("density")
        value = -F.avg(F.log(F.greatest(f, F.lit(1e-300)))) if alpha == 1 else (1 - F.avg(F.pow(f, F.lit(alpha - 1)))) / (alpha - 1)
        return density(df, df, sigma, p).agg(value.alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    one = entropy(pooled, "h").crossJoin(entropy(a, "ha")).crossJoin(entropy(b, "hb"))  # one row each
    return one.select((F.col("h") - (F.col("n_ha") * F.col("ha") + F.col("n_hb") * F.col("hb")) / F.col("n_h")).alias("metric"))


def jhct_by_label(points: DataFrame, targets: DataFrame, sigma: float, labels: list[int], alpha: float = 2.0, p: tuple[str, ...] = P) -> DataFrame:
    """The divergence of each label's points, and its mean over labels is the labelled metric."""
    parts = [jhct(points.filter(F.col("label") == k), targets.filter(F.col("label") == k), sigma, alpha, p).select(F.lit(k).cast("bigint").alias("label"), "metric") for k in labels]
    out = parts[0]
    for q in parts[1:]:
        out = out.union(q)
    return out


def igdm(points: DataFrame, targets: DataFrame, reach: float, sigma: float, sigma_value: float, p: tuple[str, ...] = P) -> DataFrame:
    """Intensity and gradient mean squares: each point against its nearest target, by value and gradient, weighted by their distance; points: id, p.., value, g0.."""
    g = tuple(f"g{i}" for i in range(len(p)))
    pairs = _near(points, targets, reach, p, ("value", *g))
    best = pairs.groupBy("id").agg(F.min(F.struct("d", "to", *[F.col(f"{s}_{c}") for c in ("value", *g) for s in "ab"])).alias("b")).select("id", "b.*")
    gap = (F.col("a_value") - F.col("b_value")) ** 2
    turn = F.lit(0.0)
    for c in g:
        turn = turn + (F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2
    w = F.exp(-(F.col("d") ** 2) / (2 * sigma**2)) * F.exp(-gap / (2 * sigma_value**2))
    return best.agg((F.sum(w * (gap + turn)) / F.sum(w)).alias("metric"), F.count(F.lit(1)).alias("n"))


def match_blobs(a: DataFrame, b: DataFrame, features: list[str], scale: float, rounds: int = 2) -> DataFrame:
    """(a, b, p): correspondences of two bounded lists of blobs (id and features, at most the blob detector's number): similarities exp(-distance / scale) normalised by columns and rows in turn, each a's best b that has it as its best a."""
    one = a.select(F.col("id").alias("a"), *[F.col(f).alias(f"a_{f}") for f in features])
    two = b.select(F.col("id").alias("b"), *[F.col(f).alias(f"b_{f}") for f in features])
    d2 = F.lit(0.0)
    for f in features:
        d2 = d2 + (F.col(f"a_{f}") - F.col(f"b_{f}")) ** 2
    pairs = one.crossJoin(F.broadcast(two)).select("a", "b", F.exp(-F.sqrt(d2) / scale).alias("p"))  # lists of a detector's top n
    for _ in range(rounds):
        for side in ("b", "a"):
            pairs = pairs.join(pairs.groupBy(side).agg(F.sum("p").alias("_s")), side).select("a", "b", (F.col("p") / F.col("_s")).alias("p"))
    best = lambda x, y: pairs.groupBy(x).agg(F.max(F.struct("p", (-F.col(y)).alias("n"))).alias("m")).select(x, (-F.col("m.n")).alias(y))
    return pairs.join(best("a", "b"), ["a", "b"]).join(best("b", "a"), ["a", "b"])


def shortest_paths(edges: DataFrame, source: int, rounds: int | None = None) -> DataFrame:
    """(node, distance) of the nodes that a source reaches over edges (u, v, cost); only nodes that came nearer send on."""
    from gridloom.plans.lineage import checkpointed

    held = checkpointed(edges.select("u", "v", F.col("cost").cast("double").alias("cost")))
    now = held.sparkSession.createDataFrame([(source, 0.0)], f"node {held.schema['u'].dataType.simpleString()}, distance double")
    front, k = now, 0
    while rounds is None or k < rounds:
        k += 1
        got = front.join(held, front["node"] == held["u"]).groupBy(F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("cost")).alias("new"))
        front = checkpointed(got.join(now, "node", "left").filter(F.col("distance").isNull() | (F.col("new") < F.col("distance") - 1e-12)).select("node", F.col("new").alias("distance")))
        if front.isEmpty():
            break
        now = checkpointed(now.join(front.select("node"), "node", "left_anti").unionByName(front))
    return now


def network_measures(edges: DataFrame, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """(node, degree, rank): of an undirected graph (u, v) the number of neighbours and the page rank."""
    from gridloom.plans.lineage import checkpointed

    both = checkpointed(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    degree = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    n = degree.count()
    now = degree.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        sent = both.join(now, both["u"] == now["node"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("_in"))
        now = checkpointed(degree.join(sent, "node").select("node", "degree", ((1 - damping) / n + damping * F.col("_in")).alias("rank")))
    return now

