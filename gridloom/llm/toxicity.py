"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector shared by ordered thresholds. x marks which
hashed words a text holds, so a long clean text gains nothing by its length. The expected severity is
the sum of P(grade >= k) over the thresholds; a text is toxic where P(grade >= 1) is over a half.

The fit takes a bounded sample: the ``SAMPLE`` labelled documents of each class that come first by a
hash of their key, and of their words those whose frequency differs between the classes by over
``MIN_Z`` standard errors. The grades come from the labels alone, never from the features: 0 is not toxic,
1 toxic, 2 toxic in a text labelled of good quality, which other filters would let pass. Scoring reads
all texts.

Edge cases: null or empty text has no features and grade 0 by the thresholds; labels that are null or
repeated with different values are left out; labels without a quality, or with several, are no grade 2,
and the upper threshold then lies far above; without both classes every severity is 0; words of equal
standing are taken in order of their bucket; a very long text counts by its distinct words; repeated
rows give repeated scores; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import built, checkpointed, text_bytes
from gridloom.llm.decontaminate import TABLE

SAMPLE = 3000
BUCKETS = 1 << 20
MIN_Z = 5.0
MIN_DOCS = 3
MAX_FEATURES = 2000
STEPS, RATE, RIDGE = 600, 0.1, 1e-3


class Buckets(dict):
    """Words to their buckets; one for each task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = zlib.crc32(word) % BUCKETS
        return out


def features(text: bytes, buckets: Buckets) -> set[int]:
    """The distinct buckets of a text's words."""
    return {buckets[w] for w in set(text.translate(TABLE).split())}


def fit_ordinal(x: np.ndarray, grade: np.ndarray, steps: int = STEPS, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds for grades 0..top (the highest there is), by Adam on the penalised likelihood.

    Thresholds are a first one and positive steps (exponentials), so their order always holds.
    """
    top = int(grade.max()) if top is None else top
    weights = np.bincount(grade, minlength=top + 1)[grade].astype(float)
    weights = (1 / weights) / (1 / weights).sum()  # classes count alike
    p = np.zeros(x.shape[1] + top)
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    reach = np.arange(top)[None, :]
    for t in range(1, steps + 1):
        w, a = p[: x.shape[1]], p[x.shape[1] :]
        theta = np.cumsum(np.r_[a[:1], np.exp(np.clip(a[1:], -10, 10))])
        over = sigmoid((x @ w)[:, None] - theta)  # P(grade >= k + 1)
        ext = np.c_[np.ones(len(x)), over, np.zeros(len(x))]
        rows = np.arange(len(x))
        prob = np.maximum(ext[rows, grade] - ext[rows, grade + 1], 1e-12)
        slope = np.c_[np.zeros(len(x)), over * (1 - over), np.zeros(len(x))]
        g = weights / prob
        dz = -g * (slope[rows, grade] - slope[rows, grade + 1])
        # of each threshold: the lower bound of its own grade, the upper bound of the grade below
        dtheta = ((g[:, None] * slope[:, 1:-1]) * ((grade[:, None] == reach + 1).astype(float) - (grade[:, None] == reach).astype(float))).sum(0)
        tail = np.cumsum(dtheta[::-1])[::-1]
        da = np.r_[tail[:1], tail[1:] * np.exp(np.clip(a[1:], -10, 10))]
        grad = np.r_[x.T @ dz + RIDGE * w, da]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    a = p[x.shape[1] :]
    return p[: x.shape[1]], np.cumsum(np.r_[a[:1], np.exp(np.clip(a[1:], -10, 10))])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, quality: str = "quality") -> tuple[dict[int, float], list[float]]:
    """(bucket to weight, thresholds); both empty without both classes."""
    good = (F.col(quality).cast("int") == 1 if quality in labels.columns else F.lit(False)).cast("int")
    clean = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), F.coalesce(good, F.lit(0)).alias("good")).filter("key IS NOT NULL AND y IN (0, 1)")
    clean = clean.groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.min("good").alias("good")).filter("y = z").select("key", "y", (F.col("y") * F.col("good")).alias("more"))
    first = lambda y: clean.filter(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(sample)
    some = first(0).union(first(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([sorted(features(t, buckets)) for t in text_bytes(b.column(3))], pa.list_(pa.int32()))], ["key", "y", "more", "f"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "key").select("key", "y", "more", "text")  # at most 2 * sample rows
    found = checkpointed(rows.mapInArrow(run, f"key {kind}, y int, more int, f array<int>"))
    n = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    if len(n) < 2:
        return {}, []
    held = found.select("y", F.explode("f").alias("b")).groupBy("b").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    share = (F.col("c1") + F.col("c0")) / sum(n.values())
    z = F.abs(F.col("c1") / n[1] - F.col("c0") / n[0]) / F.sqrt(F.greatest(share * (1 - share) * (1 / n[1] + 1 / n[0]), F.lit(1e-12)))
    marked = held.withColumn("z", z).filter((F.col("c1") + F.col("c0") >= MIN_DOCS) & (F.col("z") >= MIN_Z))
    chosen = np.sort([r["b"] for r in marked.orderBy(F.desc("z"), "b").limit(MAX_FEATURES).collect()]).astype(int)
    if not len(chosen):
        return {}, []
    # of each sampled document its chosen words: at most MAX_FEATURES numbers
    got = found.select("key", "y", "more", F.array_intersect("f", F.lit(chosen.tolist())).alias("f")).toPandas().sort_values("key")
    x = np.array([np.isin(chosen, f) for f in got["f"]], float)
    w, theta = fit_ordinal(x, (got["y"] + got["more"]).to_numpy(int), top=2)
    return {int(b): float(v) for b, v in zip(chosen, w, strict=True)}, [float(v) for v in theta]


def severity(weights: dict[int, float], thresholds: list[float], text: bytes, buckets: Buckets) -> tuple[float, float]:
    """(expected severity, P(grade >= 1))."""
    if not thresholds:
        return 0.0, 0.0
    s = sum(weights[b] for b in features(text, buckets) if b in weights)
    p = [1 / (1 + np.exp(min(60.0, max(-60.0, t - s)))) for t in thresholds]
    return float(sum(p)), float(p[0])


def score(docs: DataFrame, weights: dict[int, float], thresholds: list[float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, severity, p_toxic, grade (severity rounded), toxic. The model has at most MAX_FEATURES weights, so it is broadcast."""
    held, token = docs.sparkSession.sparkContext.broadcast((weights, thresholds)), str(uuid.uuid4())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, theta), buckets = built(token, lambda: held.value), Buckets()
        for b in batches:
            got = [severity(w, theta, t, buckets) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["key", "severity", "p_toxic"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, severity double, p_toxic double")
    return out.select(F.col("key").alias(key), "severity", "p_toxic", F.round("severity").cast("int").alias("grade"), (F.col("p_toxic") > 0.5).alias("toxic"))
