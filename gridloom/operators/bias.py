"""Bias fields: a smooth factor of the image, found by sharpening its log histogram.

Each round sums one histogram, sharpens it on the driver (its bins are a parameter), maps each cell to
its expected true value, and fits a B-spline to what the map took away. The field is one control
lattice a level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of
from gridloom.operators import spline
from gridloom.plans.lineage import checkpointed


def sharpened(counts: np.ndarray, step: float, fwhm: float, noise: float) -> np.ndarray:
    """Of each bin centre, the expected value before blur by a gaussian of the given width: Wiener deconvolution of the histogram, then the mean of the true values under each observed one."""
    n = len(counts)
    size = 1 << int(np.ceil(np.log2(n)) + 1)
    pad = (size - n) // 2
    v = np.zeros(size)
    v[pad : pad + n] = counts
    sigma = max(fwhm / step / (2 * np.sqrt(2 * np.log(2))), 1e-6)
    k = np.arange(size)
    k = np.minimum(k, size - k)
    g = np.exp(-(k**2) / (2 * sigma**2))
    blur = np.fft.fft(g / g.sum())
    wiener = np.conj(blur) / (np.abs(blur) ** 2 + noise)
    u = np.maximum(np.fft.ifft(np.fft.fft(v) * wiener).real, 0)
    x = np.arange(size) - pad
    above = np.fft.ifft(np.fft.fft(u * x) * blur).real
    below = np.fft.ifft(np.fft.fft(u) * blur).real
    return np.where(np.abs(below) > 1e-10, above / np.where(np.abs(below) > 1e-10, below, 1), x)[pad : pad + n]


def _mapped(r: Column, lo: float, step: float, expected: np.ndarray) -> Column:
    """The expected value of r, linear between bin centres."""
    held = F.lit([float(lo + e * step) for e in expected])
    t = F.greatest(F.lit(0.0), F.least(F.lit(float(len(expected) - 1)), (r - lo) / step))
    k = F.least(F.floor(t), F.lit(len(expected) - 2)).cast("int")
    return held[k] * (1 - (t - k)) + held[k + 1] * (t - k)


def _rounds(base: DataFrame, axes: list[str], spans: list[int], rounds: list[int], bins: int, fwhm: float, noise: float, threshold: float) -> spline.Spline:
    """base: axes and log; the field of the log image, a level for each of ``spans``."""
    lo, hi = spline.box_of(base, axes)
    here = [F.col(a) for a in axes]
    field = spline.Spline(lo, hi, 1)
    for n, most in zip(spans, rounds, strict=True):
        control = np.zeros((*(n + 3,) * len(axes), 1))
        field.levels.append(((n,) * len(axes), control))
        for _ in range(most):
            rest = base.withColumn("r", F.col("log") - field.column(here)[0])
            a, b = rest.agg(F.min("r"), F.max("r")).first()
            if a is None or b - a < 1e-12:
                return field
            step = (b - a) / (bins - 1)
            t = (F.col("r") - a) / step
            k = F.floor(t).cast("int")
            split = F.explode(F.array(F.struct(k.alias("k"), (1 - (t - k)).alias("w")), F.struct((k + 1).alias("k"), (t - k).alias("w"))))
            counts = np.zeros(bins + 1)
            for row in rest.select(split.alias("s")).groupBy("s.k").agg(F.sum("s.w").alias("w")).collect():
                counts[row["k"]] = row["w"]
            took = rest.withColumn("d", F.col("r") - _mapped(F.col("r"), a, step, sharpened(counts[:bins], step, fwhm, noise)))
            more = spline.fit(took, axes, ["d"], lo, hi, (n,) * len(axes))
            control += more.levels[0][1]
            # how far the round moved the field, as the variation of its factor
            moved = took.select(F.exp(more.column(here)[0]).alias("m")).agg(F.stddev_samp("m") / F.avg("m")).first()[0]
            if moved is not None and moved < threshold:
                break
    return field


def correct(df: DataFrame, levels: int = 4, rounds: int = 50, spans: int = 1, bins: int = 200, fwhm: float = 0.15, noise: float = 0.01, threshold: float = 1e-3, mask: str | None = None, v: str = "v") -> DataFrame:
    """(axes, v, field): the image divided by its bias field; levels double the spans. Positive cells (of mask > 0, where one is given) shape the field, all cells are divided."""
    axes = axes_of(df)
    use = df.filter(F.col(v) > 0)
    use = use.filter(F.col(mask) > 0) if mask else use
    base = checkpointed(use.select(*axes, F.log(F.col(v).cast("double")).alias("log")))
    field = _rounds(base, axes, [spans << k for k in range(levels)], [rounds] * levels, bins, fwhm, noise, threshold)
    out = df.select(*axes, F.col(v).cast("double").alias("v"), F.exp(field.column([F.col(a) for a in axes])[0]).alias("field"))
    return out.withColumn("v", F.col("v") / F.col("field"))


def correct_single(df: DataFrame, spans: int = 4, rounds: int = 50, bins: int = 200, fwhm: float = 0.15, noise: float = 0.1, threshold: float = 1e-3, mask: str | None = None, v: str = "v") -> DataFrame:
    """The older form: one lattice, no levels."""
    return correct(df, 1, rounds, spans, bins, fwhm, noise, threshold, mask, v)
