"""Scalars, statistics, sketches, samples and user functions over tables: thin, typed helpers on Spark's own functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dimensions(text: str | Column) -> Column:
    """Numbers of an ``AxBxC`` text, in any case and with blanks; what isn't a number is null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(F.lower(F.trim(c)), "x"), lambda x: F.trim(x).try_cast("double"))


def option(text: str | Column) -> tuple[Column, Column]:
    """Name and arguments of a ``Name[a,b]`` text."""
    c = F.col(text) if isinstance(text, str) else text
    inside = F.regexp_extract(c, r"\[(.*)\]", 1)
    return F.lower(F.substring_index(c, "[", 1)), F.when(inside != "", F.split(inside, ",")).otherwise(F.array().cast("array<string>"))


def summary(df: DataFrame, v: str, w: str, by: list[str]) -> DataFrame:
    """Per group: n, mean, variance (n - 1), skewness and excess kurtosis (over n), and the correlation and slope of two columns; one aggregation."""
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.corr(v, w).alias("r"), F.regr_slope(v, w).alias("slope"))


def approximate(df: DataFrame, v: str, key: str, by: list[str], shares: tuple[float, ...] = (0.05, 0.5, 0.95), accuracy: int = 100_000, rsd: float = 0.02) -> DataFrame:
    """Per group quantiles and the number of distinct keys by sketches of bounded size."""
    return df.groupBy(*by).agg(F.percentile_approx(v, list(shares), accuracy).alias("q"), F.approx_count_distinct(key, rsd).alias("distinct"))


def sample(df: DataFrame, share: float, seed: int, key: list[str]) -> DataFrame:
    """The rows whose digest of seed and key lies under a share: the same rows on any partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < share * 2**32)


def json_numbers(text: str, fields: list[str]) -> Column:
    """A map of the fields' numbers in a JSON text; absent and other ones are left out."""
    held = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    return F.map_filter(F.transform_values(held, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull() & k.isin(fields))


@F.pandas_udf(T.DoubleType())
def soft_clip(v: pd.Series, limit: pd.Series) -> pd.Series:
    """A user function over Arrow batches: v pressed into (-limit, limit)."""
    return v / (1 + (v / limit).abs())


@F.pandas_udf(T.DoubleType())
def trimmed_mean(v: pd.Series) -> float:
    """A user aggregate: the mean without the tenth at each end."""
    x = v.dropna().sort_values()
    k = len(x) // 10
    return float(x.iloc[k : len(x) - k].mean()) if len(x) else float("nan")


@F.udtf(returnType="start bigint, stop bigint, length bigint")
class Runs:
    """A user table function: the runs of consecutive numbers in a sorted array."""

    def eval(self, numbers: list) -> Iterator[tuple[int, int, int]]:
        start = last = None
        for n in numbers or []:
            if last is None or n != last + 1:
                if last is not None:
                    yield start, last, last - start + 1
                start = n
            last = n
        if last is not None:
            yield start, last, last - start + 1
