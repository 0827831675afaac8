"""Range joins of points with intervals by buckets, and duplicates, sets and listings that jobs resume from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], *, t: str, low: str, high: str, bucket: float, closed: bool = True) -> DataFrame:
    """Points and intervals of equal keys with low <= t <= high (or t < high). Intervals go to all buckets that they
    touch, points to one, so the join is an equal join on (keys, bucket)."""
    p = points.withColumn("_b", F.floor(F.col(t) / bucket))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    inside = (F.col(t) >= F.col(low)) & ((F.col(t) <= F.col(high)) if closed else (F.col(t) < F.col(high)))
    return p.join(i, [*keys, "_b"]).filter(inside).drop("_b")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def matrix_todo(dims: dict[str, Sequence[str]], done: DataFrame) -> DataFrame:
    """All combinations of the dimensions' values that are not in done. Its size is the product of short literal lists."""
    spark, out = done.sparkSession, None
    for name, values in dims.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} string")
        out = one if out is None else out.crossJoin(one)
    return out.join(done.select(*dims).distinct(), list(dims), "left_anti")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
