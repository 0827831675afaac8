"""Dataset splits by prefix sums over shuffled keys, their event counters, and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .samples import hash_order


def split_by_key(routes: DataFrame, key: str, *, seed: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(key, part): keys in a shuffled order go to train until it holds its share of routes, then to val, then to test.
    Running sums are taken within hash buckets (leading hex digits of the order) and over the buckets' totals, so no task
    orders all keys."""
    counts = routes.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    sums = counts.groupBy("_b").agg(F.sum("_n").alias("_s"))
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_s").over(W.partitionBy()).alias("_all"))
    within = W.partitionBy("_b").orderBy("_h", key)
    counts = counts.withColumn("_in", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).join(F.broadcast(sums), "_b")  # at most 256 rows
    goal, goal_val = (F.col("_all") * train).cast("long"), (F.col("_all") * val).cast("long")
    counts = counts.withColumn("_before", F.col("_in") + F.col("_off")).withColumn("_train", F.col("_before") < goal).withColumn("_goal_val", goal_val)
    held = counts.agg(F.sum(F.when(F.col("_train"), F.col("_n")).otherwise(0)).alias("_held"))  # one row
    part = F.when(F.col("_train"), "train").when(F.col("_before") - F.col("_held") < F.col("_goal_val"), "val").otherwise("test")
    return counts.crossJoin(F.broadcast(held)).withColumn("part", part).select(key, "part")


def split_random(routes: DataFrame, route: str, *, seed: int, train: float = 0.7, val: float = 0.15, buckets: int = 256) -> DataFrame:
    """(route, part) by rank in a shuffled order. Ranks are counted within hash buckets (leading hex digits of the order)
    and offset by the buckets before, so no task sorts all routes."""
    rows = routes.select(route).withColumn("_h", hash_order(seed, route)).withColumn("_b", F.substring("_h", 1, 2))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", route)) - 1
    rows = rows.withColumn("_rank", rank).join(F.broadcast(before), "_b")  # at most 256 rows
    at, n_train, n_val = F.col("_rank") + F.col("_before"), (F.col("_all") * train).cast("long"), (F.col("_all") * val).cast("long")
    return rows.select(route, F.when(at < n_train, "train").when(at < n_train + n_val, "val").otherwise("test").alias("part"))


def counters(routes: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Routes and events of each part. routes: key, n_activations, n_takeovers."""
    return routes.join(parts, key).groupBy("part").agg(F.count("*").alias("n_routes"), F.sum("n_activations").alias("n_activations"), F.sum("n_takeovers").alias("n_takeovers"))


def leakage(routes: DataFrame, parts: DataFrame, route: str, keys: list[str]) -> DataFrame:
    """For each key column: its values, and how many of them lie in more than one part."""
    found = None
    for key in keys:
        spread = routes.join(parts, route).groupBy(key).agg(F.countDistinct("part").alias("_parts"))
        one = spread.agg(F.count("*").alias("n_values"), F.count_if(F.col("_parts") > 1).alias("n_leaking")).select(F.lit(key).alias("key"), "n_values", "n_leaking")
        found = one if found is None else found.unionByName(one)
    return found
