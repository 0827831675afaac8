"""Windowed samples before events: positives, negatives with buffers, caps, strata and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from . import temporal
from .lineage import cut


def eligible(bounds: DataFrame, horizon: float, th: Thresholds) -> DataFrame:
    return bounds.filter(F.col("t1") - F.col("t0") >= th.input_window_s + horizon + 1)


def positives(events: DataFrame, changes: DataFrame, bounds: DataFrame, *, horizon: float, state: int, th: Thresholds) -> DataFrame:
    """(route_id, start_s, end_s, nearest_event_s): window ends up to `horizon` before each event, every stride, at which
    the raw state is `state`. The same window may lead to two events."""
    e = events.select("route_id", F.col("time_s").alias("ev")).join(eligible(bounds, horizon, th), "route_id")
    first = F.greatest(F.col("t0") + th.input_window_s, F.col("ev") - horizon)
    e = e.withColumn("_first", first).filter("_first <= ev").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ev") - F.col("_first")) / th.stride_s))))
    probes = e.select("route_id", (F.col("_first") + F.col("k") * th.stride_s).alias("time_s"), "ev")
    at = temporal.asof_backward(probes, changes, ["route_id"], cols=["state"])
    return at.filter(F.col("state") == state).select("route_id", (F.col("time_s") - th.input_window_s).alias("start_s"), F.col("time_s").alias("end_s"), F.col("ev").alias("nearest_event_s"))


def hash_order(seed: int, *cols: str) -> Column:
    """A portable pseudorandom order: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)).cast("binary"))


SUBSET = 50_000  #: windows of a bounded subset
PREFIX = 4  #: hexadecimal digits of the hash that form a range: 65,536 ranges


def bounded_subset(df: DataFrame, ids: Sequence[str], k: int = SUBSET, seed: int = 42) -> DataFrame:
    """The k rows with the smallest hashes of `ids` (all, if there are fewer): the same rows at each run. Ranges of the hash are counted first, at most
    65,536 numbers; whole ranges stay or go, and only the range in which the k-th row lies is sorted."""
    rows = df.withColumn("_h", hash_order(seed, *ids)).withColumn("_r", F.left("_h", F.lit(PREFIX)))
    n = rows.groupBy("_r").agg(F.count("*").alias("_k"))
    before = n.select("_r", "_k", F.coalesce(F.sum("_k").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")).filter(F.col("_before") < k)
    rows = rows.join(F.broadcast(before), "_r")  # at most 65,536 rows
    inside = rows.filter(F.col("_before") + F.col("_k") <= k)
    edge = rows.filter(F.col("_before") + F.col("_k") > k)
    edge = edge.withColumn("_rn", F.row_number().over(W.partitionBy("_r").orderBy("_h", *ids))).filter(F.col("_before") + F.col("_rn") <= k)
    return inside.select(*df.columns).union(edge.select(*df.columns))


def negatives(events: DataFrame, segments: DataFrame, bounds: DataFrame, *, horizon: float, state: int, th: Thresholds, seed: int = 42) -> DataFrame:
    """(route_id, start_s, end_s): window ends inside segments of `state`, every negative stride, with no event from
    buffer before to horizon + buffer after; on routes that have events, capped by a hash order for each route."""
    counts = events.groupBy("route_id").agg(F.count("*").alias("_events"))
    seg = segments.filter(F.col("state") == state).join(eligible(bounds, horizon, th), "route_id").join(counts, "route_id")
    first, last = F.greatest(F.col("start_s"), F.col("t0")) + th.input_window_s, F.col("end_s") - horizon
    seg = seg.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    grid = seg.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / th.negative_stride_s))))
    probes = grid.select("route_id", "_events", (F.col("_first") + F.col("k") * th.negative_stride_s).alias("end_s")).withColumn("time_s", F.col("end_s") - th.negative_buffer_s)
    near = temporal.asof_forward(probes, events.select("route_id", "time_s", F.lit(0).alias("i")), ["route_id"], cols=["i"], clamp=False, at="next_s")
    free = near.filter(F.col("next_s").isNull() | (F.col("next_s") > F.col("end_s") + horizon + th.negative_buffer_s))
    cap = F.least(F.col("_events") * int(horizon / th.stride_s) * th.cap_factor, F.lit(th.cap_max))
    free = free.withColumn("_tick", F.rint(F.col("end_s") * 1000).cast("long"))
    order = W.partitionBy("route_id").orderBy(hash_order(seed, "route_id", "_tick"), "_tick")
    return free.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).select("route_id", (F.col("end_s") - th.input_window_s).alias("start_s"), "end_s")


def prediction_rows(found: DataFrame, none: DataFrame, routes: DataFrame, *, prefix: str, horizon: float, state: int, th: Thresholds) -> DataFrame:
    """The samples of a prediction task as they are published: positives and negatives of a horizon with their routes' columns, numbered in the order
    of routes; within a route positives by event and end, then negatives by end. routes: route_id and what is known of each route."""
    rows = found.withColumn("label", F.lit(1)).unionByName(none.withColumn("label", F.lit(0)), allowMissingColumns=True)
    ids = temporal.sequential_ids(cut(rows), "route_id", [F.col("label").desc(), "nearest_event_s", "end_s"], prefix=prefix, width=7, name="sample_id")
    known = [c for c in routes.columns if c != "route_id"]
    return ids.join(routes, "route_id").select(
        "sample_id", "route_id", F.col("start_s").alias("start_time_sec"), F.col("end_s").alias("end_time_sec"), F.lit(float(th.input_window_s)).alias("input_window_sec"), F.lit(float(horizon)).alias("horizon_sec"),
        "label", F.lit(state).alias("current_adas_state"), F.col("nearest_event_s").alias("nearest_event_time"), *known,
    )


def stratified(samples: DataFrame, *, strata: str, per_stratum: int, min_gap: float, seed: int = 42) -> DataFrame:
    """At most per_stratum samples of each stratum, after thinning each route's to min_gap apart, by a hash order."""
    thin = temporal.greedy_gap(samples.select(strata, "route_id", "start_s").distinct(), [strata, "route_id"], "start_s", min_gap)
    thin = thin.withColumn("_tick", F.rint(F.col("start_s") * 1000).cast("long"))
    order = W.partitionBy(strata).orderBy(hash_order(seed, "route_id", "_tick"), "route_id", "_tick")
    return thin.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_stratum).select(strata, "route_id", "start_s")


def quota(samples: DataFrame, *, total: int, least_positive: int = 20, min_gap: float = 5.0, seed: int = 42) -> DataFrame:
    """A sample of binary windows (route_id, start_s, label) that keeps the share of positives, with least_positive of them
    at least; each label's windows are thinned to min_gap apart first. A label that falls short gives all it has."""
    rate = samples.agg(F.avg("label").alias("_rate"))  # one row
    goal = F.greatest((F.col("_rate") * total).cast("int"), F.lit(least_positive))
    thin = temporal.greedy_gap(samples.select("label", "route_id", "start_s").distinct(), ["label", "route_id"], "start_s", min_gap)
    thin = thin.withColumn("_tick", F.rint(F.col("start_s") * 1000).cast("long")).crossJoin(F.broadcast(rate))
    order = W.partitionBy("label").orderBy(hash_order(seed, "route_id", "_tick"), "route_id", "_tick")
    return thin.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.when(F.col("label") == 1, goal).otherwise(total - goal)).select("label", "route_id", "start_s")


def first_frames(windows: DataFrame, frames: DataFrame, *, k: int, bucket: float = 8.0) -> DataFrame:
    """(route_id, start_s, slot, feature): the first k frames in [start, end) of each window, zeros where there are fewer."""
    from . import intervals

    inside = intervals.interval_join(frames, windows, ["route_id"], t="time_s", low="start_s", high="end_s", bucket=bucket, closed=False)
    slot = F.row_number().over(W.partitionBy("route_id", "start_s").orderBy("time_s")) - 1
    inside = inside.withColumn("slot", slot).filter(F.col("slot") < k).select("route_id", "start_s", "slot", "feature")
    frame = windows.select("route_id", "start_s").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return frame.join(inside, ["route_id", "start_s", "slot"], "left").select("route_id", "start_s", "slot", F.coalesce("feature", F.lit(0.0)).alias("feature"))


def frame_offsets(windows: DataFrame, offsets=(0.5, 2.5, 4.5), segment_s: float = 60.0) -> DataFrame:
    """(route_id, start_s, offset_s, segment, seek_s): where each representative frame of a window lies; a window that
    occurs twice counts once."""
    t = F.col("start_s") + F.col("offset_s")
    return windows.select("route_id", "start_s").distinct().withColumn("offset_s", F.explode(F.array(*map(F.lit, offsets)))).select("route_id", "start_s", "offset_s", F.floor(t / segment_s).cast("int").alias("segment"), (t % segment_s).alias("seek_s"))


def duration_picks(routes: DataFrame, buckets: int = 1024) -> DataFrame:
    """(pick, route_id): the shortest, the middle and the longest route, for smoke runs. routes: route_id, duration_s. Ranks come from the
    numbers of rows in equal ranges of duration, so only the middle row's range is sorted."""
    ends = routes.agg(F.min("duration_s").alias("_lo"), F.max("duration_s").alias("_hi"), F.count("*").alias("_n"))  # one row
    order = lambda: F.struct("duration_s", "route_id")
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    rows = routes.crossJoin(F.broadcast(ends)).withColumn("_b", F.least(F.floor((F.col("duration_s") - F.col("_lo")) / span * buckets), F.lit(buckets - 1)))
    held = rows.groupBy("_b").agg(F.count("*").alias("_held"), F.first("_n").alias("_n"))
    held = held.withColumn("_before", F.sum("_held").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_held"))  # a row for each range
    middle = held.withColumn("_at", F.floor(F.col("_n") / 2) - F.col("_before")).filter("_at >= 0 and _at < _held").select("_b", "_at")
    ranked = rows.join(F.broadcast(middle), "_b").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("duration_s", "route_id")) - 1)
    first, last = (f(order()).alias("m") for f in (F.min, F.max))
    pick = lambda name, df: df.filter("m is not null").select(F.lit(name).alias("pick"), F.col("m.route_id").alias("route_id"))
    found = pick("short", routes.agg(first)).withColumn("_k", F.lit(0)).unionByName(ranked.filter("_r = _at").select(F.lit("median").alias("pick"), "route_id", F.lit(1).alias("_k"))).unionByName(pick("long", routes.agg(last)).withColumn("_k", F.lit(2)))
    one = W.partitionBy("route_id").orderBy("_k")  # a route that is two of them counts as the first
    return found.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select("pick", "route_id")
