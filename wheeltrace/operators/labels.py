"""Action labels once a second: signals at the seconds' centres, a priority of rules, and majority over windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.numeric import half_even
from . import temporal


def bounds(samples: DataFrame) -> DataFrame:
    """(route_id, t0, t1) of routes with at least two rows."""
    return samples.groupBy("route_id").agg(F.min("time_s").alias("t0"), F.max("time_s").alias("t1"), F.count("*").alias("_n")).filter("_n >= 2").drop("_n")


def second_centres(samples: DataFrame) -> DataFrame:
    """(route_id, s, time_s): t0 + s + 0.5 for each whole second of a route."""
    return temporal.grid(bounds(samples), start=F.col("t0") + 0.5, n=(F.col("t1") - F.col("t0")).cast("int"), step=1.0).select("route_id", "s", "time_s")


def action(v: Column, a: Column, steer: Column, brake: Column, lane_change: Column, lead: Column, distance: Column, left: Column, right: Column, th: Thresholds) -> tuple[Column, Column]:
    """(label, text of the rule): the first rule that holds. Comparisons are strict."""
    turn, blink = F.abs(steer), F.when(left != 0, left).otherwise(right)
    text = lambda x, d: F.format_string(f"%.{d}f", half_even(x, d))
    rules = [
        (v < th.stopped_speed, "Stopped", F.lit(f"vEgo<{th.stopped_speed}")),
        ((lane_change > 0) | (((left > 0) | (right > 0)) & (turn > th.blinker_steer_deg)), "LaneChange", F.concat(F.lit("lcs="), lane_change.cast("string"), F.lit(",blink="), blink.cast("string"), F.lit(",steer="), text(turn, 0))),
        (turn > th.turn_deg, "Turning", F.concat(F.lit("|steer|="), text(turn, 1), F.lit(f">{th.turn_deg}"))),
        ((a < th.brake) | (brake > 0), "Braking", F.when(a < th.brake, F.concat(F.lit("aEgo="), text(a, 2), F.lit(f"<{th.brake}"))).otherwise("brakePressed")),
        (a > th.accel, "Accelerating", F.concat(F.lit("aEgo="), text(a, 2), F.lit(f">{th.accel}"))),
        ((lead > 0) & (distance < th.lead_dist_m) & (F.abs(a) < th.follow_accel), "CarFollowing", F.concat(F.lit("lead_d="), text(distance, 0), F.lit("m"))),
    ]
    label, rule = F.lit("Cruising"), F.lit("default")
    for holds, name, why in reversed(rules):
        label, rule = F.when(holds, name).otherwise(label), F.when(holds, why).otherwise(rule)
    return label, rule


def sampled_signals(samples: DataFrame, radar: DataFrame) -> DataFrame:
    """Signals and state of the first sample at or after each second's centre; radar has a clock of its own."""
    own = temporal.asof_forward(second_centres(samples), samples, ["route_id"], cols=["v_ego", "a_ego", "steer", "brake", "lcs", "left_blinker", "state"])
    return temporal.asof_forward(own, radar, ["route_id"], cols=["lead_status", "d_rel"])


def action_labels(samples: DataFrame, radar: DataFrame, th: Thresholds) -> DataFrame:
    """(route_id, timestamp, action_label, action_source_rule, adas_active, vego, aego, steer_deg), once a second."""
    s = sampled_signals(samples, radar)
    label, rule = action(F.col("v_ego"), F.col("a_ego"), F.col("steer"), F.col("brake"), F.col("lcs"), F.coalesce("lead_status", F.lit(0)), F.coalesce("d_rel", F.lit(999.0)), F.col("left_blinker"), F.lit(0), th)
    return s.select(
        "route_id", half_even(F.col("time_s"), 1).alias("timestamp"), label.alias("action_label"), rule.alias("action_source_rule"), F.col("state").alias("adas_active"),
        half_even(F.col("v_ego"), 2).alias("vego"), half_even(F.col("a_ego"), 2).alias("aego"), half_even(F.col("steer"), 1).alias("steer_deg"),
    )


def histogram(df: DataFrame, label: str) -> DataFrame:
    """Counts of each label and their share of all rows in percent. One row for each label goes through the window."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", half_even(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def majority_windows(labels: DataFrame, route_bounds: DataFrame, th: Thresholds) -> DataFrame:
    """(route_id, start_s, end_s, label): the most frequent label of each sliding window, on a tie the one seen first.

    Each label finds its windows by arithmetic, so no range join is needed: windows end at t0 + window + k * stride. A window is made by its first
    label, which sees the labels after it in one sliding frame, so that no pairs of labels and windows are grouped or sorted."""
    size, step = th.input_window_s, th.stride_s
    b = route_bounds.filter(F.col("t1") - F.col("t0") >= size + 1).withColumn("_last", F.floor((F.col("t1") - F.col("t0") - size) / step))
    at = labels.filter("timestamp is not null").join(b, "route_id").withColumn("_x", F.col("timestamp") - F.col("t0"))
    low, high = F.greatest(F.lit(0), F.floor((F.col("_x") - size) / step) + 1), F.least(F.col("_last"), F.floor(F.col("_x") / step))
    at = at.select("route_id", "t0", "timestamp", "action_label", low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    w = W.partitionBy("route_id").orderBy("timestamp")
    at = at.withColumn("_from", F.greatest(F.col("_low"), F.coalesce(F.lag("_high").over(w) + 1, F.col("_low"))))
    at = at.withColumn("_near", F.collect_list(F.struct("_low", "action_label")).over(w.rangeBetween(0, math.ceil(size + step)))).filter("_from <= _high")
    at = at.select("route_id", "t0", "_near", F.explode(F.sequence("_from", "_high")).alias("k"))
    held = at.withColumn("_in", F.transform(F.filter("_near", lambda r: r["_low"] <= F.col("k")), lambda r: r["action_label"]))
    votes = F.transform("_in", lambda x, i: F.struct(F.size(F.filter("_in", lambda y: y.eqNullSafe(x))).alias("n"), (-i).alias("i"), x.alias("label")))
    return held.select("route_id", (F.col("t0") + F.col("k") * step).alias("start_s"), (F.col("t0") + size + F.col("k") * step).alias("end_s"), F.array_max(votes)["label"].alias("label"))
