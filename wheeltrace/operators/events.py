"""From state samples to control-transition events and route summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.numeric import half_even
from . import temporal

KEYS = ("route_id",)


def engaged(samples: DataFrame, lateral: str = "cc_lat", cruise: str = "cruise_en") -> DataFrame:
    """samples with state 1 where either flag is exactly 1 (missing is 0)."""
    on = F.coalesce((F.col(lateral) == 1) | (F.col(cruise) == 1), F.lit(False))
    return samples.withColumn("state", on.cast("int"))


def long_enough(samples: DataFrame, min_rows: int, keys=KEYS) -> DataFrame:
    """Samples of routes that have at least min_rows rows."""
    return samples.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter(F.col("_n") >= min_rows).drop("_n")


def episodes(samples: DataFrame, th: Thresholds) -> DataFrame:
    """Debounced episodes, without those too short for their state, neighbours of equal state merged."""
    runs = temporal.debounced_runs(samples, KEYS, min_samples=int(th.debounce_s * th.sample_rate))
    whole = temporal.merged_runs(runs, KEYS)
    seconds = F.col("n") / th.sample_rate
    kept = whole.filter(F.when(F.col("state") == 1, seconds >= th.min_adas_s).otherwise(seconds >= th.min_human_s))
    return temporal.merged_runs(kept, KEYS)


def transitions(samples: DataFrame, th: Thresholds) -> DataFrame:
    """(route_id, event_type, time_s): activations and takeovers, each type at least min_event_gap_s apart."""
    eps = episodes(samples, th)
    w = W.partitionBy(*KEYS).orderBy("start_s")
    turned = eps.withColumn("_was", F.lag("state").over(w)).filter(F.col("_was").isNotNull() & (F.col("_was") != F.col("state")))
    found = turned.select(*KEYS, F.when(F.col("state") == 1, "activation").otherwise("takeover").alias("event_type"), F.col("start_s").alias("time_s"))
    return temporal.greedy_gap(found, [*KEYS, "event_type"], "time_s", th.min_event_gap_s)


def numbered(events: DataFrame) -> DataFrame:
    """Events with sequential ids by type: ACT_00001..., TAKE_00001..."""
    parts = [temporal.sequential_ids(events.filter(F.col("event_type") == kind), "route_id", ["time_s"], prefix=prefix, width=5, name="event_id") for kind, prefix in (("activation", "ACT"), ("takeover", "TAKE"))]
    return parts[0].unionByName(parts[1])


def state_changes(samples: DataFrame) -> DataFrame:
    """(route_id, i, time_s, state): the first sample and every raw change of state."""
    w = W.partitionBy(*KEYS).orderBy("time_s", "i")
    was = F.lag("state").over(w)
    return samples.withColumn("_was", was).filter(F.col("_was").isNull() | (F.col("_was") != F.col("state"))).select(*KEYS, "i", "time_s", "state")


def state_segments(samples: DataFrame) -> DataFrame:
    """(route_id, start_s, end_s, state) of the raw state; the last one ends with the route."""
    ends = samples.groupBy(*KEYS).agg(F.max("time_s").alias("_end"))
    w = W.partitionBy(*KEYS).orderBy("time_s", "i")
    return state_changes(samples).withColumn("_next", F.lead("time_s").over(w)).join(ends, list(KEYS)).select(*KEYS, F.col("time_s").alias("start_s"), F.coalesce("_next", "_end").alias("end_s"), "state")


def driving_mode(share: Column, th: Thresholds) -> Column:
    return F.when(share >= th.adas_dominant, "ADAS-dominant").when(share <= th.human_only, "Human-only").otherwise("Mixed")


def route_summary(samples: DataFrame, th: Thresholds) -> DataFrame:
    """One row for each route: duration, share of assisted driving, numbers of events and the driving mode."""
    facts = samples.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), (F.max("time_s") - F.min("time_s")).alias("_d"), F.avg("state").alias("_share"))
    events = transitions(samples, th).groupBy(*KEYS).agg(F.count_if(F.col("event_type") == "activation").alias("_a"), F.count_if(F.col("event_type") == "takeover").alias("_t"))
    return facts.join(events, list(KEYS), "left").select(
        *KEYS, "n_rows", half_even(F.col("_d"), 1).alias("duration_s"), half_even(F.col("_share"), 4).alias("adas_frac"),
        F.coalesce("_a", F.lit(0)).alias("n_activations"), F.coalesce("_t", F.lit(0)).alias("n_takeovers"), driving_mode(F.col("_share"), th).alias("driving_mode"),
    )
