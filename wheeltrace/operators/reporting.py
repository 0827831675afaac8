"""Aggregated results, tables, segments and feature files, text summaries and parsed answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PARSE_ORDER
from ..functions.numeric import half_even
from . import intervals

#: Metric names that tables leave out, by part of the name.
EXCLUDED = ("n_pos", "n_neg", "threshold")
GROUP = ("task", "modality", "model", "split", "horizon")


def fixed(x: Column, decimals: int) -> Column:
    """Text with that many decimals, ties to even; N/A for null and NaN."""
    return F.when(x.isNull() | F.isnan(x), "N/A").otherwise(F.format_string(f"%.{decimals}f", half_even(x, decimals) + 0.0))  # + 0.0: no negative zero


def seed_aggregate(results: DataFrame, metrics: str, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, metric, n_seeds, mean, std): over the seeds of a configuration, without excluded metrics and nulls."""
    n = results.groupBy(*group).agg(F.count("*").alias("n_seeds"))
    long = results.select(*group, F.explode(metrics).alias("metric", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    for part in EXCLUDED:
        long = long.filter(~F.col("metric").contains(part))
    return long.groupBy(*group, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).join(n, list(group))


def configuration_counts(results: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """(n_runs, n_configurations): all runs, and distinct configurations whatever their seed."""
    one = results.groupBy(*group).agg(F.count("*").alias("_n"))
    return one.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_runs"), F.count("*").alias("n_configurations"))


def report_table(aggregated: DataFrame, wanted: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """wanted configurations with one column of `mean +/- std` for each metric, a dash where there is none."""
    cell = F.concat(fixed(F.col("mean"), 4), F.lit(" +/- "), fixed(F.col("std"), 4))
    table = aggregated.withColumn("cell", cell).groupBy(*group).pivot("metric", list(metrics)).agg(F.first("cell"))
    seeds = aggregated.groupBy(*group).agg(F.max("n_seeds").alias("n_seeds"))
    return wanted.join(table, list(group), "left").join(seeds, list(group), "left").select(*group, *(F.coalesce(m, F.lit("—")).alias(m) for m in metrics), F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def segment_timing(segments: DataFrame) -> DataFrame:
    """(route_id, seg_num, start_s, end_s): running sums of durations in order of the segment's number."""
    w = W.partitionBy("route_id").orderBy("seg_num").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("duration_s").over(w)
    return segments.select("route_id", "seg_num", (end - F.col("duration_s")).alias("start_s"), end.alias("end_s"))


def frame_times(segments: DataFrame, *, fps: float = 2.0, fallback_s: float = 60.0, by_number: bool = False) -> DataFrame:
    """(route_id, seg_num, frame, time_s): frames of each segment (n_frames). A segment starts at its known start, else
    where the ones before it end (missing ones last fallback_s), or at seg_num times fallback_s if by_number."""
    w = W.partitionBy("route_id").orderBy("seg_num").rowsBetween(W.unboundedPreceding, -1)
    lasts = F.when(F.col("n_frames") > 0, F.col("n_frames") / fps).otherwise(fallback_s)
    cursor = F.col("seg_num") * fallback_s if by_number else F.coalesce(F.sum(lasts).over(w), F.lit(0.0))
    s = segments.withColumn("_start", F.coalesce("start_s", cursor)).filter("n_frames > 0")
    return s.select("route_id", "seg_num", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"), "_start").withColumn("time_s", F.col("_start") + F.col("frame") / fps).drop("_start")


def validate_features(frames: DataFrame, expected: DataFrame, *, dim: int, fps: float = 2.0) -> DataFrame:
    """For each route: frames, duration, monotonic times, valid, and a warning below half of the expected frames.
    frames: route_id, i, ts, dim; expected: route_id, duration_s."""
    w = W.partitionBy("route_id").orderBy("i")
    f = frames.withColumn("_ok", F.coalesce(F.col("ts") >= F.lag("ts").over(w), F.lit(True)))
    s = f.groupBy("route_id").agg(F.count("*").alias("n_frames"), F.max("dim").alias("_hi"), F.min("dim").alias("_lo"), (F.max_by("ts", "i") - F.min_by("ts", "i")).alias("duration_s"), F.bool_and("_ok").alias("timestamps_monotonic"))
    s = s.join(expected.withColumnRenamed("duration_s", "_d"), "route_id")
    goal = F.col("_d") * fps
    return s.select("route_id", "n_frames", "duration_s", "timestamps_monotonic", goal.cast("int").alias("expected_frames"), ((F.col("_hi") == dim) & (F.col("_lo") == dim) & F.col("timestamps_monotonic")).alias("valid"), F.coalesce((goal > 0) & (F.try_divide("n_frames", goal) < 0.5), F.lit(False)).alias("low_frame_count"))


def parse_label(text: Column) -> Column:
    """The first class name, in a fixed order, that the lower-cased text contains; else null."""
    out = F.lit(None).cast("string")
    for name in reversed(PARSE_ORDER):
        out = F.when(F.lower(text).contains(name.lower()), name).otherwise(out)
    return out


def parse_binary(text: Column) -> tuple[Column, Column]:
    """(prediction, confidence) of the first object that has both keys, in either order; 0 and 0.5 for a text without one,
    null without a text."""
    number, digit = r"([\d.]+)", "([01])"
    one = r'\{[^}]*"prediction"\s*:\s*' + digit + r'[^}]*"confidence"\s*:\s*' + number + r"[^}]*\}"
    two = r'\{[^}]*"confidence"\s*:\s*' + number + r'[^}]*"prediction"\s*:\s*' + digit + r"[^}]*\}"
    got = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    pred = F.coalesce(got(one, 1), got(two, 2)).try_cast("int")
    conf = F.coalesce(got(one, 2), got(two, 1)).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(pred, F.lit(0))), F.when(text.isNotNull(), F.coalesce(conf, F.lit(0.5)))


def positive_score(pred: Column, conf: Column) -> Column:
    return F.when(pred == 1, conf).otherwise(1 - conf)


def _snap(at: str, name: str) -> Column:
    return F.col(f"{at}.{name}")


def _vehicle_section() -> Column:
    three = lambda c: F.concat_ws(" → ", *(fixed(_snap(at, c), 1) for at in ("first", "middle", "last")))
    yes = lambda c, y, n: F.when(_snap("last", c) > 0.5, y).otherwise(n)
    text = [
        "## Vehicle (5.0s window)\nSpeed: ", three("vEgo"), " m/s | Accel: mean=", fixed(F.col("mean_aEgo"), 1), ", peak=", fixed(F.col("peak_aEgo"), 1), " m/s²\nSteering: ", three("steeringAngleDeg"),
        " deg | Brake: ", yes("brakePressed", "ON", "OFF"), " | Gas: ", fixed(_snap("last", "gas"), 2), "\nBlinkers: ", yes("leftBlinker", "left", yes("rightBlinker", "right", "none")),
        " | DAS: enabled=", yes("cruiseState_enabled", "yes", "no"), ", lat_active=", yes("cc_latActive", "yes", "no"),
    ]
    return _joined(text)


def _radar_section() -> Column:
    lead = lambda n, *more: F.when(_snap("last", f"lead{n}_status") > 0.5, _joined(["detected, dist=", fixed(_snap("last", f"lead{n}_dRel"), 1), "m", *more])).otherwise("not detected")
    return _joined(["## Lead Vehicle\nLead #1: ", lead("One", ", rel_speed=", fixed(_snap("last", "leadOne_vRel"), 1), " m/s"), "\nLead #2: ", lead("Two")])


def _driver_section() -> Column:
    of = lambda c, d: fixed(_snap("last", c), d)
    return _joined(["## Driver State\nFace: detected (", of("faceProb", 2), ") | Yaw: ", of("face_yaw", 1), "° Pitch: ", of("face_pitch", 1), "°\nEyes: L=", of("leftEyeProb", 2), " R=", of("rightEyeProb", 2)])


def _planning_section() -> Column:
    state = F.coalesce(_snap("last", "laneChangeState").try_cast("double").try_cast("int"), F.lit(0))
    return _joined(["## Planning\nDesired curvature: ", fixed(_snap("last", "model_desiredCurvature"), 3), " | Lane change: ", F.when(state == 0, "none").otherwise(F.concat(F.lit("state="), state.cast("string"))), "\nLane conf: L=", fixed(_snap("last", "laneLeft_prob"), 2), " R=", fixed(_snap("last", "laneRight_prob"), 2)])


def _imu_section() -> Column:
    axes = lambda kind, d: F.concat_ws(" ", *(_joined([f"{x}=", fixed(F.col(f"mean_{kind}_{x}"), d)]) for x in "xyz"))
    return _joined(["## IMU\nAccel: ", axes("accel", 1), " | Gyro: ", axes("gyro", 2)])


def _joined(parts: Sequence[Column | str]) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


#: Sections in their order: stream, columns that are read at single times, columns that are averaged, text.
SECTIONS = (
    ("vehicle_dynamics", ("vEgo", "steeringAngleDeg", "brakePressed", "gas", "leftBlinker", "rightBlinker", "cruiseState_enabled", "cc_latActive"), ("aEgo",), _vehicle_section),
    ("radar", ("leadOne_status", "leadOne_dRel", "leadOne_vRel", "leadTwo_status", "leadTwo_dRel"), (), _radar_section),
    ("driver_state", ("faceProb", "face_yaw", "face_pitch", "leftEyeProb", "rightEyeProb"), (), _driver_section),
    ("planning", ("model_desiredCurvature", "laneChangeState", "laneLeft_prob", "laneRight_prob"), (), _planning_section),
    ("imu", (), ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z"), _imu_section),
)
UNAVAILABLE = "[Sensor data unavailable]"


def sensor_context(windows: DataFrame, streams: Mapping[str, DataFrame], *, margin: float = 0.5) -> DataFrame:
    """(route_id, start_s, end_s, context): a text of each window, with a section for each stream that has rows in the window and
    its margins, in the order of SECTIONS. Values at the start, middle and end are those of the nearest such row, on a tie the one
    that comes first in its stream (i); streams have route_id, i, time_s and their modality's columns, of which missing ones take 0.

    One range join and one aggregation with partial sums for each stream; the sections of a window, five at most, meet in one more."""
    w = windows.select("route_id", "start_s", "end_s").distinct()
    probe = w.withColumn("_lo", F.col("start_s") - margin).withColumn("_hi", F.col("end_s") + margin)
    times = {"first": F.col("start_s"), "middle": (F.col("start_s") + F.col("end_s")) / 2, "last": F.col("end_s")}
    keys, sections = ["route_id", "start_s", "end_s"], None
    for place, (name, single, averaged, text) in enumerate(SECTIONS):
        if name not in streams:
            continue
        have = set(streams[name].columns)
        rows = streams[name].select("route_id", "i", "time_s", *(F.col(c) if c in have else F.lit(0.0).alias(c) for c in (*single, *averaged)))
        near = intervals.interval_join(rows, probe, ["route_id"], t="time_s", low="_lo", high="_hi", bucket=8.0)
        means = [half_even(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))), 8).alias(f"mean_{c}") for c in averaged]
        peaks = [F.max(F.nanvl(F.abs(c).cast("double"), F.lit(None))).alias(f"peak_{c}") for c in averaged if c == "aEgo"]
        snaps = [F.min_by(F.struct(*single), F.struct(F.abs(F.col("time_s") - t), "i")).alias(at) for at, t in times.items()] if single else []
        one = near.groupBy(*keys).agg(*means, *peaks, *snaps).select(*keys, F.struct(F.lit(place).alias("place"), text().alias("text")).alias("_s"))
        sections = one if sections is None else sections.unionAll(one)
    if sections is None:
        return w.withColumn("context", F.lit(UNAVAILABLE))
    whole = sections.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_s")).select(*keys, F.array_join(F.transform("_s", lambda s: s.text), "\n\n").alias("context"))
    return w.join(whole, keys, "left").select(*keys, F.coalesce("context", F.lit(UNAVAILABLE)).alias("context"))


def road_context(row_type: Column, limit: Column, lanes: Column, highway: Column, near: Column, dist: Column, ramp: Column, curvature: Column, rate: Column) -> Column:
    """A text of the road around a row; missing numbers are 0, a missing type is `unknown`."""
    zero = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")), 0.0).otherwise(c.cast("double"))
    yes = lambda c: F.when(zero(c) > 0.5, "yes").otherwise("no")
    return F.concat(F.lit("## Road Context\nRoad: "), F.coalesce(row_type, F.lit("unknown")), F.lit(" | Limit: "), fixed(zero(limit), 0), F.lit(" km/h | Lanes: "), zero(lanes).cast("int").cast("string"), F.lit("\nHighway: "), yes(highway), F.lit(" | Intersection: "), yes(near), F.lit(" (dist="), fixed(zero(dist), 0), F.lit("m) | On-ramp: "), yes(ramp), F.lit("\nCurvature: "), fixed(zero(curvature), 3), F.lit(" | Heading change: "), fixed(zero(rate), 1), F.lit(" deg/s"))


def messages(system: Column, user: Column, images: Column) -> Column:
    """array<struct<role, content>> for a model call: the text and base64 images; the call itself is outside."""
    return F.array(F.struct(F.lit("system").alias("role"), F.array(system).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.array(user), F.transform(images, lambda b: F.concat(F.lit("data:image/jpeg;base64,"), F.base64(b)))).alias("content")))


def one_hot(label: Column, classes: Sequence[str]) -> Column:
    """Scores of all classes: 1 for the label, else 0; all 0 for an unknown one."""
    return F.array(*(F.coalesce((label == c).cast("double"), F.lit(0.0)) for c in classes))


def file_name(route_id: Column) -> Column:
    """A route id as a file's name, and back by route_of."""
    return F.replace(route_id, F.lit("/"), F.lit("__"))


def route_of(name: Column) -> Column:
    return F.replace(name, F.lit("__"), F.lit("/"))
