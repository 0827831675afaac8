"""GPS traces: cleaning, quality, smoothing, trajectory features, lookahead, and sparse values filled forward."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import geo
from ..functions.numeric import half_even

KEYS = ("route_id",)
MATCH_ROWS = 20  #: fewest valid rows of a route that is matched with a road graph


def clean(raw: DataFrame, th: Thresholds, keys: Sequence[str] = KEYS) -> DataFrame:
    """Valid rows of the route's better receiver (phone, else device) without jumps; routes that keep 10 rows or more."""
    whole = W.partitionBy(*keys)
    seen = lambda c: (F.count(c).over(whole) > 10) & (F.count_if(F.col(c).isNull() | (F.col(c) != 0)).over(whole) > 10)
    rows = raw.withColumn("_phone", seen("phone_lat")).withColumn("_device", seen("lat"))
    phone = F.col("_phone")
    rows = rows.filter(F.when(phone, F.col("phone_lat").isNotNull() & (F.col("phone_lat") != 0)).when(F.col("_device"), F.col("lat").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0) & F.col("hacc").isNotNull() & (F.col("hacc") < th.gps_hacc_m)).otherwise(False))
    pick = lambda a, b: F.when(phone, F.col(a)).otherwise(F.col(b))
    rows = rows.select(*keys, "i", "time_s", pick("phone_lat", "lat").alias("lat"), pick("phone_lon", "lon").alias("lon"), pick("phone_speed", "speed").alias("gps_speed"), pick("phone_hacc", "hacc").alias("gps_hacc"), F.when(phone, "phone").otherwise("device").alias("source"))
    w = W.partitionBy(*keys).orderBy("time_s", "i")
    moved = F.greatest(F.abs(F.col("lat") - F.lag("lat").over(w)), F.abs(F.col("lon") - F.lag("lon").over(w)))
    rows = rows.withColumn("_n", F.count("*").over(whole)).withColumn("_moved", moved).filter((F.col("_n") >= 10) & (F.col("_moved").isNull() | (F.col("_moved") <= th.gps_jump_deg)))
    return rows.withColumn("_n", F.count("*").over(whole)).filter("_n >= 10").drop("_n", "_moved")


def quality(raw: DataFrame, cleaned: DataFrame, th: Thresholds) -> DataFrame:
    """For each route: source, rows, coverage, median accuracy and position, jumps and tier; enough_rows tells whether it can be
    matched with a road graph (MATCH_ROWS valid rows or more)."""
    w = W.partitionBy(*KEYS).orderBy("time_s", "i")
    far = (F.abs(F.col("lat") - F.lag("lat").over(w)) > th.gps_quality_jump_deg) | (F.abs(F.col("lon") - F.lag("lon").over(w)) > th.gps_quality_jump_deg)
    own = cleaned.withColumn("_far", far).groupBy(*KEYS).agg(F.min("source").alias("gps_source"), F.count("*").alias("valid_rows"), F.median("gps_hacc").alias("_m"), F.median("lat").alias("_lat"), F.median("lon").alias("_lon"), F.count_if("_far").alias("n_jumps"))
    q = raw.groupBy(*KEYS).agg(F.count("*").alias("total_rows")).join(own, list(KEYS), "left")
    share = F.col("valid_rows") / F.col("total_rows")
    tier = F.when(F.col("valid_rows").isNull(), "none").when((share > 0.9) & (F.col("n_jumps") < 5), "good").when(share > 0.5, "moderate").otherwise("poor")
    return q.select(*KEYS, F.coalesce("gps_source", F.lit("none")).alias("gps_source"), "total_rows", F.coalesce("valid_rows", F.lit(0)).alias("valid_rows"), half_even(F.coalesce(share, F.lit(0.0)), 4).alias("coverage_frac"), half_even(F.col("_m"), 2).alias("median_hacc"), F.coalesce("n_jumps", F.lit(0)).alias("n_jumps"), tier.alias("quality_tier"), half_even(F.col("_lat"), 6).alias("lat_center"), half_even(F.col("_lon"), 6).alias("lon_center"), (F.coalesce("valid_rows", F.lit(0)) >= MATCH_ROWS).alias("enough_rows"))


def bounding_box(cleaned: DataFrame, buffer_m: float = 500.0, *, max_span_km: float = 50.0, radius_m: float = 5_000.0) -> DataFrame:
    """Box around each route's points within 1.5 times the 5-95 % range of both coordinates, with a buffer; routes with 10 such
    points. A box that spans more than max_span_km either way gives way to one of radius_m around the points' median."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))
    fence = cleaned.groupBy(*KEYS).agg(q("lat").alias("qa"), q("lon").alias("qo"))
    inside = lambda c, p: F.col(c).between(F.col(p)[0] - 1.5 * (F.col(p)[1] - F.col(p)[0]), F.col(p)[1] + 1.5 * (F.col(p)[1] - F.col(p)[0]))
    kept = cleaned.join(fence, list(KEYS)).filter(inside("lat", "qa") & inside("lon", "qo"))
    box = kept.groupBy(*KEYS).agg(F.count("*").alias("n_points"), F.max("lat").alias("n"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.min("lon").alias("w"), F.avg("lat").alias("m"), F.median("lat").alias("y"), F.median("lon").alias("x")).filter("n_points >= 10")
    flat = F.cos(F.radians("m"))
    tall, wide = F.lit(buffer_m / geo.DEGREE_M), F.lit(buffer_m) / (geo.DEGREE_M * flat)
    box = box.select("*", (F.col("n") + tall).alias("north"), (F.col("s") - tall).alias("south"), (F.col("e") + wide).alias("east"), (F.col("w") - wide).alias("west"))
    km = geo.DEGREE_M / 1000
    far = ((F.col("north") - F.col("south")) * km > max_span_km) | ((F.col("east") - F.col("west")) * km * flat > max_span_km)
    up, aside = F.lit(radius_m / geo.DEGREE_M), F.lit(radius_m) / (geo.DEGREE_M * F.cos(F.radians("y")))
    near = {"north": F.col("y") + up, "south": F.col("y") - up, "east": F.col("x") + aside, "west": F.col("x") - aside}
    return box.select(*KEYS, "n_points", *(half_even(F.when(far, v).otherwise(F.col(c)), 6).alias(c) for c, v in near.items()))


def savgol_weights(size: int = 11, degree: int = 2) -> np.ndarray:
    """The hat matrix of a polynomial fit: row r smooths the r-th of `size` values."""
    x = np.vander(np.arange(size) - size // 2, degree + 1).astype(float)
    return np.round(x @ np.linalg.inv(x.T @ x) @ x.T, 12)


def smooth(df: DataFrame, columns: Sequence[str], *, size: int = 11, degree: int = 2, keys: Sequence[str] = KEYS, order: Sequence[str] = ("time_s", "i"), suffix: str = "_s") -> DataFrame:
    """Columns smoothed by a centred Savitzky-Golay filter; ends take the fit of the first or last window; routes shorter
    than the window stay as they are.

    One sliding window gathers the values around each row, of all columns; the filter is the product of `size` of them with the row of
    the hat matrix for the row's place in its fit, the middle one but at a route's ends."""
    w, half = W.partitionBy(*keys).orderBy(*order), size // 2
    hat = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in savgol_weights(size, degree)))
    df = df.withColumn("_row", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys))).withColumn("_near", F.collect_list(F.struct(*columns)).over(w.rowsBetween(1 - size, size - 1)))
    first = F.greatest(F.lit(0), F.least(F.col("_row") - half, F.col("_n") - size))  # of the fit
    df = df.withColumn("_hat", F.get(hat, (F.col("_row") - first).cast("int"))).withColumn("_near", F.slice("_near", (first - F.greatest(F.lit(0), F.col("_row") - (size - 1)) + 1).cast("int"), size))
    fit = lambda c: F.aggregate(F.zip_with(F.transform("_near", lambda x: x[c]), "_hat", lambda v, h: v * h), F.lit(0.0), lambda s, x: s + x)
    return df.withColumns({c + suffix: F.when(F.col("_n") < size, F.col(c)).otherwise(fit(c)) for c in columns}).drop("_row", "_n", "_near", "_hat")


def trajectory(cleaned: DataFrame, th: Thresholds) -> DataFrame:
    """Heading, its rate of change, curvature, speed and stopped time at each row, from the smoothed trace."""
    w = W.partitionBy(*KEYS).orderBy("time_s", "i")
    p = smooth(cleaned, ["lat", "lon"])
    lag = lambda c, k=1: F.lag(c, k).over(w)
    back = geo.bearing(lag("lat_s"), lag("lon_s"), F.col("lat_s"), F.col("lon_s"))
    step = geo.haversine(lag("lat_s"), lag("lon_s"), F.col("lat_s"), F.col("lon_s"))
    dt = F.col("time_s") - lag("time_s")
    p = p.withColumn("_rn", F.row_number().over(w)).withColumn("_dt", dt).withColumn("_h", back).withColumn("_v", F.when(F.col("_dt") > 0, step / F.col("_dt")).otherwise(0.0))
    first = lambda c: F.when(F.col("_rn") == 1, F.coalesce(F.lead(c).over(w), F.lit(0.0))).otherwise(F.col(c))
    p = p.withColumn("heading", first("_h")).withColumn("_v", first("_v"))
    p = p.withColumn("rate", F.when((F.col("_rn") > 1) & (F.col("_dt") > 0), geo.turn(F.col("heading"), lag("heading")) / F.col("_dt")).otherwise(0.0))
    lat0, lon0 = F.first("lat_s").over(w), F.first("lon_s").over(w)
    p = p.withColumn("x_m", (F.col("lon_s") - lon0) * (geo.DEGREE_M * F.cos(F.radians(lat0)))).withColumn("y_m", (F.col("lat_s") - lat0) * geo.DEGREE_M)
    bend = geo.menger(lag("x_m", 2), lag("y_m", 2), lag("x_m"), lag("y_m"), F.col("x_m"), F.col("y_m"))
    p = p.withColumn("curve", F.when(F.col("_rn") > 2, bend).otherwise(0.0))
    speed = F.when(F.col("gps_speed").isNotNull() & ~F.isnan("gps_speed") & (F.col("gps_speed") >= 0), F.col("gps_speed")).otherwise(F.col("_v"))
    p = smooth(p.withColumn("speed", speed), ["rate"]).withColumn("stopped", (F.col("speed") < th.stopped_speed).cast("int"))
    since = F.last(F.when((F.col("stopped") == 0) | (F.col("_rn") == 1), F.col("time_s")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return p.select(*KEYS, "i", "time_s", half_even(F.col("heading"), 2).alias("heading_deg"), half_even(F.col("rate_s"), 4).alias("heading_change_rate"), half_even(F.col("curve"), 6).alias("curvature"), half_even(F.col("speed"), 3).alias("traj_speed_mps"), F.col("stopped").alias("is_stopped"), half_even(F.col("time_s") - since, 2).alias("stopped_duration_s"))


def maneuvers(traj: DataFrame, th: Thresholds, *, hz: int = 10) -> DataFrame:
    """The next turn and stop ahead of each row. Turns are sought once for each block of hz rows, from its first row: the
    first of 5 to 30 seconds (of hz rows) at which the heading has turned enough. A growing heading is called a left turn."""
    w = W.partitionBy(*KEYS).orderBy("time_s", "i")
    t = traj.withColumn("_rn", F.row_number().over(w) - 1)
    slow = F.max((F.col("traj_speed_mps") < th.stopped_speed).cast("int")).over(w.rowsBetween(0, 10 * hz - 1))
    turns = F.array(*(F.struct(geo.turn(F.lead("heading_deg", s * hz).over(w), F.col("heading_deg")).alias("d"), (F.lead("time_s", s * hz).over(w) - F.col("time_s")).alias("dt")) for s in range(5, 31)))
    t = t.withColumn("stop_within_10s", slow).withColumn("_t", F.when(F.col("_rn") % hz == 0, F.try_element_at(F.filter(turns, lambda x: F.abs(x["d"]) > th.turn_lookahead_deg), F.lit(1))))
    block = W.partitionBy(*KEYS, F.floor(F.col("_rn") / hz))
    t = t.withColumn("_b", F.max_by("_t", F.when(F.col("_rn") % hz == 0, F.lit(1))).over(block))
    d, dt = F.col("_b.d"), F.col("_b.dt")
    kind = F.when(d > 0, "left_turn").when(d.isNotNull(), "right_turn").otherwise("straight")
    return t.select(*KEYS, "i", "time_s", kind.alias("next_maneuver_type"), half_even(dt, 2).alias("time_to_next_maneuver_s"), F.coalesce((dt <= 10).cast("int"), F.lit(0)).alias("turn_within_10s"), d.isNotNull().cast("int").alias("turn_within_30s"), "stop_within_10s")


def sparse_fill(df: DataFrame, column: str, *, every: int = 10, out: str) -> DataFrame:
    """`column` taken at every `every`-th row and the last one of a route, filled forward in between."""
    w = W.partitionBy(*KEYS).orderBy("time_s", "i")
    last = F.count("*").over(W.partitionBy(*KEYS))
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_last", last)
    taken = F.when(((F.col("_rn") - 1) % every == 0) | (F.col("_rn") == F.col("_last")), F.col(column))
    return df.withColumn(out, F.last(taken, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_rn", "_last")
