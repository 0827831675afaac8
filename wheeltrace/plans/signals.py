"""Queries on resampled signals, GPS traces, road graphs, metrics and reports, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MODALITIES, SIGNAL_DEFAULTS, Thresholds, columns_of
from ..functions import geo
from ..functions.numeric import half_even
from ..operators import features, gps, intervals, labels, metrics, reporting, roadgraph, temporal
from ..operators.lineage import cut
from ..sources import views

TH = Thresholds(sample_rate=2.0)
GRAPH = replace(TH, intersection_degree=5)
HZ = 4
MODALITY = "Full-Struct"
CLASSES = ("click", "error", "purchase", "refund", "signup", "view")


def _round(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), d) for c in cols})


def resample_linear_grid(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.resample(views.irregular(spark, d), step=12.0, value="value"), "value")


CHANNELS = ("v_ego", "steer", "a_ego", "d_rel", "left_blinker")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """Five channels of every third sample at 5 Hz, in chunks of 64 rows."""
    return features.pack(views.uniform(spark, d).filter("i % 3 = 0"), CHANNELS, step=0.2, chunk=64)


def resample_channels(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.unpack(_packed(spark, d), CHANNELS, chunk=64), "time_s", *CHANNELS, d=3)


def packed_window_slices(spark: SparkSession, d: str) -> DataFrame:
    """Sum (in thousandths), first and last value of each channel in windows of 100 rows, cut out of the packed table."""
    w = features.packed_slices(_windows(spark, d), cut(_packed(spark, d)), len(CHANNELS), length=100, chunk=64)
    cells = F.transform("data", lambda x: half_even(x.cast("double"), 3))
    own = lambda k: F.filter("_c", lambda x, i: i % len(CHANNELS) == k)
    w = w.withColumn("_c", cells)
    sums = [F.aggregate(own(k), F.lit(0).cast("long"), lambda a, b: a + F.rint(b * 1000).cast("long")).alias(f"{c}_sum") for k, c in enumerate(CHANNELS)]
    return w.select("route_id", "start_s", *sums, *(F.element_at("_c", k + 1).alias(f"{c}_first") for k, c in enumerate(CHANNELS)), *(F.element_at("_c", k - len(CHANNELS)).alias(f"{c}_last") for k, c in enumerate(CHANNELS)))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """A window every four seconds from a route's start, the last ones beyond its end."""
    b = labels.bounds(views.uniform(spark, d))
    return temporal.grid(b, start=F.col("t0"), n=F.floor((F.col("t1") - F.col("t0")) / 4) + 1, step=4.0, name="start_s", index="w").select("route_id", "start_s")


def window_slice_padded(spark: SparkSession, d: str) -> DataFrame:
    return features.window_slices(_windows(spark, d), views.uniform(spark, d), ["v_ego", "a_ego"], step=0.5, length=10, t0=F.lit(0.0))


def window_stats(spark: SparkSession, d: str) -> DataFrame:
    s = features.window_stats(window_slice_padded(spark, d), ["v_ego", "a_ego"])
    return _round(s, *(c for c in s.columns if c not in ("route_id", "start_s")), d=8)


def norm_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.norm_stats(views.table(spark, d, "embeddings"), "embedding"), "mean", "std")


def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings")
    z = features.zscore(e, features.norm_stats(e, "embedding"), "vec_id", "embedding")
    return _round(z.select("vec_id", F.posexplode("z").alias("dim", "z")), "z", d=5)


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.class_weights(views.table(spark, d, "events"), "event_type", CLASSES, TH.max_weight), "weight")


def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"))
    return _round(features.pos_weight(e, "y", TH.max_weight), "pos_weight", "tree_weight")


def gps_clean(spark: SparkSession, d: str) -> DataFrame:
    return gps.clean(views.gps(spark, d), TH)


def gps_quality(spark: SparkSession, d: str) -> DataFrame:
    return gps.quality(views.gps(spark, d), gps_clean(spark, d), TH)


def gps_bbox(spark: SparkSession, d: str) -> DataFrame:
    return gps.bounding_box(gps_clean(spark, d))


def savgol_smooth(spark: SparkSession, d: str) -> DataFrame:
    return _round(gps.smooth(gps_clean(spark, d), ["lat", "lon"]).select("route_id", "i", "lat_s", "lon_s"), "lat_s", "lon_s", d=7)


def gps_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return gps.trajectory(gps_clean(spark, d), TH)


def maneuver_lookahead(spark: SparkSession, d: str) -> DataFrame:
    return gps.maneuvers(gps_trajectory(spark, d), TH, hz=HZ)


def sparse_ffill(spark: SparkSession, d: str) -> DataFrame:
    return gps.sparse_fill(views.uniform(spark, d), "v_ego", out="v_filled").select("route_id", "i", "v_ego", "v_filled")


def road_attributes(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    p = views.table(spark, d, "part").select("p_partkey", pick(_TAGS).alias("highway"), pick(_LIMITS).alias("maxspeed"), pick(_LANES).alias("lanes"))
    kind = geo.road_class(F.col("highway"))
    return p.select("p_partkey", kind.alias("road_type"), geo.road_code(kind).alias("road_code"), (kind == "motorway").cast("int").alias("is_highway"), geo.is_link(F.col("highway")).cast("int").alias("is_on_ramp"), geo.speed_limit(F.col("maxspeed")).alias("speed_limit_kph"), geo.lanes(F.col("lanes")).alias("n_lanes"))


def bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.road_graph(spark, d)
    return roadgraph.bounded_paths(edges, nodes, TH.intersection_horizon_m)


def intersections_ahead(spark: SparkSession, d: str) -> DataFrame:
    _, edges = views.road_graph(spark, d)
    return roadgraph.ahead(edges, bounded_paths(spark, d), GRAPH)


def trace_context(spark: SparkSession, d: str) -> DataFrame:
    """Every edge as the match of a trace point with a heading of its own."""
    nodes, edges = views.road_graph(spark, d)
    nodes = nodes.withColumn("x", F.col("x") / 1000).withColumn("y", F.col("y") / 1000)
    points = edges.select((F.col("u") * 1000 + F.col("v") * 10 + F.col("key")).alias("point_id"), "u", "v", "key", ((F.col("u") * 37 + F.col("v") * 11) % 360 + 0.3).alias("heading_deg"))
    return roadgraph.trace_context(points, edges, nodes, roadgraph.bounded_paths(edges, nodes, TH.reach_m), bounded_paths(spark, d), GRAPH)


def intersection_distance(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.road_graph(spark, d)
    return roadgraph.intersection_distance(edges, roadgraph.bounded_paths(edges, nodes, TH.reach_m), replace(TH, intersection_degree=6))


def nearest_edge(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.road_graph(spark, d)
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 41 * 11.0 - 20.0).alias("px"), (F.col("c_custkey") % 37 * 9.5 - 15.0).alias("py"))
    return roadgraph.nearest_edge(c, nodes, edges, max_m=60.0)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labels by source and language, with a tenth of the sources left without any."""
    docs = views.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("shard"))
    known = views.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(known, "doc_id", "left").withColumn("quality", F.when(F.col("shard").like("src1%/de"), None).otherwise(F.col("quality"))).withColumn("toxic", F.when(F.col("shard").like("src1%"), None).otherwise(F.col("toxic")))


def null_group_find(spark: SparkSession, d: str) -> DataFrame:
    return features.null_groups(_labelled(spark, d), "shard", ["quality", "toxic"])


def coverage_recheck(spark: SparkSession, d: str) -> DataFrame:
    return features.coverage(_labelled(spark, d), "shard", "quality")


def done_antijoin(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select("event_id", "user_id")
    return intervals.remaining(e, views.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id")), "user_id")


def upsert_partition(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select("event_id", "user_id", "value")
    return features.upsert(e, e.filter("user_id % 10 = 1 and event_id % 2 = 0").withColumn("value", F.col("value") * 2), "user_id")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    head = F.slice("embedding", 1, 7)
    return views.table(spark, d, "embeddings").select((F.col("label") % 7).alias("truth"), (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("pred"))


def metric_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_classes(spark, d), "truth", "pred", 7)


def metric_f1(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.f1_report(metric_confusion(spark, d))
    return m.select(half_even(F.col("accuracy"), 6).alias("accuracy"), half_even(F.col("macro_f1"), 6).alias("macro_f1"), *(half_even(F.col("f1")[F.lit(i)], 6).alias(f"f1_{i}") for i in range(7)))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    e = views.irregular(spark, d).select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("k") / 100).alias("s"))
    return metrics.curve(e, "y", "s")


def metric_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.pr_curve(_curve(spark, d)), "precision", "recall")


def metric_auc(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.auc(_curve(spark, d)), "auc_roc")


def metric_ap(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.average_precision(_curve(spark, d)), "auprc")


def metric_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.best_threshold(_curve(spark, d)), "f1")


def metric_p_at_r(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.precision_at_recall(_curve(spark, d)), "precision_at_recall")


def metric_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = views.irregular(spark, d).select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("k") / 100).alias("s"))
    return _round(metrics.at_threshold(e, "y", "s", 0.25), "f1", "accuracy")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Runs: an event is a run of a task with a seed and a map of metrics."""
    k = F.col("k")
    return views.irregular(spark, d).select(
        F.col("event_type").alias("task"), F.when(k % 2 == 0, "struct").otherwise("video").alias("modality"), F.lit("gru").alias("model"), F.lit("cross_driver").alias("split"), F.lit(3).alias("horizon"), (k % 3).alias("seed"),
        F.create_map(F.lit("f1"), F.col("value") / 500, F.lit("auc_roc"), F.when(k == 5, None).otherwise(k / 100), F.lit("n_pos"), k.cast("double"), F.lit("threshold_val"), k / 200).alias("metrics"),
    )


def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _round(reporting.seed_aggregate(_results(spark, d), "metrics"), "mean", "std")


def configuration_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.configuration_counts(_results(spark, d))


def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(t, m) for t in ("click", "view", "merge") for m in ("struct", "video")], "task string, modality string")
    wanted = wanted.select("task", "modality", F.lit("gru").alias("model"), F.lit("cross_driver").alias("split"), F.lit(3).alias("horizon"))
    return reporting.report_table(reporting.seed_aggregate(_results(spark, d), "metrics"), wanted, reporting.GROUP, ["auc_roc", "f1"]).select("task", "modality", "auc_roc", "f1", "n_seeds")


def segment_timing(spark: SparkSession, d: str) -> DataFrame:
    u = views.uniform(spark, d)
    return reporting.segment_timing(u.select("route_id", F.col("i").alias("seg_num"), (1.0 + F.col("k") % 5 * 0.5).alias("duration_s")))


def frame_times(spark: SparkSession, d: str) -> DataFrame:
    u = views.uniform(spark, d)
    return reporting.frame_times(u.select("route_id", F.col("i").alias("seg_num"), (F.col("k") % 4).alias("n_frames"), F.when(F.col("k") % 7 == 0, F.col("i") * 61.0).alias("start_s")))


def feature_validation(spark: SparkSession, d: str) -> DataFrame:
    u = views.uniform(spark, d)
    frames = u.select("route_id", "i", (F.col("i") * 0.5 - F.when((F.col("k") == 50) & (F.col("route_id") % 2 == 0), 2.0).otherwise(0.0)).alias("ts"), F.when((F.col("route_id") % 11 == 0) & (F.col("i") == 3), 63).otherwise(64).alias("dim"))
    expected = u.groupBy("route_id").agg((F.count("*") * (1 + F.col("route_id") % 4) * 0.5).alias("duration_s"))
    return reporting.validate_features(frames, expected, dim=64)


def vlm_parse_label(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    tail = F.element_at(F.array(*(F.lit(x) for x in _ANSWERS)), (F.col("turn") % len(_ANSWERS) + 1).cast("int"))
    return c.select("conv_id", "turn", reporting.parse_label(F.concat("text", tail)).alias("label"))


def vlm_parse_binary(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    n = (F.col("conv_id") % 100).cast("string")
    kind = F.col("conv_id") % 5
    text = F.when(kind == 0, F.concat(F.lit('ok {"prediction": 1, "confidence": 0.'), n, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"confidence":0.'), n, F.lit(', "prediction" : 0, "x": 2}'))).when(kind == 2, '{"prediction": 1, "confidence": 1.2.3}').when(kind == 3, F.col("text"))
    pred, conf = reporting.parse_binary(text)
    return c.select("conv_id", "turn", pred.alias("prediction"), conf.alias("confidence"), half_even(reporting.positive_score(pred, conf), 6).alias("score"))


def _streams(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The uniform view's signals under the streams' own names; some streams are on slower clocks, and some routes lack them."""
    u = views.uniform(spark, d).withColumns({
        "vEgo": F.col("v_ego"), "aEgo": F.col("a_ego"), "steeringAngleDeg": F.col("steer"), "brakePressed": F.col("brake"), "gas": F.col("k") / 128, "leftBlinker": F.col("left_blinker"), "rightBlinker": (F.col("k") % 5 == 0).cast("int"),
        "cruiseState_enabled": F.col("cruise_en"), "cc_latActive": F.col("cc_lat"), "leadOne_status": F.col("lead_status"), "leadOne_dRel": F.col("d_rel"), "leadOne_vRel": (F.col("k") - 50) / 8, "leadTwo_status": (F.col("k") % 4 == 1).cast("int"),
        "leadTwo_dRel": F.col("d_rel") * 2, "faceProb": F.col("k") / 128, "face_yaw": (F.col("k") - 50) / 8, "face_pitch": (50 - F.col("k")) / 16, "leftEyeProb": F.col("k") / 256, "rightEyeProb": F.col("k") / 512,
        "model_desiredCurvature": (F.col("k") - 50) / 1024, "laneChangeState": F.col("lcs") * 2, "laneLeft_prob": F.col("k") / 128, "laneRight_prob": (100 - F.col("k")) / 128,
        **{f"accel_{x}": (F.col("k") - n) / 64 for x, n in (("x", 50), ("y", 20), ("z", 90))}, **{f"gyro_{x}": (F.col("k") - n) / 512 for x, n in (("x", 50), ("y", 20), ("z", 90))},
    })
    rows = {"vehicle_dynamics": F.lit(True), "radar": F.col("i") % 2 == 0, "driver_state": F.col("route_id") % 5 != 0, "planning": F.col("i") % 3 == 0, "imu": F.col("route_id") % 2 == 0}
    return {name: u.filter((F.col("route_id") % 11 != 0) & rows[name]).select("route_id", "i", "time_s", *(c for c in MODALITIES[name] if c in u.columns)) for name in rows}


def text_summary(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d).withColumn("end_s", F.col("start_s") + 5.0)
    return reporting.sensor_context(w, _streams(spark, d))


def modality_columns(spark: SparkSession, d: str) -> DataFrame:
    """The input columns of a configuration, of the uniform view's signals; those that it lacks take their defaults."""
    streams = _streams(spark, d)
    wide = streams["vehicle_dynamics"]
    for name in ("driver_state", "imu"):
        wide = wide.join(streams[name], ["route_id", "i", "time_s"], "left")
    return features.select_configuration(wide, ["route_id", "i"], MODALITY)


def metric_map(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of the odd routes at the threshold that the even ones choose, a row for each."""
    e = _scored(spark, d)
    val, test = e.filter("route_id % 2 = 0"), e.filter("route_id % 2 = 1")
    chosen = metrics.best_threshold(metrics.curve(val, "y", "s"))
    found = metrics.binary_report(metrics.curve(test, "y", "s"), chosen)
    return _round(found.select(F.explode("metrics").alias("metric", "value")), "value")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return views.irregular(spark, d).select("route_id", (F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("k") / 100).alias("s")).filter("s is not null")


def experiment_matrix(spark: SparkSession, d: str) -> DataFrame:
    done = views.irregular(spark, d).filter("k < 4").select(F.concat(F.lit("task"), (F.col("k") % 3 + 1).cast("string")).alias("task"), F.col("event_type").alias("model"), F.when(F.col("k") % 2 == 0, "struct").otherwise("video").alias("modality")).distinct()
    return intervals.matrix_todo({"task": ["task1", "task2", "task3"], "model": ["click", "view", "gru"], "modality": ["struct", "video", "gps"]}, done)


def pca_project(spark: SparkSession, d: str) -> DataFrame:
    return features.pca(views.table(spark, d, "embeddings"), "vec_id", "embedding", 8)


def lr_fit(spark: SparkSession, d: str) -> DataFrame:
    u = views.uniform(spark, d).select((F.col("route_id") * 1000 + F.col("i")).alias("row_id"), "v_ego", "steer", "a_ego", "lcs")
    return features.logistic(u, "row_id", ["v_ego", "steer", "a_ego"], "lcs")


#: Tags and answers that the queries cycle through.
_TAGS = ("motorway", "Primary_Link", "living_street", "footway", "trunk_link", "service")
_LIMITS = ("50", "30 mph", "none", "walk", "", "80;60", "120 km/h")
_LANES = ("2", "2.7", "3;2", "")
_ANSWERS = ("", " Stopped", " lane change", " laneCHANGE then turning", " braking hard", " CarFollowing")

QUERIES = {
    f.__name__: f
    for f in (resample_linear_grid, resample_channels, packed_window_slices, window_slice_padded, window_stats, norm_stats, zscore_features, class_weights, pos_weight, gps_clean, gps_quality, gps_bbox, savgol_smooth, gps_trajectory, maneuver_lookahead, sparse_ffill, road_attributes, bounded_paths, intersections_ahead, trace_context, intersection_distance, nearest_edge, null_group_find, coverage_recheck, done_antijoin, upsert_partition, metric_confusion, metric_f1, metric_pr_curve, metric_auc, metric_ap, metric_best_threshold, metric_p_at_r, metric_at_threshold, seed_aggregate, configuration_counts, report_pivot, segment_timing, frame_times, feature_validation, vlm_parse_label, vlm_parse_binary, text_summary, modality_columns, metric_map, experiment_matrix, pca_project, lr_fit)
}

# The same in SQL.
_H = lambda x, d: f"(round_even(({x}) * {10**d}.0::DOUBLE, 0) / {10**d}.0::DOUBLE)"
_P = lambda x, d: f"printf('%.{d}f', {_H(x, d)} + 0.0::DOUBLE)"
_MOD = lambda x: f"(CASE WHEN ({x}) % 360 < 0 THEN (({x}) % 360 + 360) % 360 ELSE ({x}) % 360 END)"
_TURN = lambda a, b: f"({_MOD(f'{a} - {b} + 180')} - 180)"
_LIST = lambda xs: "([" + ", ".join(f"'{x}'" for x in xs) + "])"
_WIN = views.with_views("tel_u") + """,
bounds AS (SELECT route_id, min(time_s) AS t0, max(time_s) AS t1 FROM tel_u GROUP BY route_id HAVING count(*) >= 2),
win AS (SELECT route_id, t0 + w * 4.0::DOUBLE AS start_s FROM (SELECT *, unnest(generate_series(0, CAST(floor((t1 - t0) / 4) AS INTEGER))) AS w FROM bounds))"""
_SLICE = _WIN + """,
sl AS (SELECT w.route_id, w.start_s, CAST(j AS INTEGER) AS j, COALESCE(u.v_ego, 0.0) AS v_ego, COALESCE(u.a_ego, 0.0) AS a_ego
  FROM (SELECT *, unnest(generate_series(0, 9)) AS j FROM win) w LEFT JOIN tel_u u ON u.route_id = w.route_id AND u.i = greatest(0, round_even(w.start_s / 0.5, 0)) + j)"""
_EMB = "WITH x AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT dim, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS std FROM x GROUP BY dim)"
_CLEAN = views.with_views("gps_raw") + """,
c0 AS (SELECT *, count(phone_lat) OVER w > 10 AND count(*) FILTER (phone_lat IS NULL OR phone_lat <> 0) OVER w > 10 AS ph, count(lat) OVER w > 10 AND count(*) FILTER (lat IS NULL OR lat <> 0) OVER w > 10 AS de FROM gps_raw WINDOW w AS (PARTITION BY route_id)),
c1 AS (SELECT route_id, i, time_s, CASE WHEN ph THEN phone_lat ELSE lat END AS lat, CASE WHEN ph THEN phone_lon ELSE lon END AS lon, CASE WHEN ph THEN phone_speed ELSE speed END AS gps_speed, CASE WHEN ph THEN phone_hacc ELSE hacc END AS gps_hacc, CASE WHEN ph THEN 'phone' ELSE 'device' END AS source
  FROM c0 WHERE CASE WHEN ph THEN phone_lat IS NOT NULL AND phone_lat <> 0 WHEN de THEN lat IS NOT NULL AND lat <> 0 AND lon <> 0 AND hacc IS NOT NULL AND hacc < 50 ELSE false END),
c2 AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n, abs(lat - lag(lat) OVER o) AS da, abs(lon - lag(lon) OVER o) AS dn FROM c1 WINDOW o AS (PARTITION BY route_id ORDER BY time_s, i)),
c3 AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n2 FROM c2 WHERE n >= 10 AND (da IS NULL OR greatest(da, dn) <= 0.005::DOUBLE)),
cl AS (SELECT route_id, i, time_s, lat, lon, gps_speed, gps_hacc, source FROM c3 WHERE n2 >= 10)"""


def _sg(col: str) -> str:
    """The smoothing of a column over window o, with rn and cnt of the row."""
    hat = gps.savgol_weights()
    at = lambda r: " + ".join(f"{'lag' if j < r else 'lead'}({col}, {abs(j - r)}) OVER o * {float(hat[r, j])!r}::DOUBLE" if j != r else f"{col} * {float(hat[r, j])!r}::DOUBLE" for j in range(11))
    ends = " ".join(f"WHEN rn = {r} THEN {at(r)} WHEN rn = cnt - 1 - {r} THEN {at(10 - r)}" for r in range(5))
    return f"CASE WHEN cnt < 11 THEN {col} {ends} ELSE {at(5)} END"


_O = "WINDOW o AS (PARTITION BY route_id ORDER BY time_s, i)"
_SMOOTH = _CLEAN + f""",
n0 AS (SELECT *, row_number() OVER o - 1 AS rn, count(*) OVER (PARTITION BY route_id) AS cnt FROM cl {_O}),
sm AS (SELECT *, {_sg("lat")} AS lat_s, {_sg("lon")} AS lon_s FROM n0 {_O})"""
_TRAJ = _SMOOTH + f""",
j0 AS (SELECT *, lag(lat_s) OVER o AS la, lag(lon_s) OVER o AS lo, time_s - lag(time_s) OVER o AS dt, first_value(lat_s) OVER o AS lat0, first_value(lon_s) OVER o AS lon0 FROM sm {_O}),
j1 AS (SELECT *, {_MOD("degrees(atan2(sin(radians(lon_s - lo)) * cos(radians(lat_s)), cos(radians(la)) * sin(radians(lat_s)) - sin(radians(la)) * cos(radians(lat_s)) * cos(radians(lon_s - lo)))) + 360")} AS h0,
  pow(sin((radians(lat_s) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lat_s)) * pow(sin(radians(lon_s - lo) / 2), 2) AS hv,
  (lon_s - lon0) * (111320.0::DOUBLE * cos(radians(lat0))) AS x_m, (lat_s - lat0) * 111320.0::DOUBLE AS y_m FROM j0),
j2 AS (SELECT *, CASE WHEN dt > 0 THEN 2 * 6371000.0::DOUBLE * atan2(sqrt(hv), sqrt(1 - hv)) / dt ELSE 0 END AS v0 FROM j1),
j3 AS (SELECT *, CASE WHEN rn = 0 THEN COALESCE(lead(h0) OVER o, 0) ELSE h0 END AS heading, CASE WHEN rn = 0 THEN COALESCE(lead(v0) OVER o, 0) ELSE v0 END AS v1,
  lag(x_m, 2) OVER o AS x1, lag(y_m, 2) OVER o AS y1, lag(x_m) OVER o AS x2, lag(y_m) OVER o AS y2 FROM j2 {_O}),
j4 AS (SELECT *, CASE WHEN rn > 0 AND dt > 0 THEN {_TURN("heading", "lag(heading) OVER o")} / dt ELSE 0 END AS rate,
  sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * sqrt((x_m - x2) * (x_m - x2) + (y_m - y2) * (y_m - y2)) * sqrt((x_m - x1) * (x_m - x1) + (y_m - y1) * (y_m - y1)) AS sides, abs((x2 - x1) * (y_m - y1) - (x_m - x1) * (y2 - y1)) AS area2,
  CASE WHEN gps_speed IS NOT NULL AND gps_speed >= 0 THEN gps_speed ELSE v1 END AS spd FROM j3 {_O}),
j5 AS (SELECT *, {_sg("rate")} AS rate_s, CAST(spd < 0.5 AS INTEGER) AS st FROM j4 {_O}),
j6 AS (SELECT *, time_s - last_value(CASE WHEN st = 0 OR rn = 0 THEN time_s END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY time_s, i ROWS UNBOUNDED PRECEDING) AS sd FROM j5),
traj AS (SELECT route_id, i, time_s, {_H("heading", 2)} AS heading_deg, {_H("rate_s", 4)} AS heading_change_rate, {_H("CASE WHEN rn < 2 THEN 0.0::DOUBLE WHEN sides < 1e-12 THEN 0.0 ELSE 2 * area2 / sides END", 6)} AS curvature, {_H("spd", 3)} AS traj_speed_mps, st AS is_stopped, {_H("sd", 2)} AS stopped_duration_s FROM j6)"""
_GRAPH = views.with_views("edges")


def _paths(cutoff: float) -> str:
    return f""",
pt AS (SELECT node_id AS src, node_id AS dst, 0.0::DOUBLE AS dist FROM nodes UNION ALL SELECT p.src, e.v, p.dist + e.length FROM pt p JOIN edges e ON p.dst = e.u WHERE p.dist + e.length <= {cutoff}),
paths AS (SELECT src, dst, min(dist) AS dist FROM pt GROUP BY src, dst), deg AS (SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM edges UNION ALL SELECT v FROM edges) GROUP BY node_id)"""


def _class_sql(x: str) -> str:
    return "CASE lower(" + x + ") " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in geo.ROAD_CLASSES.items()) + " ELSE 'other' END"


def _limit_sql(x: str) -> str:
    return f"CASE WHEN lower({x}) LIKE '%mph%' THEN TRY_CAST(trim(replace(lower({x}), 'mph', '')) AS DOUBLE) * 1.60934::DOUBLE ELSE TRY_CAST(string_split_regex(trim({x}), '\\s+')[1] AS DOUBLE) END"


_LABELLED = "WITH lb AS (SELECT d.doc_id, concat_ws('/', source, lang) AS shard, CASE WHEN concat_ws('/', source, lang) LIKE 'src1%/de' THEN NULL ELSE quality END AS quality, CASE WHEN source LIKE 'src1%' THEN NULL ELSE toxic END AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_CONF = """WITH p AS (SELECT label % 7 AS truth, list_position(embedding[1:7], list_max(embedding[1:7])) - 1 AS pred FROM embeddings), ax AS (SELECT CAST(range AS INTEGER) AS c FROM range(7)),
cf AS (SELECT a.c AS truth, b.c AS pred, (SELECT count(*) FROM p WHERE p.truth = a.c AND p.pred = b.c) AS n FROM ax a, ax b)"""
_CURVE = views.with_views("ev") + """,
g AS (SELECT k / 100.0::DOUBLE AS threshold, count(*) FILTER (event_type = 'purchase') AS pos, count(*) FILTER (event_type <> 'purchase') AS neg FROM ev GROUP BY k),
c AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS n_pos, CAST(sum(neg) OVER () AS DOUBLE) AS n_neg FROM g WINDOW w AS (ORDER BY threshold DESC))"""
_SEEDS = views.with_views("ev") + """,
rs AS (SELECT event_type AS task, CASE WHEN k % 2 = 0 THEN 'struct' ELSE 'video' END AS modality, 'gru' AS model, 'cross_driver' AS split, 3 AS horizon, value / 500 AS f1, CASE WHEN k = 5 THEN NULL ELSE k / 100.0::DOUBLE END AS auc FROM ev),
lg AS (SELECT task, modality, model, split, horizon, 'f1' AS metric, f1 AS v FROM rs UNION ALL SELECT task, modality, model, split, horizon, 'auc_roc', auc FROM rs),
ag AS (SELECT task, modality, model, split, horizon, metric, avg(v) AS mean, stddev_pop(v) AS std FROM lg WHERE v IS NOT NULL GROUP BY ALL), sn AS (SELECT task, modality, count(*) AS n_seeds FROM rs GROUP BY ALL)"""
_AT = lambda n, t: f"arg_min(en, (abs(time_s - {t}), i)) AS {n}"
_N = lambda x, d: f"COALESCE({_P(x, d)}, 'N/A')"
_THREE = lambda c: " || ' → ' || ".join(_N(f"{n}.{c}", 1) for n in "amz")
_FROM_VIEW = {
    "vEgo": "v_ego", "aEgo": "a_ego", "steeringAngleDeg": "steer", "gas": "k / 128.0::DOUBLE", "brake": "brake", "brakePressed": "brake", "cruiseState_enabled": "cruise_en", "cc_latActive": "cc_lat", "leftBlinker": "left_blinker", "rightBlinker": "CAST(k % 5 = 0 AS INTEGER)",
    "face_yaw": "CASE WHEN route_id % 5 <> 0 THEN (k - 50) / 8.0::DOUBLE END", "face_pitch": "CASE WHEN route_id % 5 <> 0 THEN (50 - k) / 16.0::DOUBLE END", "faceProb": "CASE WHEN route_id % 5 <> 0 THEN k / 128.0::DOUBLE END",
    "leftEyeProb": "CASE WHEN route_id % 5 <> 0 THEN k / 256.0::DOUBLE END", "rightEyeProb": "CASE WHEN route_id % 5 <> 0 THEN k / 512.0::DOUBLE END",
    **{f"{kind}_{x}": f"CASE WHEN route_id % 2 = 0 THEN (k - {n}) / {by}.0::DOUBLE END" for kind, by in (("accel", 64), ("gyro", 512)) for x, n in (("x", 50), ("y", 20), ("z", 90))},
}
_SIGNAL = lambda c: f"COALESCE(CAST({_FROM_VIEW.get(c, 'NULL')} AS DOUBLE), {SIGNAL_DEFAULTS.get(c, 0.0)}::DOUBLE)"
_BINARY = views.with_views("ev") + """,
sc AS (SELECT route_id, CAST(event_type = 'purchase' AS INTEGER) AS y, k / 100.0::DOUBLE AS s FROM ev WHERE k IS NOT NULL),
va AS (SELECT * FROM sc WHERE route_id % 2 = 0), te AS (SELECT * FROM sc WHERE route_id % 2 = 1),
tn AS (SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM te),
th AS (SELECT c.s AS t FROM (SELECT DISTINCT s FROM va) c JOIN va ON true GROUP BY c.s ORDER BY 2.0::DOUBLE * count(*) FILTER (va.y = 1 AND va.s >= c.s) / (count(*) FILTER (va.y = 1) + count(*) FILTER (va.s >= c.s)) DESC, c.s LIMIT 1),
tc AS (SELECT c.s, count(*) FILTER (te.s = c.s AND te.y = 1) AS p, count(*) FILTER (te.s >= c.s AND te.y = 1) AS tp, count(*) FILTER (te.s >= c.s AND te.y = 0) AS fp FROM (SELECT DISTINCT s FROM te) c JOIN te ON true GROUP BY c.s)"""
_C5 = ("v_ego", "steer", "a_ego", "d_rel", "left_blinker")
_PACKED = _WIN + """,
third AS (SELECT * FROM tel_u WHERE i % 3 = 0), pb AS (SELECT route_id, min(time_s) AS t0, max(time_s) AS t1 FROM third GROUP BY route_id HAVING count(*) >= 2),
pg AS (SELECT route_id, s, t0 + s * 0.2::DOUBLE AS time_s FROM (SELECT *, unnest(generate_series(0, CAST(ceil((t1 - t0) / 0.2::DOUBLE + 0.5) AS BIGINT) - 1)) AS s FROM pb)),
p1 AS (SELECT pg.*, """ + ", ".join(f"x.{c} AS {c}_a" for c in _C5) + """, x.time_s AS ta FROM pg ASOF LEFT JOIN third x ON x.route_id = pg.route_id AND pg.time_s >= x.time_s),
p2 AS (SELECT p1.*, """ + ", ".join(f"x.{c} AS {c}_b" for c in _C5) + """, x.time_s AS tb FROM p1 ASOF LEFT JOIN third x ON x.route_id = p1.route_id AND p1.time_s <= x.time_s),
pk AS (SELECT route_id, s, time_s, """ + ", ".join(f"{_H(f'(CASE WHEN tb IS NULL OR ta = tb THEN {c}_a ELSE {c}_a + ({c}_b - {c}_a) * ((time_s - ta) / (tb - ta)) END)::FLOAT::DOUBLE', 3)} AS {c}" for c in _C5) + """ FROM p2),
pw AS (SELECT win.route_id, win.start_s, j, """ + ", ".join(f"coalesce(pk.{c}, 0.0::DOUBLE) AS {c}" for c in _C5) + """ FROM (SELECT win.*, t0, unnest(generate_series(0, 99)) AS j FROM win LEFT JOIN pb USING (route_id)) win LEFT JOIN pk ON pk.route_id = win.route_id AND pk.s = greatest(0, round_even((win.start_s - win.t0) / 0.2::DOUBLE, 0)::BIGINT) + j)"""
ORACLE_SQL = {
    "resample_channels": _PACKED + f" SELECT route_id, s, {_H('time_s', 3)} AS time_s, {', '.join(_C5)} FROM pk",
    "packed_window_slices": _PACKED + " SELECT route_id, start_s, " + ", ".join(f"sum(round_even({c} * 1000, 0)::BIGINT)::BIGINT AS {c}_sum, arg_min({c}, j) AS {c}_first, arg_max({c}, j) AS {c}_last" for c in _C5) + " FROM pw GROUP BY route_id, start_s",
    "resample_linear_grid": views.with_views("tel_x") + f""",
b AS (SELECT route_id, min(time_s) AS t0, max(time_s) AS t1 FROM tel_x GROUP BY route_id),
gr AS (SELECT route_id, CAST(s AS INTEGER) AS s, t0 + s * 12.0::DOUBLE AS time_s FROM (SELECT *, unnest(generate_series(0, CAST(ceil((t1 - t0) / 12.0::DOUBLE + 0.5) AS INTEGER) - 1)) AS s FROM b)),
g1 AS (SELECT gr.*, x.time_s AS ta, x.value AS va FROM gr ASOF LEFT JOIN tel_x x ON x.route_id = gr.route_id AND gr.time_s >= x.time_s),
g2 AS (SELECT g1.*, x.time_s AS tb, x.value AS vb FROM g1 ASOF LEFT JOIN tel_x x ON x.route_id = g1.route_id AND g1.time_s <= x.time_s)
SELECT route_id, s, time_s, {_H("CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * ((time_s - ta) / (tb - ta)) END", 6)} AS value FROM g2""",
    "window_slice_padded": _SLICE + " SELECT * FROM sl",
    "window_stats": _SLICE + " SELECT route_id, start_s, " + ", ".join(f"{_H(f'{f}({c})', 8)} AS {c}_{n}" for c in ("v_ego", "a_ego") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + ", " + ", ".join(f"{_H(f'arg_max({c}, j)', 8)} AS {c}_last" for c in ("v_ego", "a_ego")) + " FROM sl GROUP BY route_id, start_s",
    "norm_stats": _EMB + f" SELECT dim, {_H('mean', 6)} AS mean, {_H('std', 6)} AS std FROM s",
    "zscore_features": _EMB + f" SELECT vec_id, dim, {_H('(x - mean) / (std + 1e-8::DOUBLE)', 5)} AS z FROM x JOIN s USING (dim)",
    "class_weights": f"WITH c AS (SELECT t.event_type, greatest(count(e.event_id), 1) AS n FROM (SELECT unnest({_LIST(CLASSES)}) AS event_type) t LEFT JOIN events e USING (event_type) GROUP BY t.event_type) SELECT event_type, n, {_H('greatest(1.0::DOUBLE, least(10.0::DOUBLE, max(n) OVER () / n))', 6)} AS weight FROM c",
    "pos_weight": f"WITH s AS (SELECT count(*) FILTER (event_type = 'purchase') AS n_pos, count(*) FILTER (event_type <> 'purchase') AS n_neg FROM events) SELECT n_pos, n_neg, CASE WHEN n_pos = 0 THEN 1.0::DOUBLE ELSE {_H('least(n_neg / n_pos, 10.0::DOUBLE)', 6)} END AS pos_weight, {_H('n_neg / greatest(n_pos, 1)', 6)} AS tree_weight FROM s",
    "gps_clean": _CLEAN + " SELECT * FROM cl",
    "gps_quality": _CLEAN + f""",
q0 AS (SELECT *, abs(lat - lag(lat) OVER o) > 0.001::DOUBLE OR abs(lon - lag(lon) OVER o) > 0.001::DOUBLE AS far FROM cl {_O}),
q1 AS (SELECT route_id, min(source) AS src, count(*) AS v, median(gps_hacc) AS m, count(*) FILTER (far) AS j, median(lat) AS la, median(lon) AS lo FROM q0 GROUP BY route_id), q2 AS (SELECT route_id, count(*) AS n FROM gps_raw GROUP BY route_id)
SELECT route_id, COALESCE(src, 'none') AS gps_source, n AS total_rows, COALESCE(v, 0) AS valid_rows, {_H("COALESCE(v / n, 0)", 4)} AS coverage_frac, {_H("m", 2)} AS median_hacc, COALESCE(j, 0) AS n_jumps, CASE WHEN v IS NULL THEN 'none' WHEN v / n > 0.9::DOUBLE AND j < 5 THEN 'good' WHEN v / n > 0.5 THEN 'moderate' ELSE 'poor' END AS quality_tier, {_H("la", 6)} AS lat_center, {_H("lo", 6)} AS lon_center, COALESCE(v, 0) >= 20 AS enough_rows FROM q2 LEFT JOIN q1 USING (route_id)""",
    "gps_bbox": _CLEAN + f""",
f AS (SELECT route_id, quantile_cont(lat, [0.05, 0.95]) AS qa, quantile_cont(lon, [0.05, 0.95]) AS qo FROM cl GROUP BY route_id),
k AS (SELECT cl.* FROM cl JOIN f USING (route_id) WHERE lat BETWEEN qa[1] - 1.5::DOUBLE * (qa[2] - qa[1]) AND qa[2] + 1.5::DOUBLE * (qa[2] - qa[1]) AND lon BETWEEN qo[1] - 1.5::DOUBLE * (qo[2] - qo[1]) AND qo[2] + 1.5::DOUBLE * (qo[2] - qo[1])),
b AS (SELECT route_id, count(*) AS n_points, max(lat) + 500.0::DOUBLE / 111320.0::DOUBLE AS n, min(lat) - 500.0::DOUBLE / 111320.0::DOUBLE AS s, max(lon) + 500.0::DOUBLE / (111320.0::DOUBLE * cos(radians(avg(lat)))) AS e, min(lon) - 500.0::DOUBLE / (111320.0::DOUBLE * cos(radians(avg(lat)))) AS w, cos(radians(avg(lat))) AS f, median(lat) AS y, median(lon) AS x FROM k GROUP BY route_id HAVING count(*) >= 10),
c AS (SELECT *, (n - s) * 111.32::DOUBLE > 50 OR (e - w) * 111.32::DOUBLE * f > 50 AS far, 5000.0::DOUBLE / 111320.0::DOUBLE AS up, 5000.0::DOUBLE / (111320.0::DOUBLE * cos(radians(y))) AS aside FROM b)
SELECT route_id, n_points, {_H("CASE WHEN far THEN y + up ELSE n END", 6)} AS north, {_H("CASE WHEN far THEN y - up ELSE s END", 6)} AS south, {_H("CASE WHEN far THEN x + aside ELSE e END", 6)} AS east, {_H("CASE WHEN far THEN x - aside ELSE w END", 6)} AS west FROM c""",
    "savgol_smooth": _SMOOTH + f" SELECT route_id, i, {_H('lat_s', 7)} AS lat_s, {_H('lon_s', 7)} AS lon_s FROM sm",
    "gps_trajectory": _TRAJ + " SELECT * FROM traj",
    "maneuver_lookahead": _TRAJ + f""",
m0 AS (SELECT *, row_number() OVER o - 1 AS rn, max(CAST(traj_speed_mps < 0.5 AS INTEGER)) OVER (PARTITION BY route_id ORDER BY time_s, i ROWS BETWEEN CURRENT ROW AND {10 * HZ - 1} FOLLOWING) AS stop_within_10s FROM traj {_O}),
m1 AS (SELECT a.route_id, a.rn, s.s, {_TURN("b.heading_deg", "a.heading_deg")} AS d, b.time_s - a.time_s AS dt FROM m0 a, range(5, 31) s(s), m0 b WHERE a.rn % {HZ} = 0 AND b.route_id = a.route_id AND b.rn = a.rn + s.s * {HZ}),
m2 AS (SELECT route_id, rn, arg_min(d, s) AS d, arg_min(dt, s) AS dt FROM m1 WHERE abs(d) > 30 GROUP BY route_id, rn)
SELECT m0.route_id, i, time_s, CASE WHEN d > 0 THEN 'left_turn' WHEN d IS NOT NULL THEN 'right_turn' ELSE 'straight' END AS next_maneuver_type, {_H("dt", 2)} AS time_to_next_maneuver_s, CAST(COALESCE(dt <= 10, false) AS INTEGER) AS turn_within_10s, CAST(d IS NOT NULL AS INTEGER) AS turn_within_30s, stop_within_10s FROM m0 LEFT JOIN m2 ON m2.route_id = m0.route_id AND m2.rn = m0.rn - m0.rn % {HZ}""",
    "sparse_ffill": views.with_views("tel_u") + " SELECT route_id, i, v_ego, last_value(CASE WHEN i % 10 = 0 OR i = n THEN v_ego END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS v_filled FROM (SELECT *, max(i) OVER (PARTITION BY route_id) AS n FROM tel_u)",
    "road_attributes": f"WITH t AS (SELECT p_partkey, {_LIST(_TAGS)}[p_partkey % 6 + 1] AS h, {_LIST(_LIMITS)}[p_partkey % 7 + 1] AS m, {_LIST(_LANES)}[p_partkey % 4 + 1] AS l FROM part), r AS (SELECT *, {_class_sql('h')} AS road_type FROM t) SELECT p_partkey, road_type, CASE road_type " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in geo.ROAD_CODES.items()) + f" END AS road_code, CAST(road_type = 'motorway' AS INTEGER) AS is_highway, CAST(lower(h) LIKE '%link%' AS INTEGER) AS is_on_ramp, {_limit_sql('m')} AS speed_limit_kph, CAST(trunc(TRY_CAST(l AS DOUBLE)) AS INTEGER) AS n_lanes FROM r",
    "bounded_paths": _GRAPH + _paths(300) + " SELECT * FROM paths",
    "intersections_ahead": _GRAPH + _paths(300) + f""",
nr AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM paths) WHERE rn <= 50),
ou AS (SELECT n.src, {_class_sql("e.highway")} AS rc, e.highway LIKE '%link%' AS lk, {_limit_sql("e.maxspeed")} AS sl FROM nr n JOIN edges e ON e.u = n.dst WHERE EXISTS (SELECT 1 FROM paths p WHERE p.src = n.src AND p.dst = e.v)),
oc AS (SELECT src, CAST(count(DISTINCT rc) > 1 AS INTEGER) AS rt, max(CAST(lk AS INTEGER)) AS ra, min(sl) AS ll FROM ou GROUP BY src),
nc AS (SELECT p.src, count(*) AS density, count(*) FILTER (d.degree >= 5 AND p.dist > 0) AS n_intersections, {_H("COALESCE(min(CASE WHEN d.degree >= 5 AND p.dist > 0 THEN p.dist END), 300)", 1)} AS dist_to_intersection FROM paths p LEFT JOIN deg d ON d.node_id = p.dst GROUP BY p.src)
SELECT nc.src, density, n_intersections, dist_to_intersection, COALESCE(rt, 0) AS road_type_changes, COALESCE(ra, 0) AS ramp_ahead, ll AS lowest_limit FROM nc LEFT JOIN oc USING (src)""",
    "trace_context": _GRAPH + _paths(300) + f""",
pg AS (SELECT u * 1000 + v * 10 + key AS point_id, u, v, key, (u * 37 + v * 11) % 360 + 0.3::DOUBLE AS h, {_limit_sql("maxspeed")} AS own FROM edges),
pb AS (SELECT pg.*, radians(a.y / 1000) AS la, radians(b.y / 1000) AS lb, radians((b.x - a.x) / 1000) AS dl FROM pg JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
pf AS (SELECT *, CASE WHEN abs({_TURN("h", _MOD("degrees(atan2(sin(dl) * cos(lb), cos(la) * sin(lb) - sin(la) * cos(lb) * cos(dl))) + 360"))}) < 90 THEN v ELSE u END AS src FROM pb),
hd AS (SELECT src, count(*) AS n FROM paths WHERE dist <= 200 GROUP BY src),
nr AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM paths) WHERE rn <= 50),
ou AS (SELECT n.src, {_class_sql("e.highway")} AS rc, e.highway LIKE '%link%' AS lk, {_limit_sql("e.maxspeed")} AS sl FROM nr n JOIN edges e ON e.u = n.dst WHERE EXISTS (SELECT 1 FROM paths p WHERE p.src = n.src AND p.dst = e.v)),
oc AS (SELECT src, CAST(count(DISTINCT rc) > 1 AS INTEGER) AS rt, max(CAST(lk AS INTEGER)) AS ra, min(sl) AS ll FROM ou GROUP BY src),
nc AS (SELECT p.src, count(*) FILTER (d.degree >= 5 AND p.dist > 0) AS n_intersections, {_H("COALESCE(min(CASE WHEN d.degree >= 5 AND p.dist > 0 THEN p.dist END), 300)", 1)} AS dist_to_intersection FROM paths p LEFT JOIN deg d ON d.node_id = p.dst GROUP BY p.src)
SELECT point_id, pf.src AS forward_node, greatest(a.n, b.n) AS road_network_density, n_intersections, dist_to_intersection, COALESCE(rt, 0) AS road_type_changes, COALESCE(ra, 0) AS ramp_ahead, CAST(COALESCE(ll < own - 5, false) AS INTEGER) AS speed_limit_decreases FROM pf LEFT JOIN hd a ON a.src = u LEFT JOIN hd b ON b.src = v LEFT JOIN nc ON nc.src = pf.src LEFT JOIN oc ON oc.src = pf.src""",
    "intersection_distance": _GRAPH + _paths(200) + f""",
nx AS (SELECT src, min(dist) AS d FROM paths JOIN deg ON node_id = dst WHERE degree >= 6 GROUP BY src),
ed AS (SELECT e.*, CASE WHEN a.degree >= 6 OR b.degree >= 6 THEN least(999.0, length * 0.5) ELSE 999.0::DOUBLE END AS own, x.d AS dx, y.d AS dy FROM edges e JOIN deg a ON a.node_id = e.u JOIN deg b ON b.node_id = e.v LEFT JOIN nx x ON x.src = e.u LEFT JOIN nx y ON y.src = e.v)
SELECT u, v, key, {_H("CASE WHEN own > 100 THEN least(own, dx, dy) ELSE own END", 1)} AS dist_to_intersection_m, CAST(CASE WHEN own > 100 THEN least(own, dx, dy) ELSE own END < 50 AS INTEGER) AS is_near_intersection FROM ed""",
    "nearest_edge": _GRAPH + f""",
pp AS (SELECT c_custkey AS point_id, c_custkey % 41 * 11.0::DOUBLE - 20.0::DOUBLE AS px, c_custkey % 37 * 9.5::DOUBLE - 15.0::DOUBLE AS py FROM customer),
es AS (SELECT e.u, e.v, e.key, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v),
pe AS (SELECT point_id, px, py, x1, y1, dx, dy, u, v, key, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) END AS s FROM pp, es),
pd AS (SELECT point_id, u, v, key, sqrt((px - (x1 + s * dx)) * (px - (x1 + s * dx)) + (py - (y1 + s * dy)) * (py - (y1 + s * dy))) AS dist FROM pe),
pb AS (SELECT point_id, min((dist, u, v, key)) AS m FROM pd WHERE dist <= 60 GROUP BY point_id)
SELECT pp.point_id, m[2] AS u, m[3] AS v, m[4] AS key, {_H("m[1]", 3)} AS dist FROM pp LEFT JOIN pb USING (point_id)""",
    "null_group_find": _LABELLED + " SELECT shard FROM lb GROUP BY shard HAVING count(quality) = 0 AND count(toxic) = 0",
    "coverage_recheck": _LABELLED + " SELECT shard, count(*) AS n_rows, count(quality) AS n_values, bool_or(quality IS NOT NULL) AS covered FROM lb GROUP BY shard",
    "done_antijoin": "SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_custkey % 3 = 0)",
    "upsert_partition": "WITH n AS (SELECT event_id, user_id, value * 2 AS value FROM events WHERE user_id % 10 = 1 AND event_id % 2 = 0) SELECT event_id, user_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n",
    "metric_confusion": _CONF + " SELECT * FROM cf",
    "metric_f1": _CONF + f""",
pc AS (SELECT c, (SELECT sum(n) FROM cf WHERE truth = c) AS t, (SELECT sum(n) FROM cf WHERE pred = c) AS q, (SELECT sum(n) FROM cf WHERE truth = c AND pred = c) AS h FROM ax),
pf AS (SELECT *, CASE WHEN t + q = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * h / (t + q) END AS f FROM pc)
SELECT {_H("CAST(sum(h) AS DOUBLE) / sum(t)", 6)} AS accuracy, {_H("avg(f) FILTER (t + q > 0)", 6)} AS macro_f1, """ + ", ".join(f"{_H(f'max(CASE WHEN c = {i} THEN f END)', 6)} AS f1_{i}" for i in range(7)) + " FROM pf",
    "metric_pr_curve": _CURVE + f" SELECT threshold, {_H('tp / (tp + fp)', 6)} AS precision, {_H('tp / n_pos', 6)} AS recall FROM c",
    "metric_auc": _CURVE + f" SELECT {_H('sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (max(n_pos) * max(n_neg))', 6)} AS auc_roc FROM c",
    "metric_ap": _CURVE + f" SELECT {_H('sum(pos / n_pos * tp / (tp + fp))', 6)} AS auprc FROM c",
    "metric_best_threshold": _CURVE + f" SELECT threshold, {_H('f', 6)} AS f1 FROM (SELECT threshold, 2 * tp / (tp + fp + n_pos) AS f FROM c) ORDER BY f DESC, threshold LIMIT 1",
    "metric_p_at_r": _CURVE + f" SELECT {_H('max(tp / (tp + fp))', 6)} AS precision_at_recall FROM c WHERE tp / n_pos >= 0.8::DOUBLE",
    "metric_at_threshold": views.with_views("ev") + f", t AS (SELECT event_type = 'purchase' AS y, k / 100.0::DOUBLE >= 0.25::DOUBLE AS p FROM ev) SELECT {_H('2.0::DOUBLE * count(*) FILTER (y AND p) / (count(*) FILTER (p) + count(*) FILTER (y))', 6)} AS f1, {_H('count(*) FILTER (y = p) / count(*)', 6)} AS accuracy, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg FROM t",
    "seed_aggregate": _SEEDS + f" SELECT a.task, a.modality, model, split, horizon, metric, {_H('mean', 6)} AS mean, {_H('std', 6)} AS std, n_seeds FROM ag a JOIN sn USING (task, modality)",
    "configuration_counts": views.with_views("tel_x") + " SELECT CAST(sum(n) AS BIGINT) AS n_runs, count(*) AS n_configurations FROM (SELECT event_type, k % 2 AS m, count(*) AS n FROM tel_x GROUP BY event_type, COALESCE(k % 2, 1), k % 2)",
    "report_pivot": _SEEDS + f""",
w AS (SELECT t.task, m.modality FROM (VALUES ('click'), ('view'), ('merge')) t(task), (VALUES ('struct'), ('video')) m(modality))
SELECT w.task, w.modality, """ + ", ".join(f"COALESCE((SELECT {_P('mean', 4)} || ' +/- ' || {_P('std', 4)} FROM ag WHERE ag.task = w.task AND ag.modality = w.modality AND metric = '{m}'), '—') AS {m}" for m in ("auc_roc", "f1")) + ", COALESCE(n_seeds, 0) AS n_seeds FROM w LEFT JOIN sn USING (task, modality)",
    "segment_timing": views.with_views("tel_u") + " SELECT route_id, i AS seg_num, e - d AS start_s, e AS end_s FROM (SELECT *, sum(d) OVER (PARTITION BY route_id ORDER BY i) AS e FROM (SELECT *, 1.0::DOUBLE + k % 5 * 0.5::DOUBLE AS d FROM tel_u))",
    "frame_times": views.with_views("tel_u") + """,
s0 AS (SELECT route_id, i AS seg_num, k % 4 AS nf, COALESCE(CASE WHEN k % 7 = 0 THEN i * 61.0::DOUBLE END, sum(CASE WHEN k % 4 > 0 THEN (k % 4) / 2.0::DOUBLE ELSE 60.0::DOUBLE END) OVER (PARTITION BY route_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS st FROM tel_u)
SELECT route_id, seg_num, CAST(frame AS INTEGER) AS frame, st + frame / 2.0::DOUBLE AS time_s FROM (SELECT *, unnest(generate_series(0, nf - 1)) AS frame FROM s0 WHERE nf > 0)""",
    "feature_validation": views.with_views("tel_u") + """,
fr AS (SELECT route_id, i, i * 0.5::DOUBLE - CASE WHEN k = 50 AND route_id % 2 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS ts, CASE WHEN route_id % 11 = 0 AND i = 3 THEN 63 ELSE 64 END AS dim FROM tel_u),
fl AS (SELECT *, COALESCE(ts >= lag(ts) OVER (PARTITION BY route_id ORDER BY i), true) AS ok FROM fr),
fa AS (SELECT route_id, count(*) AS n_frames, max_by(ts, i) - min_by(ts, i) AS duration_s, bool_and(ok) AS timestamps_monotonic, min(dim) = 64 AND max(dim) = 64 AS dims, count(*) * (1 + route_id % 4) * 0.5::DOUBLE * 2 AS goal FROM fl GROUP BY route_id)
SELECT route_id, n_frames, duration_s, timestamps_monotonic, CAST(trunc(goal) AS INTEGER) AS expected_frames, dims AND timestamps_monotonic AS valid, goal > 0 AND n_frames / goal < 0.5 AS low_frame_count FROM fa""",
    "vlm_parse_label": f"WITH t AS (SELECT conv_id, turn, lower(text || {_LIST(_ANSWERS)}[turn % 6 + 1]) AS t FROM conversations) SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(t, '{c.lower()}') THEN '{c}'" for c in reporting.PARSE_ORDER) + " END AS label FROM t",
    "vlm_parse_binary": r"""WITH t AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'ok {"prediction": 1, "confidence": 0.' || conv_id % 100 || '}' WHEN 1 THEN '{"confidence":0.' || conv_id % 100 || ', "prediction" : 0, "x": 2}' WHEN 2 THEN '{"prediction": 1, "confidence": 1.2.3}' WHEN 3 THEN text END AS t FROM conversations),
a AS (SELECT *, '\{[^}]*"prediction"\s*:\s*([01])[^}]*"confidence"\s*:\s*([\d.]+)[^}]*\}' AS p, '\{[^}]*"confidence"\s*:\s*([\d.]+)[^}]*"prediction"\s*:\s*([01])[^}]*\}' AS q FROM t),
b AS (SELECT conv_id, turn, CASE WHEN t IS NOT NULL THEN COALESCE(TRY_CAST(COALESCE(nullif(regexp_extract(t, '\{[^}]*"prediction"\s*:\s*([01])[^}]*"confidence"\s*:\s*([\d.]+)[^}]*\}', 1), ''), nullif(regexp_extract(t, '\{[^}]*"confidence"\s*:\s*([\d.]+)[^}]*"prediction"\s*:\s*([01])[^}]*\}', 2), '')) AS INTEGER), 0) END AS prediction,
 CASE WHEN t IS NOT NULL THEN COALESCE(TRY_CAST(COALESCE(nullif(regexp_extract(t, '\{[^}]*"prediction"\s*:\s*([01])[^}]*"confidence"\s*:\s*([\d.]+)[^}]*\}', 2), ''), nullif(regexp_extract(t, '\{[^}]*"confidence"\s*:\s*([\d.]+)[^}]*"prediction"\s*:\s*([01])[^}]*\}', 1), '')) AS DOUBLE), 0.5::DOUBLE) END AS confidence FROM a)
SELECT conv_id, turn, prediction, confidence, round_even(CASE WHEN prediction = 1 THEN confidence ELSE 1 - confidence END * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE AS score FROM b""",
    "text_summary": _WIN + f""",
en AS (SELECT w.start_s, u.* FROM win w JOIN tel_u u ON u.route_id = w.route_id AND u.time_s BETWEEN w.start_s - 0.5 AND w.start_s + 5.5 WHERE w.route_id % 11 <> 0),
ve AS (SELECT route_id, start_s, {_H("avg(a_ego)", 8)} AS mean, max(abs(a_ego)) AS peak, {_AT("a", "start_s")}, {_AT("m", "(start_s + 2.5)")}, {_AT("z", "(start_s + 5.0)")} FROM en GROUP BY route_id, start_s),
ra AS (SELECT route_id, start_s, {_AT("z", "(start_s + 5.0)")} FROM en WHERE i % 2 = 0 GROUP BY route_id, start_s),
pl AS (SELECT route_id, start_s, {_AT("z", "(start_s + 5.0)")} FROM en WHERE i % 3 = 0 GROUP BY route_id, start_s),
im AS (SELECT route_id, start_s, avg(k) AS k FROM en WHERE route_id % 2 = 0 GROUP BY route_id, start_s),
tx AS (
SELECT route_id, start_s, 0 AS place, '## Vehicle (5.0s window)\nSpeed: ' || {_THREE("v_ego")} || ' m/s | Accel: mean=' || {_N("mean", 1)} || ', peak=' || {_N("peak", 1)} || ' m/s²\nSteering: ' || {_THREE("steer")} || ' deg | Brake: ' || CASE WHEN z.brake > 0.5 THEN 'ON' ELSE 'OFF' END || ' | Gas: ' || {_N("z.k / 128.0::DOUBLE", 2)}
 || '\nBlinkers: ' || CASE WHEN z.left_blinker > 0.5 THEN 'left' WHEN z.k % 5 = 0 THEN 'right' ELSE 'none' END || ' | DAS: enabled=' || CASE WHEN z.cruise_en > 0.5 THEN 'yes' ELSE 'no' END || ', lat_active=' || CASE WHEN z.cc_lat > 0.5 THEN 'yes' ELSE 'no' END AS t FROM ve
UNION ALL SELECT route_id, start_s, 1, '## Lead Vehicle\nLead #1: ' || CASE WHEN z.lead_status > 0.5 THEN 'detected, dist=' || {_N("z.d_rel", 1)} || 'm, rel_speed=' || {_N("(z.k - 50) / 8.0::DOUBLE", 1)} || ' m/s' ELSE 'not detected' END || '\nLead #2: ' || CASE WHEN z.k % 4 = 1 THEN 'detected, dist=' || {_N("z.d_rel * 2", 1)} || 'm' ELSE 'not detected' END FROM ra
UNION ALL SELECT route_id, start_s, 2, '## Driver State\nFace: detected (' || {_N("z.k / 128.0::DOUBLE", 2)} || ') | Yaw: ' || {_N("(z.k - 50) / 8.0::DOUBLE", 1)} || '° Pitch: ' || {_N("(50 - z.k) / 16.0::DOUBLE", 1)} || '°\nEyes: L=' || {_N("z.k / 256.0::DOUBLE", 2)} || ' R=' || {_N("z.k / 512.0::DOUBLE", 2)} FROM ve WHERE route_id % 5 <> 0
UNION ALL SELECT route_id, start_s, 3, '## Planning\nDesired curvature: ' || {_N("(z.k - 50) / 1024.0::DOUBLE", 3)} || ' | Lane change: ' || CASE WHEN z.lcs > 0 THEN 'state=2' ELSE 'none' END || '\nLane conf: L=' || {_N("z.k / 128.0::DOUBLE", 2)} || ' R=' || {_N("(100 - z.k) / 128.0::DOUBLE", 2)} FROM pl
UNION ALL SELECT route_id, start_s, 4, '## IMU\nAccel: ' || {" || ' ' || ".join(f"'{x}=' || " + _N(_H(f"(k - {n}) / 64.0::DOUBLE", 8), 1) for x, n in (("x", 50), ("y", 20), ("z", 90)))} || ' | Gyro: ' || {" || ' ' || ".join(f"'{x}=' || " + _N(_H(f"(k - {n}) / 512.0::DOUBLE", 8), 2) for x, n in (("x", 50), ("y", 20), ("z", 90)))} FROM im),
jo AS (SELECT route_id, start_s, string_agg(t, '\n\n' ORDER BY place) AS t FROM tx GROUP BY route_id, start_s)
SELECT w.route_id, w.start_s, w.start_s + 5.0::DOUBLE AS end_s, COALESCE(t, '[Sensor data unavailable]') AS context FROM win w LEFT JOIN jo ON jo.route_id = w.route_id AND jo.start_s = w.start_s""",
    "modality_columns": views.with_views("tel_u") + " SELECT route_id, i, " + ", ".join(f"{_SIGNAL(c)} AS {c}" for c in columns_of(MODALITY)) + " FROM tel_u WHERE route_id % 11 <> 0",
    "metric_map": _BINARY + f"""
SELECT metric, {_H("CAST(value AS DOUBLE)", 6)} AS value FROM (
 SELECT 'auc_roc' AS metric, (SELECT count(*) FILTER (a.s > b.s) + count(*) FILTER (a.s = b.s) / 2.0::DOUBLE FROM te a, te b WHERE a.y = 1 AND b.y = 0) / (n_pos * n_neg) AS value FROM tn
 UNION ALL SELECT 'auprc', (SELECT sum(p * tp / (tp + fp)) FROM tc) / n_pos FROM tn
 UNION ALL SELECT 'f1', 2.0::DOUBLE * count(*) FILTER (y = 1 AND s >= t) / (count(*) FILTER (y = 1) + count(*) FILTER (s >= t)) FROM te, th
 UNION ALL SELECT 'accuracy', count(*) FILTER ((y = 1) = (s >= t)) / CAST(count(*) AS DOUBLE) FROM te, th
 UNION ALL SELECT 'threshold', t FROM th
 UNION ALL SELECT 'precision_at_recall_0.8', max(tp / CAST(tp + fp AS DOUBLE)) FROM tc, tn WHERE tp >= 0.8::DOUBLE * n_pos
 UNION ALL SELECT 'n_pos', n_pos FROM tn UNION ALL SELECT 'n_neg', n_neg FROM tn)""",
    "experiment_matrix": views.with_views("ev") + """,
dn AS (SELECT DISTINCT 'task' || (k % 3 + 1) AS task, event_type AS model, CASE WHEN k % 2 = 0 THEN 'struct' ELSE 'video' END AS modality FROM ev WHERE k < 4)
SELECT t.task, m.model, o.modality FROM (VALUES ('task1'), ('task2'), ('task3')) t(task), (VALUES ('click'), ('view'), ('gru')) m(model), (VALUES ('struct'), ('video'), ('gps')) o(modality) WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.task = t.task AND dn.model = m.model AND dn.modality = o.modality)""",
}
