"""Further queries: totals, quotas, frames of windows, range-join summaries, set operations; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES
from ..functions.numeric import half_even
from ..operators import events, features, gps, intervals, labels, metrics, reporting, roadgraph, samples, temporal
from ..operators.lineage import cut
from ..sources import views
from . import driving, signals


def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    s = driving.routes_summary(spark, d)
    return s.agg(F.count("*").alias("n_routes"), F.count_if(F.col("n_activations") + F.col("n_takeovers") > 0).alias("n_with_events"), F.sum("n_activations").alias("n_activations"), F.sum("n_takeovers").alias("n_takeovers"), half_even(F.sum("duration_s") / 3600, 4).alias("hours"))


def mode_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.histogram(driving.routes_summary(spark, d), "driving_mode")


def bounded_subset(spark: SparkSession, d: str) -> DataFrame:
    """A third of the windows, by the order of their hashes."""
    w = signals._windows(spark, d).select("route_id", "start_s", F.rint(F.col("start_s") * 1000).cast("long").alias("ms"))
    return samples.bounded_subset(w, ["route_id", "ms"], k=w.count() // 3).select("route_id", "start_s")


def logit_curve(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall at each distinct logit of -20 to 20: whether an event's next field is large, by its value."""
    e = views.table(spark, d, "events").select((F.col("value") > 50).cast("int").alias("y"), half_even((F.col("value") % 40) - 20, 1).alias("logit")).filter("logit is not null and y is not null")
    c = metrics.pr_curve(metrics.curve(e, "y", "logit"))
    return c.select("threshold", half_even(F.col("precision"), 8).alias("precision"), half_even(F.col("recall"), 8).alias("recall"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.value_counts(views.table(spark, d, "events"), "event_type")


def window_summary(spark: SparkSession, d: str) -> DataFrame:
    w = signals._windows(spark, d).withColumn("lo", F.col("start_s") - 0.5).withColumn("hi", F.col("start_s") + 5.5)
    j = intervals.interval_join(views.uniform(spark, d).select("route_id", "time_s", "a_ego"), w, ["route_id"], t="time_s", low="lo", high="hi", bucket=8.0)
    return j.groupBy("route_id", "start_s").agg(F.count("*").alias("n"), half_even(F.avg("a_ego"), 8).alias("mean"), F.max(F.abs("a_ego")).alias("peak"))


def window_interpolated(spark: SparkSession, d: str) -> DataFrame:
    probes = signals._windows(spark, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("time_s", F.col("start_s") + F.col("j") * 0.5 + 0.25)
    out = temporal.interpolate(probes, views.uniform(spark, d).select("route_id", "i", "time_s", "v_ego"), ["route_id"], value="v_ego")
    return out.select("route_id", "start_s", "j", half_even(F.col("v_ego"), 8).alias("v_ego"))


def window_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = views.uniform(spark, d).filter("k % 3 <> 0").select("route_id", "time_s", F.col("v_ego").alias("feature"))
    return samples.first_frames(signals._windows(spark, d).withColumn("end_s", F.col("start_s") + 5.0), frames, k=6)


def frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    return samples.frame_offsets(signals._windows(spark, d).withColumn("start_s", F.col("start_s") * 3))


def network_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths up to the horizon from every node of the town, by tiles."""
    nodes, edges = views.road_network(spark, d)
    return roadgraph.tiled_paths(edges, nodes, nodes, signals.TH.intersection_horizon_m)


def gps_context(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the traces with its trajectory and the road context of the town around it."""
    nodes, edges = views.road_network(spark, d)
    own = gps.clean(views.gps(spark, d), signals.TH)
    rows = cut(own.join(gps.trajectory(own, signals.TH).drop("time_s"), ["route_id", "i"]))
    points = rows.select("route_id", "i", "time_s", ((F.col("lon") + 75) * 84992.0).alias("px"), ((F.col("lat") - 40) * 111616.0).alias("py"), "heading_deg")
    road = roadgraph.trace_features(points, nodes, edges, signals.GRAPH)
    return rows.withColumnsRenamed({"gps_speed": "gps_speed_mps", "gps_hacc": "gps_hAcc"}).drop("source").join(road, ["route_id", "i"])


def _route_columns(spark: SparkSession, d: str) -> DataFrame:
    """Drivers and vehicles of routes, and whether each has events of a kind, as flags of its recordings."""
    kinds = zip(("has_qcamera", "has_dcamera", "has_radar", "has_driver_state", "has_gps", "has_imu"), CLASSES)
    flags = views.table(spark, d, "events").groupBy(F.col("user_id").alias("route_id")).agg(*(F.max((F.col("event_type") == kind).cast("int")).alias(flag) for flag, kind in kinds))
    owner = views.table(spark, d, "customer").select(F.col("c_custkey").alias("route_id"), F.col("c_nationkey").alias("driver_id"), F.col("c_mktsegment").alias("vehicle_model"))
    return flags.join(owner, "route_id", "left")


def _prediction(task: int, state: int, h: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found, none = (driving.QUERIES[f"task{task}_{kind}_h{h}"](spark, d) for kind in ("positives", "negatives"))
        return samples.prediction_rows(found, none, _route_columns(spark, d), prefix=f"T{task}", horizon=h, state=state, th=signals.TH)

    return query


def _prediction_sql(task: int, state: int, h: int) -> str:
    flags = ", ".join(f"max(CAST(event_type = '{kind}' AS INTEGER)) AS {flag}" for flag, kind in zip(("has_qcamera", "has_dcamera", "has_radar", "has_driver_state", "has_gps", "has_imu"), CLASSES))
    return f"""WITH al AS (SELECT route_id, start_s, end_s, nearest_event_s, 1 AS label FROM ({driving.ORACLE_SQL[f"task{task}_positives_h{h}"]}) UNION ALL SELECT route_id, start_s, end_s, NULL, 0 FROM ({driving.ORACLE_SQL[f"task{task}_negatives_h{h}"]})),
fl AS (SELECT user_id AS route_id, {flags} FROM events GROUP BY user_id)
SELECT 'T{task}_' || printf('%07d', row_number() OVER (ORDER BY al.route_id, label DESC, nearest_event_s, end_s)) AS sample_id, al.route_id, start_s AS start_time_sec, end_s AS end_time_sec, 5.0::DOUBLE AS input_window_sec, {h}.0::DOUBLE AS horizon_sec, label,
  {state} AS current_adas_state, nearest_event_s AS nearest_event_time, fl.* EXCLUDE (route_id), c_nationkey AS driver_id, c_mktsegment AS vehicle_model FROM al JOIN fl ON fl.route_id = al.route_id LEFT JOIN customer ON c_custkey = al.route_id"""


def sample_quota(spark: SparkSession, d: str) -> DataFrame:
    pos, neg = (q(spark, d).select("route_id", "start_s", F.lit(y).alias("label")) for y, q in ((1, driving.QUERIES["task2_positives_h3"]), (0, driving.QUERIES["task2_negatives_h3"])))
    return samples.quota(pos.unionByName(neg), total=60)


def duration_picks(spark: SparkSession, d: str) -> DataFrame:
    return samples.duration_picks(labels.bounds(views.uniform(spark, d)).select("route_id", (F.col("t1") - F.col("t0")).alias("duration_s")))


def one_hot_logits(spark: SparkSession, d: str) -> DataFrame:
    a = driving.action_labels(spark, d)
    return a.select("route_id", "timestamp", F.posexplode(reporting.one_hot(F.col("action_label"), CLASSES)).alias("class_id", "score")).filter("score > 0")


def file_names(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer").select(F.concat_ws("/", "c_mktsegment", "c_name").alias("route_id"))
    return c.select("route_id", reporting.file_name(F.col("route_id")).alias("file_name"), reporting.route_of(reporting.file_name(F.col("route_id"))).alias("back"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Users with clicks or purchases but without errors of a high value."""
    e = views.table(spark, d, "events")
    some = e.filter("event_type = 'click'").select("user_id").unionByName(e.filter("event_type = 'purchase'").select("user_id")).distinct()
    return some.exceptAll(e.filter("event_type = 'error' and value > 100").select("user_id").distinct())


def reenriched(spark: SparkSession, d: str) -> DataFrame:
    """Find shards without labels, fill them, put them in place of their own, and count again."""
    rows = signals._labelled(spark, d)
    todo = features.null_groups(rows, "shard", ["quality", "toxic"])
    fresh = rows.join(todo, "shard", "left_semi").withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    return features.coverage(features.upsert(rows, fresh, "shard"), "shard", "quality")


def first_event_of_route(spark: SparkSession, d: str) -> DataFrame:
    return intervals.first_of(events.transitions(driving._samples(spark, d), driving.TH), ["route_id"], ["time_s", "event_type"])


QUERIES = {f.__name__: f for f in (dataset_totals, bounded_subset, logit_curve, mode_histogram, value_counts, window_summary, window_interpolated, window_frames, frame_offsets, sample_quota, duration_picks, one_hot_logits, file_names, set_operations, reenriched, first_event_of_route, network_paths, gps_context)}
QUERIES |= {f"task{t}_samples_h{h}": _prediction(t, state, h) for t, state in ((2, 0), (3, 1)) for h in (1, 3, 5)}

_H = signals._H
_TOWN = "WITH RECURSIVE " + views.SQL["town"] + signals._paths(300)
_EDGE_BEARING = signals._MOD("degrees(atan2(sin(dl) * cos(lb), cos(la) * sin(lb) - sin(la) * cos(lb) * cos(dl))) + 360")
_SUM = "WITH s AS (" + driving.ORACLE_SQL["routes_summary"] + ")"
ORACLE_SQL = {
    "dataset_totals": _SUM + f" SELECT count(*) AS n_routes, count(*) FILTER (n_activations + n_takeovers > 0) AS n_with_events, CAST(sum(n_activations) AS BIGINT) AS n_activations, CAST(sum(n_takeovers) AS BIGINT) AS n_takeovers, {_H('sum(duration_s) / 3600', 4)} AS hours FROM s",
    "mode_histogram": _SUM + f" SELECT driving_mode, count(*) AS n, {_H('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()', 2)} AS pct FROM s GROUP BY driving_mode",
    "value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "window_summary": signals._WIN + f" SELECT w.route_id, w.start_s, count(*) AS n, {_H('avg(a_ego)', 8)} AS mean, max(abs(a_ego)) AS peak FROM win w JOIN tel_u u ON u.route_id = w.route_id AND u.time_s BETWEEN w.start_s - 0.5 AND w.start_s + 5.5 GROUP BY w.route_id, w.start_s",
    "window_interpolated": signals._WIN + f""",
p AS (SELECT route_id, start_s, CAST(j AS INTEGER) AS j, start_s + j * 0.5::DOUBLE + 0.25::DOUBLE AS t FROM (SELECT *, unnest(generate_series(0, 9)) AS j FROM win)),
p1 AS (SELECT p.*, u.time_s AS ta, u.v_ego AS va FROM p ASOF LEFT JOIN tel_u u ON u.route_id = p.route_id AND p.t >= u.time_s),
p2 AS (SELECT p1.*, u.time_s AS tb, u.v_ego AS vb FROM p1 ASOF LEFT JOIN tel_u u ON u.route_id = p1.route_id AND p1.t <= u.time_s)
SELECT route_id, start_s, j, {_H("CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * ((t - ta) / (tb - ta)) END", 8)} AS v_ego FROM p2""",
    "window_frames": signals._WIN + """,
fr AS (SELECT w.route_id, w.start_s, u.v_ego, row_number() OVER (PARTITION BY w.route_id, w.start_s ORDER BY u.time_s) - 1 AS slot FROM win w JOIN tel_u u ON u.route_id = w.route_id AND u.time_s >= w.start_s AND u.time_s < w.start_s + 5 WHERE u.k % 3 <> 0)
SELECT w.route_id, w.start_s, CAST(w.slot AS INTEGER) AS slot, COALESCE(fr.v_ego, 0.0) AS feature FROM (SELECT *, unnest(generate_series(0, 5)) AS slot FROM win) w LEFT JOIN fr ON fr.route_id = w.route_id AND fr.start_s = w.start_s AND fr.slot = w.slot""",
    "frame_offsets": signals._WIN + " SELECT route_id, start_s * 3 AS start_s, o AS offset_s, CAST(floor((start_s * 3 + o) / 60) AS INTEGER) AS segment, (start_s * 3 + o) % 60 AS seek_s FROM win, (VALUES (0.5::DOUBLE), (2.5::DOUBLE), (4.5::DOUBLE)) v(o)",
    "sample_quota": "WITH al AS (SELECT route_id, start_s, 1 AS label FROM (" + driving.ORACLE_SQL["task2_positives_h3"] + ") UNION ALL SELECT route_id, start_s, 0 FROM (" + driving.ORACLE_SQL["task2_negatives_h3"] + "))" + driving._greedy("th", "(SELECT DISTINCT label, route_id, start_s FROM al)", "label, route_id", "start_s", "5.0") + """,
q AS (SELECT greatest(CAST(trunc(avg(label) * 60) AS INTEGER), 20) AS g FROM al),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || route_id || ':' || CAST(start_s * 1000 AS BIGINT)), route_id, start_s) AS rn FROM th)
SELECT label, route_id, start_s FROM rk, q WHERE rn <= CASE WHEN label = 1 THEN g ELSE 60 - g END""",
    "duration_picks": views.with_views("tel_u") + ", b AS (SELECT route_id, max(time_s) - min(time_s) AS dur FROM tel_u GROUP BY route_id HAVING count(*) >= 2), r AS (SELECT route_id, row_number() OVER (ORDER BY dur, route_id) - 1 AS r, count(*) OVER () AS n FROM b) SELECT CASE WHEN r = 0 THEN 'short' WHEN r = n // 2 THEN 'median' ELSE 'long' END AS pick, route_id FROM r WHERE r IN (0, n // 2, n - 1)",
    "one_hot_logits": driving._STATE + driving._LABELS + " SELECT route_id, timestamp, CAST(list_position([" + ", ".join(f"'{c}'" for c in CLASSES) + "], action_label) - 1 AS INTEGER) AS class_id, 1.0::DOUBLE AS score FROM lab",
    "bounded_subset": signals._WIN + " SELECT route_id, start_s FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || route_id || ':' || CAST(round_even(start_s * 1000, 0) AS BIGINT))) AS rn, count(*) OVER () AS n FROM win) WHERE rn <= n // 3",
    "logit_curve": f"WITH e AS (SELECT CAST(value > 50 AS INTEGER) AS y, {signals._H('value % 40 - 20', 1)} AS s FROM events WHERE value IS NOT NULL), g AS (SELECT s, sum(y) AS p, count(*) AS n FROM e GROUP BY s), c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS np FROM g WINDOW w AS (ORDER BY s DESC)) SELECT s AS threshold, {signals._H('CASE WHEN k = 0 THEN 0 ELSE tp::DOUBLE / k END', 8)} AS precision, {signals._H('CASE WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END', 8)} AS recall FROM c",
    **{f"task{t}_samples_h{h}": _prediction_sql(t, state, h) for t, state in ((2, 0), (3, 1)) for h in (1, 3, 5)},
    "network_paths": _TOWN + " SELECT * FROM paths",
    "gps_context": _TOWN + f""",
cc AS ({signals.ORACLE_SQL["gps_clean"]}), tj AS ({signals.ORACLE_SQL["gps_trajectory"]}),
pp AS (SELECT cc.route_id, cc.i, cc.time_s, lat, lon, gps_speed, gps_hacc, tj.* EXCLUDE (route_id, i, time_s), (lon + 75) * 84992.0::DOUBLE AS px, (lat - 40) * 111616.0::DOUBLE AS py,
  row_number() OVER (PARTITION BY cc.route_id ORDER BY cc.time_s, cc.i) - 1 AS rn, count(*) OVER (PARTITION BY cc.route_id) AS cnt FROM cc JOIN tj ON tj.route_id = cc.route_id AND tj.i = cc.i),
eg AS (SELECT e.*, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy, radians(a.lat) AS la, radians(b.lat) AS lb, radians(b.lon - a.lon) AS dl, {signals._limit_sql("maxspeed")} AS own, {signals._class_sql("highway")} AS road_type FROM edges e JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
eb AS (SELECT *, {_EDGE_BEARING} AS bearing FROM eg),
pe AS (SELECT route_id, i, px, py, x1, y1, dx, dy, u, v, key, greatest(0.0, least(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) AS s FROM pp JOIN eg ON px BETWEEN least(x1, x1 + dx) - 61 AND greatest(x1, x1 + dx) + 61 AND py BETWEEN least(y1, y1 + dy) - 61 AND greatest(y1, y1 + dy) + 61),
pd AS (SELECT route_id, i, u, v, key, sqrt((px - (x1 + s * dx)) * (px - (x1 + s * dx)) + (py - (y1 + s * dy)) * (py - (y1 + s * dy))) AS dist FROM pe),
pm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, i ORDER BY dist, u, v, key) AS nth FROM pd WHERE dist <= 60) WHERE nth = 1),
rw AS (SELECT pp.*, eb.u, eb.v, eb.key, eb.road_type, eb.own, eb.bearing, CAST(eb.road_type = 'motorway' AS INTEGER) AS is_highway, CAST(eb.highway LIKE '%link%' AS INTEGER) AS is_on_ramp, CAST(trunc(TRY_CAST(eb.lanes AS DOUBLE)) AS INTEGER) AS n_lanes, abs({signals._TURN("heading_deg", "eb.bearing")}) AS off
  FROM pp LEFT JOIN pm ON pm.route_id = pp.route_id AND pm.i = pp.i LEFT JOIN eb ON eb.u = pm.u AND eb.v = pm.v AND eb.key = pm.key),
hd AS (SELECT src, count(*) AS n FROM paths WHERE dist <= 200 GROUP BY src),
nr AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM paths) WHERE rn <= 50),
ou AS (SELECT n.src, eb.road_type AS rc, eb.highway LIKE '%link%' AS lk, eb.own AS sl FROM nr n JOIN eb ON eb.u = n.dst WHERE EXISTS (SELECT 1 FROM paths p WHERE p.src = n.src AND p.dst = eb.v)),
oc AS (SELECT src, CAST(count(DISTINCT rc) > 1 AS INTEGER) AS rt, max(CAST(lk AS INTEGER)) AS ra, min(sl) AS ll FROM ou GROUP BY src),
nc AS (SELECT p.src, count(*) FILTER (d.degree >= 5 AND p.dist > 0) AS n_ahead, {_H("COALESCE(min(CASE WHEN d.degree >= 5 AND p.dist > 0 THEN p.dist END), 300)", 1)} AS d_ahead FROM paths p LEFT JOIN deg d ON d.node_id = p.dst GROUP BY p.src),
nx AS (SELECT src, min(dist) AS d FROM paths JOIN deg ON node_id = dst WHERE degree >= 5 AND dist <= 200 GROUP BY src),
ed AS (SELECT e.u, e.v, e.key, CASE WHEN a.degree >= 5 OR b.degree >= 5 THEN least(999.0, length * 0.5) ELSE 999.0::DOUBLE END AS half, x.d AS dx, y.d AS dy FROM edges e JOIN deg a ON a.node_id = e.u JOIN deg b ON b.node_id = e.v LEFT JOIN nx x ON x.src = e.u LEFT JOIN nx y ON y.src = e.v),
ei AS (SELECT u, v, key, CASE WHEN half > 100 THEN least(half, dx, dy) ELSE half END AS di FROM ed),
sp AS (SELECT rw.route_id, rw.rn, {_H("COALESCE(di, 999)", 1)} AS dist_to_intersection_m, CAST(COALESCE(di < 50, false) AS INTEGER) AS is_near_intersection, COALESCE(greatest(a.n, b.n), 0) AS road_network_density, COALESCE(d_ahead, 300.0::DOUBLE) AS hw_dist_to_intersection_m,
  COALESCE(n_ahead, 0) AS hw_n_intersections_300m, COALESCE(rt, 0) AS hw_road_type_changes, COALESCE(ra, 0) AS hw_is_ramp_ahead_300m, CAST(COALESCE(ll < own - 5, false) AS INTEGER) AS hw_speed_limit_decreases
  FROM rw LEFT JOIN ei ON ei.u = rw.u AND ei.v = rw.v AND ei.key = rw.key LEFT JOIN hd a ON a.src = rw.u LEFT JOIN hd b ON b.src = rw.v LEFT JOIN nc ON nc.src = CASE WHEN off < 90 THEN rw.v ELSE rw.u END LEFT JOIN oc ON oc.src = CASE WHEN off < 90 THEN rw.v ELSE rw.u END)
SELECT rw.route_id, i, time_s, lat, lon, gps_speed AS gps_speed_mps, gps_hacc AS "gps_hAcc", heading_deg, heading_change_rate, curvature, traj_speed_mps, is_stopped, stopped_duration_s, road_type, is_highway, own AS speed_limit_kph, n_lanes, is_on_ramp, {_H("off", 2)} AS bearing_vs_road, sp.* EXCLUDE (route_id, rn)
FROM rw JOIN sp ON sp.route_id = rw.route_id AND sp.rn = CASE WHEN rw.rn = cnt - 1 THEN rw.rn ELSE rw.rn - rw.rn % 10 END""",
    "file_names": "SELECT c_mktsegment || '/' || c_name AS route_id, replace(c_mktsegment || '/' || c_name, '/', '__') AS file_name, c_mktsegment || '/' || c_name AS back FROM customer",
    "set_operations": "SELECT user_id FROM events WHERE event_type IN ('click', 'purchase') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100",
    "reenriched": signals._LABELLED + ", g AS (SELECT shard, count(quality) + count(toxic) = 0 AS lone FROM lb GROUP BY shard) SELECT shard, count(*) AS n_rows, count(CASE WHEN lone THEN doc_id % 2 ELSE quality END) AS n_values, bool_or(CASE WHEN lone THEN doc_id IS NOT NULL ELSE quality IS NOT NULL END) AS covered FROM lb JOIN g USING (shard) GROUP BY shard",
    "first_event_of_route": driving._EVENTS + " SELECT route_id, event_type, time_s FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY time_s, event_type) AS rn FROM tr) WHERE rn = 1",
}
