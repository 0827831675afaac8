"""Queries on state, events, labels, samples and splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Thresholds
from ..operators import events, labels, samples, splits, temporal
from ..operators.lineage import cut
from ..sources import views

TH = Thresholds(sample_rate=2.0)  #: the uniform view's clock


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return events.engaged(views.uniform(spark, d))


def _radar(spark: SparkSession, d: str) -> DataFrame:
    """Every second sample: a stream on another clock."""
    return views.uniform(spark, d).filter("i % 2 = 0").select("route_id", "i", "time_s", "lead_status", "d_rel")


def routes_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.route_summary(events.long_enough(_samples(spark, d), TH.min_rows), TH)


def transition_events(spark: SparkSession, d: str) -> DataFrame:
    return events.numbered(cut(events.transitions(_samples(spark, d), TH))).select("event_id", "route_id", "event_type", "time_s")


def debounced_runs(spark: SparkSession, d: str) -> DataFrame:
    return temporal.debounced_runs(_samples(spark, d), ["route_id"], min_samples=int(TH.debounce_s * TH.sample_rate))


def episodes_merged(spark: SparkSession, d: str) -> DataFrame:
    return events.episodes(_samples(spark, d), TH)


def raw_state_segments(spark: SparkSession, d: str) -> DataFrame:
    return events.state_segments(_samples(spark, d))


def greedy_gap_events(spark: SparkSession, d: str) -> DataFrame:
    x = views.irregular(spark, d).filter("event_type in ('click', 'view')").select("route_id", "event_type", "time_s")
    return temporal.greedy_gap(x, ["route_id", "event_type"], "time_s", 24.0)


def greedy_gap_hot(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views of all users as one route, dealt over tasks by time."""
    x = views.irregular(spark, d).filter("event_type in ('click', 'view')").select((F.col("route_id") * 0).cast("int").alias("route_id"), "time_s")
    return temporal.greedy_gap_dealt(x, ["route_id"], "time_s", 24.0)


def asof_hot_route(spark: SparkSession, d: str) -> DataFrame:
    """Each error with the last purchase before it and the next one after it, of all users as one route, dealt over tasks by time."""
    x = views.irregular(spark, d).withColumn("route_id", F.lit(0))
    bought = x.filter("event_type = 'purchase'").select("route_id", "time_s", "i", F.col("value").alias("v"))
    errors = x.filter("event_type = 'error'").select("route_id", F.col("i").alias("error_id"), "time_s")
    back = temporal.asof_backward(errors, bought, ["route_id"], cols=["v"], at="before_s", bucket=48.0).withColumnRenamed("v", "before_v")
    return temporal.asof_forward(back, bought, ["route_id"], cols=["v"], at="after_s", clamp=False, bucket=48.0).select("error_id", "time_s", "before_s", "before_v", "after_s", F.col("v").alias("after_v"))


def grid_1hz_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return labels.sampled_signals(_samples(spark, d), _radar(spark, d))


def asof_backward_state(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    probes = labels.second_centres(s)
    return temporal.asof_backward(probes, events.state_changes(s), ["route_id"], cols=["state"], at="since_s")


def asof_nearest_row(spark: SparkSession, d: str) -> DataFrame:
    x = views.irregular(spark, d)
    errors = x.filter("event_type = 'error'").select("route_id", F.col("i").alias("error_id"), "time_s")
    bought = x.filter("event_type = 'purchase'").select("route_id", "i", "time_s", F.col("i").alias("purchase_id"), "value")
    return temporal.asof_nearest(errors, bought, ["route_id"], cols=["purchase_id", "value"], at="purchase_s")


def action_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.action_labels(_samples(spark, d), _radar(spark, d), TH)


def action_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.histogram(action_labels(spark, d), "action_label")


def task1_windows_majority(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    w = labels.majority_windows(action_labels(spark, d), labels.bounds(s), TH)
    at = temporal.asof_backward(w.withColumn("time_s", F.col("end_s")), events.state_changes(s), ["route_id"], cols=["state"])
    return at.select("route_id", "start_s", "end_s", "label", F.col("state").alias("current_adas_state"))


def task1_sample_ids(spark: SparkSession, d: str) -> DataFrame:
    """The samples of task 1, numbered in the order of their routes and starts."""
    found = temporal.sequential_ids(cut(task1_windows_majority(spark, d)), "route_id", ["start_s"], prefix="T1", width=7, name="sample_id")
    return found.select("sample_id", "route_id", "start_s", "end_s", F.lit(TH.input_window_s).cast("double").alias("input_window_sec"), "label", "current_adas_state")


def _positives(kind: str, state: int, horizon: float):
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = _samples(spark, d)
        found = events.transitions(s, TH).filter(F.col("event_type") == kind)
        return samples.positives(found, events.state_changes(s), labels.bounds(s), horizon=horizon, state=state, th=TH)

    return query


def _negatives(kind: str, state: int, horizon: float):
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = _samples(spark, d)
        found = events.transitions(s, TH).filter(F.col("event_type") == kind)
        return samples.negatives(found, events.state_segments(s), labels.bounds(s), horizon=horizon, state=state, th=TH)

    return query


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as routes, customers as drivers, market segments as vehicle models."""
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("driver_id"), (F.col("o_orderkey") % 3).alias("n_activations"), (F.col("o_orderkey") % 4).alias("n_takeovers"))
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("driver_id"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("vehicle_model"))
    return o.join(c, "driver_id")


def split_by_driver(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_by_key(_routes(spark, d), "driver_id", seed=42)


def split_by_vehicle(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_by_key(_routes(spark, d), "vehicle_model", seed=43)


def split_random(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_random(_routes(spark, d), "route_id", seed=44)


def split_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.counters(_routes(spark, d), split_by_driver(spark, d), "driver_id")


def split_leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return splits.leakage(_routes(spark, d), split_random(spark, d), "route_id", ["driver_id", "vehicle_model"])


def stratified_sample_gap(spark: SparkSession, d: str) -> DataFrame:
    return samples.stratified(task1_windows_majority(spark, d), strata="label", per_stratum=50, min_gap=5.0)


QUERIES = {
    f.__name__: f
    for f in (routes_summary, transition_events, debounced_runs, episodes_merged, raw_state_segments, greedy_gap_events, greedy_gap_hot, grid_1hz_asof_forward, asof_backward_state, asof_nearest_row, asof_hot_route, action_labels, action_histogram, task1_windows_majority, task1_sample_ids, split_by_driver, split_by_vehicle, split_random, split_event_counts, split_leakage_check, stratified_sample_gap)
}
for _h in (1, 3, 5):
    QUERIES[f"task2_positives_h{_h}"] = _positives("activation", 0, float(_h))
    QUERIES[f"task3_positives_h{_h}"] = _positives("takeover", 1, float(_h))
    QUERIES[f"task2_negatives_h{_h}"] = _negatives("activation", 0, float(_h))
    QUERIES[f"task3_negatives_h{_h}"] = _negatives("takeover", 1, float(_h))

# The same in SQL.
_W = "OVER (PARTITION BY route_id ORDER BY time_s, i)"
_R = "OVER (PARTITION BY route_id ORDER BY {0})"
_STATE = views.with_views("tel_u") + """,
st AS (SELECT *, CAST(COALESCE(cc_lat = 1 OR cruise_en = 1, false) AS INTEGER) AS state FROM tel_u),
radar AS (SELECT route_id, i, time_s, lead_status, d_rel FROM tel_u WHERE i % 2 = 0)"""
_RUNS = _STATE + f""",
r0 AS (SELECT *, CASE WHEN lag(state) {_W} IS NOT DISTINCT FROM state AND i > 0 THEN 0 ELSE 1 END AS f FROM st),
r1 AS (SELECT *, sum(f) OVER (PARTITION BY route_id ORDER BY time_s, i ROWS UNBOUNDED PRECEDING) AS run FROM r0),
r2 AS (SELECT route_id, CAST(run AS INTEGER) AS run, min(time_s) AS start_s, max(time_s) AS end_s, CAST(count(*) AS INTEGER) AS n, min(state) AS raw_state FROM r1 GROUP BY route_id, run),
r3 AS (SELECT *, CASE WHEN n >= 2 OR run = 1 OR run = max(run) OVER (PARTITION BY route_id) THEN raw_state END AS keep FROM r2),
runs AS (SELECT route_id, run, start_s, end_s, n, raw_state, last_value(keep IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS state FROM r3)"""


def _merge(name: str, source: str) -> str:
    return f""",
{name}_a AS (SELECT *, CASE WHEN lag(state) {_R.format("start_s")} = state THEN 0 ELSE 1 END AS f FROM {source}),
{name}_b AS (SELECT *, sum(f) OVER (PARTITION BY route_id ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT route_id, min(start_s) AS start_s, max(end_s) AS end_s, CAST(sum(n) AS INTEGER) AS n, min(state) AS state FROM {name}_b GROUP BY route_id, g)"""


def _greedy(name: str, source: str, keys: str, t: str, gap: str) -> str:
    return f""",
{name}_l AS (SELECT {keys}, list_transform(list_sort(list({t})), lambda x: [x]) AS l FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, unnest(list_reduce(l, lambda a, b: CASE WHEN b[1] - a[len(a)] >= {gap} THEN list_concat(a, b) ELSE a END)) AS {t} FROM {name}_l)"""


_EPISODES = _RUNS + _merge("e1", "runs") + """,
e2 AS (SELECT * FROM e1 WHERE n / 2.0::DOUBLE >= CASE WHEN state = 1 THEN 2.0 ELSE 1.0 END)""" + _merge("eps", "e2")
_EVENTS = _EPISODES + f""",
t0 AS (SELECT route_id, start_s AS time_s, state, lag(state) {_R.format("start_s")} AS was FROM eps),
t1 AS (SELECT route_id, CASE WHEN state = 1 THEN 'activation' ELSE 'takeover' END AS event_type, time_s FROM t0 WHERE was IS NOT NULL AND was <> state)""" + _greedy("tr", "t1", "route_id, event_type", "time_s", "2.0")
_BOUNDS = """,
bounds AS (SELECT route_id, min(time_s) AS t0, max(time_s) AS t1 FROM st GROUP BY route_id HAVING count(*) >= 2),
chg AS (SELECT route_id, i, time_s, state FROM (SELECT *, lag(state) OVER (PARTITION BY route_id ORDER BY time_s, i) AS was FROM st) WHERE was IS NULL OR was <> state),
seg AS (SELECT c.route_id, c.time_s AS start_s, COALESCE(lead(c.time_s) OVER (PARTITION BY c.route_id ORDER BY c.time_s, c.i), e.e) AS end_s, c.state FROM chg c JOIN (SELECT route_id, max(time_s) AS e FROM st GROUP BY route_id) e USING (route_id))"""
_GRID = _BOUNDS + """,
grid AS (SELECT route_id, CAST(s AS INTEGER) AS s, t0 + 0.5 + s AS time_s FROM (SELECT route_id, t0, unnest(generate_series(0, CAST(trunc(t1 - t0) AS INTEGER) - 1)) AS s FROM bounds WHERE trunc(t1 - t0) >= 1)),
first_of AS (SELECT route_id, time_s, min_by(st, i) AS r FROM st GROUP BY route_id, time_s),
last_of AS (SELECT route_id, max_by(st, i) AS r FROM st GROUP BY route_id),
rfirst AS (SELECT route_id, time_s, min_by(radar, i) AS r FROM radar GROUP BY route_id, time_s),
rlast AS (SELECT route_id, max_by(radar, i) AS r FROM radar GROUP BY route_id),
sig0 AS (SELECT g.route_id, g.s, g.time_s, COALESCE(f.r, l.r) AS v FROM grid g ASOF LEFT JOIN first_of f ON g.route_id = f.route_id AND g.time_s <= f.time_s LEFT JOIN last_of l ON l.route_id = g.route_id),
sig AS (SELECT g.route_id, g.s, g.time_s, g.v.v_ego AS v_ego, g.v.a_ego AS a_ego, g.v.steer AS steer, g.v.brake AS brake, g.v.lcs AS lcs, g.v.left_blinker AS left_blinker, g.v.state AS state, COALESCE(f.r, l.r).lead_status AS lead_status, COALESCE(f.r, l.r).d_rel AS d_rel
  FROM sig0 g ASOF LEFT JOIN rfirst f ON g.route_id = f.route_id AND g.time_s <= f.time_s LEFT JOIN rlast l ON l.route_id = g.route_id)"""
_RE = lambda x, d: f"round_even({x}, {d})"
_H = lambda x, d: f"(round_even({x} * {10**d}.0::DOUBLE, 0) / {10**d}.0::DOUBLE)"
_P = lambda x, d: f"printf('%.{d}f', {_H(x, d)})"
_LABELS = _GRID + f""",
lab AS (SELECT route_id, {_H("time_s", 1)} AS timestamp,
 CASE WHEN v_ego < 0.5 THEN 'Stopped' WHEN lcs > 0 OR (left_blinker > 0 AND abs(steer) > 5) THEN 'LaneChange' WHEN abs(steer) > 10 THEN 'Turning'
  WHEN a_ego < -0.35::DOUBLE OR brake > 0 THEN 'Braking' WHEN a_ego > 0.37::DOUBLE THEN 'Accelerating' WHEN COALESCE(lead_status, 0) > 0 AND COALESCE(d_rel, 999) < 60 AND abs(a_ego) < 1 THEN 'CarFollowing' ELSE 'Cruising' END AS action_label,
 CASE WHEN v_ego < 0.5 THEN 'vEgo<0.5' WHEN lcs > 0 OR (left_blinker > 0 AND abs(steer) > 5) THEN 'lcs=' || lcs || ',blink=' || left_blinker || ',steer=' || {_P("abs(steer)", 0)} WHEN abs(steer) > 10 THEN '|steer|=' || {_P("abs(steer)", 1)} || '>10.0'
  WHEN a_ego < -0.35::DOUBLE THEN 'aEgo=' || {_P("a_ego", 2)} || '<-0.35' WHEN brake > 0 THEN 'brakePressed' WHEN a_ego > 0.37::DOUBLE THEN 'aEgo=' || {_P("a_ego", 2)} || '>0.37' WHEN COALESCE(lead_status, 0) > 0 AND COALESCE(d_rel, 999) < 60 AND abs(a_ego) < 1 THEN 'lead_d=' || {_P("d_rel", 0)} || 'm' ELSE 'default' END AS action_source_rule,
 state AS adas_active, {_H("v_ego", 2)} AS vego, {_H("a_ego", 2)} AS aego, {_H("steer", 1)} AS steer_deg FROM sig)"""
_TASK1 = _LABELS + """,
wb AS (SELECT route_id, t0, t0 + k * 0.5::DOUBLE AS start_s, t0 + 5 + k * 0.5::DOUBLE AS end_s FROM (SELECT route_id, t0, unnest(generate_series(0, CAST(floor((t1 - t0 - 5) / 0.5) AS INTEGER))) AS k FROM bounds WHERE t1 - t0 >= 6)),
votes AS (SELECT w.route_id, w.start_s, w.end_s, l.action_label, count(*) AS n, min(l.timestamp) AS f FROM wb w JOIN lab l ON l.route_id = w.route_id AND l.timestamp >= w.start_s AND l.timestamp < w.end_s GROUP BY ALL),
win AS (SELECT route_id, start_s, end_s, action_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY route_id, start_s ORDER BY n DESC, f) AS rn FROM votes) WHERE rn = 1),
task1 AS (SELECT w.route_id, w.start_s, w.end_s, w.label, c.state AS current_adas_state FROM win w ASOF JOIN chg c ON c.route_id = w.route_id AND w.end_s >= c.time_s)"""


def _pos_sql(kind: str, state: int, h: int) -> str:
    return _EVENTS + _BOUNDS + f""",
p0 AS (SELECT e.route_id, e.time_s AS ev, greatest(b.t0 + 5, e.time_s - {h}) AS f FROM tr e JOIN bounds b USING (route_id) WHERE e.event_type = '{kind}' AND b.t1 - b.t0 >= 6 + {h}),
p1 AS (SELECT route_id, ev, f + k * 0.5::DOUBLE AS t FROM (SELECT *, unnest(generate_series(0, CAST(floor((ev - f) / 0.5) AS INTEGER))) AS k FROM p0 WHERE f <= ev))
SELECT p.route_id, p.t - 5 AS start_s, p.t AS end_s, p.ev AS nearest_event_s FROM p1 p ASOF JOIN chg c ON c.route_id = p.route_id AND p.t >= c.time_s WHERE c.state = {state}"""


def _neg_sql(kind: str, state: int, h: int) -> str:
    return _EVENTS + _BOUNDS + f""",
ne AS (SELECT route_id, count(*) AS n FROM tr WHERE event_type = '{kind}' GROUP BY route_id),
n0 AS (SELECT s.route_id, ne.n, greatest(s.start_s, b.t0) + 5 AS f, s.end_s - {h} AS l FROM seg s JOIN bounds b USING (route_id) JOIN ne USING (route_id) WHERE s.state = {state} AND b.t1 - b.t0 >= 6 + {h}),
n1 AS (SELECT route_id, n, f + k * 2.0::DOUBLE AS t FROM (SELECT *, unnest(generate_series(0, CAST(floor((l - f) / 2.0) AS INTEGER))) AS k FROM n0 WHERE f <= l)),
n2 AS (SELECT * FROM n1 WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.route_id = n1.route_id AND tr.event_type = '{kind}' AND tr.time_s BETWEEN n1.t - 2 AND n1.t + {h} + 2)),
n3 AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY md5('42:' || route_id || ':' || CAST(t * 1000 AS BIGINT)), t) AS rn FROM n2)
SELECT route_id, t - 5 AS start_s, t AS end_s FROM n3 WHERE rn <= least(n * {int(h / 0.5) * 15}, 1000)"""


_ROUTES = """WITH routes AS (SELECT o_custkey AS driver_id, o_orderkey AS route_id, o_orderkey % 3 AS n_activations, o_orderkey % 4 AS n_takeovers, c_mktsegment || '-' || c_nationkey AS vehicle_model FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _split_sql(key: str, seed: int) -> str:
    return f""",
k0 AS (SELECT {key}, count(*) AS n FROM routes GROUP BY {key}),
k1 AS (SELECT *, COALESCE(sum(n) OVER (ORDER BY md5('{seed}:' || {key}), {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS a FROM k0),
k2 AS (SELECT *, b < trunc(a * 0.7::DOUBLE) AS tr FROM k1),
parts AS (SELECT {key}, CASE WHEN tr THEN 'train' WHEN b - sum(CASE WHEN tr THEN n ELSE 0 END) OVER () < trunc(a * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM k2)"""


_RANDOM = """,
q AS (SELECT route_id, row_number() OVER (ORDER BY md5('44:' || route_id), route_id) - 1 AS rk, count(*) OVER () AS a FROM routes),
rp AS (SELECT route_id, CASE WHEN rk < trunc(a * 0.7::DOUBLE) THEN 'train' WHEN rk < trunc(a * 0.7::DOUBLE) + trunc(a * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM q)"""
ORACLE_SQL = {
    "routes_summary": _EVENTS + f""",
fx AS (SELECT route_id, count(*) AS n_rows, max(time_s) - min(time_s) AS d, avg(state) AS sh FROM st GROUP BY route_id HAVING count(*) >= 10),
ec AS (SELECT route_id, count(*) FILTER (event_type = 'activation') AS a, count(*) FILTER (event_type = 'takeover') AS t FROM tr GROUP BY route_id)
SELECT route_id, n_rows, {_H("d", 1)} AS duration_s, {_H("sh", 4)} AS adas_frac, COALESCE(a, 0) AS n_activations, COALESCE(t, 0) AS n_takeovers, CASE WHEN sh >= 0.7::DOUBLE THEN 'ADAS-dominant' WHEN sh <= 0.1::DOUBLE THEN 'Human-only' ELSE 'Mixed' END AS driving_mode FROM fx LEFT JOIN ec USING (route_id)""",
    "transition_events": _EVENTS + " SELECT CASE WHEN event_type = 'activation' THEN 'ACT_' ELSE 'TAKE_' END || printf('%05d', row_number() OVER (PARTITION BY event_type ORDER BY route_id, time_s)) AS event_id, route_id, event_type, time_s FROM tr",
    "debounced_runs": _RUNS + " SELECT * FROM runs",
    "episodes_merged": _EPISODES + " SELECT * FROM eps",
    "raw_state_segments": _STATE + _BOUNDS + " SELECT * FROM seg",
    "greedy_gap_events": views.with_views("tel_x") + _greedy("g", "(SELECT * FROM tel_x WHERE event_type IN ('click', 'view'))", "route_id, event_type", "time_s", "24.0") + " SELECT * FROM g",
    "greedy_gap_hot": views.with_views("tel_x") + _greedy("g", "(SELECT 0 AS route_id, time_s FROM tel_x WHERE event_type IN ('click', 'view'))", "route_id", "time_s", "24.0") + " SELECT * FROM g",
    "asof_hot_route": views.with_views("tel_x") + ", b AS (SELECT 0 AS k, time_s, arg_max(value, i) AS hi, arg_min(value, i) AS lo FROM tel_x WHERE event_type = 'purchase' GROUP BY time_s), e AS (SELECT 0 AS k, i AS error_id, time_s FROM tel_x WHERE event_type = 'error') SELECT e.error_id, e.time_s, x.time_s AS before_s, x.hi AS before_v, y.time_s AS after_s, y.lo AS after_v FROM e ASOF LEFT JOIN b x ON x.k = e.k AND e.time_s >= x.time_s ASOF LEFT JOIN b y ON y.k = e.k AND e.time_s <= y.time_s",
    "grid_1hz_asof_forward": _STATE + _GRID + " SELECT * FROM sig",
    "asof_backward_state": _STATE + _GRID + " SELECT g.route_id, g.s, g.time_s, c.time_s AS since_s, c.state FROM grid g ASOF LEFT JOIN chg c ON c.route_id = g.route_id AND g.time_s >= c.time_s",
    "asof_nearest_row": views.with_views("tel_x") + """ SELECT e.route_id, e.i AS error_id, e.time_s, p.p.time_s AS purchase_s, p.p.i AS purchase_id, p.p.value AS value FROM tel_x e
        LEFT JOIN (SELECT e2.i AS eid, arg_min(p2, (abs(p2.time_s - e2.time_s), p2.time_s, p2.i)) AS p FROM tel_x e2 JOIN tel_x p2 ON p2.route_id = e2.route_id AND p2.event_type = 'purchase' WHERE e2.event_type = 'error' GROUP BY e2.i) p ON p.eid = e.i WHERE e.event_type = 'error'""",
    "action_labels": _STATE + _LABELS + " SELECT * FROM lab",
    "action_histogram": _STATE + _LABELS + f" SELECT action_label, count(*) AS n, {_H('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()', 2)} AS pct FROM lab GROUP BY action_label",
    "task1_windows_majority": _STATE + _TASK1 + " SELECT * FROM task1",
    "task1_sample_ids": _STATE + _TASK1 + " SELECT 'T1_' || printf('%07d', row_number() OVER (ORDER BY route_id, start_s)) AS sample_id, route_id, start_s, end_s, 5.0::DOUBLE AS input_window_sec, label, current_adas_state FROM task1",
    "split_by_driver": _ROUTES + _split_sql("driver_id", 42) + " SELECT * FROM parts",
    "split_by_vehicle": _ROUTES + _split_sql("vehicle_model", 43) + " SELECT * FROM parts",
    "split_random": _ROUTES + _RANDOM + " SELECT * FROM rp",
    "split_event_counts": _ROUTES + _split_sql("driver_id", 42) + " SELECT part, count(*) AS n_routes, CAST(sum(n_activations) AS BIGINT) AS n_activations, CAST(sum(n_takeovers) AS BIGINT) AS n_takeovers FROM routes JOIN parts USING (driver_id) GROUP BY part",
    "split_leakage_check": _ROUTES + _RANDOM + "".join(f" {u} SELECT '{k}' AS key, count(*) AS n_values, count(*) FILTER (p > 1) AS n_leaking FROM (SELECT {k}, count(DISTINCT part) AS p FROM routes JOIN rp USING (route_id) GROUP BY {k})" for u, k in (("", "driver_id"), ("UNION ALL", "vehicle_model"))),
    "stratified_sample_gap": _STATE + _TASK1 + _greedy("th", "(SELECT DISTINCT label, route_id, start_s FROM task1)", "label, route_id", "start_s", "5.0") + " SELECT label, route_id, start_s FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || route_id || ':' || CAST(start_s * 1000 AS BIGINT)), route_id, start_s) AS rn FROM th) WHERE rn <= 50",
    **{f"task{t}_positives_h{h}": _pos_sql(kind, state, h) for t, kind, state in ((2, "activation", 0), (3, "takeover", 1)) for h in (1, 3, 5)},
    **{f"task{t}_negatives_h{h}": _neg_sql(kind, state, h) for t, kind, state in ((2, "activation", 0), (3, "takeover", 1)) for h in (1, 3, 5)},
}
