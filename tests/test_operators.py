"""Metrics on known inputs, numeric helpers, splits, samples, geography, scans and sinks."""

import random
import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheeltrace.config import CLASSES, Thresholds
from wheeltrace.functions import geo, numeric
from wheeltrace.operators import events, features, gps, intervals, labels, metrics, reporting, samples, splits, temporal
from wheeltrace.sources import scans, sinks


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def scored(spark, y, s):
    return metrics.curve(spark.createDataFrame(list(zip(y, s)), "y int, s double"), "y", "s")


def test_perfect_classes(spark):
    df = spark.createDataFrame([(i, i) for i in range(7)], "truth int, pred int")
    r = metrics.f1_report(metrics.confusion(df, "truth", "pred", 7)).first()
    assert r.accuracy == 1 and r.macro_f1 == 1 and r.f1[3] == 1


def test_one_class_for_all(spark):
    df = spark.createDataFrame([(y, 0) for y in (0, 0, 0, 1, 1, 2, 2)], "truth int, pred int")
    r = metrics.f1_report(metrics.confusion(df, "truth", "pred", 7)).first()
    assert r.accuracy == pytest.approx(3 / 7) and r.macro_f1 == pytest.approx(0.6 / 3) and r.f1[6] == 0


def test_binary_curve(spark):
    assert metrics.auc(scored(spark, (0, 0, 0, 1, 1, 1), (0.1, 0.2, 0.3, 0.7, 0.8, 0.9))).first().auc_roc == 1
    assert metrics.auc(scored(spark, (1, 1), (0.1, 0.2))).first().auc_roc == 0.5
    assert metrics.auc(scored(spark, (0, 1), (0.5, 0.5))).first().auc_roc == 0.5
    t = metrics.best_threshold(scored(spark, (0, 0, 1, 1), (0.2, 0.4, 0.6, 0.8))).first()
    assert t.threshold == 0.6 and t.f1 == 1
    assert metrics.average_precision(scored(spark, (0, 1, 1), (0.9, 0.8, 0.7))).first().auprc == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert metrics.precision_at_recall(scored(spark, (0, 1, 1), (0.9, 0.8, 0.7))).first().precision_at_recall == pytest.approx(2 / 3)


def test_empty_curve(spark):
    c = scored(spark, (0,), (0.5,))
    assert metrics.best_threshold(c).first().threshold == 0.5 and metrics.average_precision(c).first().auprc == 0


def test_rounding_and_flags(spark):
    r = one(spark, a=numeric.half_even(F.lit(2.5), 0), b=numeric.half_even(F.lit(0.125), 2), c=numeric.flag(F.lit("")), d=numeric.flag(F.lit("1.9")), e=numeric.number(F.lit("x"), 9.0), f=numeric.finite(F.lit(float("inf"))))
    assert tuple(r) == (2.0, 0.12, 0, 1, 9.0, 0.0)


def test_geo(spark):
    z = F.lit(0.0)
    r = one(spark, d=geo.haversine(z, z, z, F.lit(1.0)), b=geo.bearing(z, z, z, F.lit(-1.0)), t=geo.turn(F.lit(10.0), F.lit(350.0)), u=geo.turn(F.lit(180.0), F.lit(0.0)), m=geo.menger(z, z, F.lit(1.0), F.lit(1.0), F.lit(2.0), z), n=geo.menger(z, z, z, z, z, z))
    assert r.d == pytest.approx(111194.93, abs=0.01) and r.b == pytest.approx(270) and r.t == 20 and r.u == -180 and r.m == pytest.approx(1) and r.n == 0


def test_road_tags(spark):
    r = one(spark, a=geo.speed_limit(F.lit("30 mph")), b=geo.speed_limit(F.lit("walk")), c=geo.lanes(F.lit("2.7")), d=geo.road_class(F.lit("Motorway_Link")), e=geo.road_class(F.lit(None).cast("string")), f=geo.is_link(F.lit("motorway_link")))
    assert r.a == pytest.approx(48.2802) and r.b is None and r.c == 2 and r.d == "motorway" and r.e == "other" and r.f


def test_action_priority(spark):
    th = Thresholds()
    cases = [((0.4, 0, 0, 1, 1, 0, 999, 1), "Stopped"), ((5, 0, 6, 0, 0, 0, 999, 1), "LaneChange"), ((5, 0, 5, 0, 0, 0, 999, 1), "Cruising"), ((5, 0, 10.5, 1, 0, 0, 999, 0), "Turning"), ((5, -0.36, 0, 0, 0, 0, 999, 0), "Braking"), ((5, 0.38, 0, 0, 0, 0, 999, 0), "Accelerating"), ((5, 0, 0, 0, 0, 1, 59, 0), "CarFollowing"), ((5, 0, 0, 0, 0, 1, 60, 0), "Cruising")]
    for (v, a, s, b, lc, lead, dist, bl), want in cases:
        label, _ = labels.action(*(F.lit(float(x)) for x in (v, a, s)), *(F.lit(x) for x in (b, lc, lead, dist, bl, 0)), th)
        assert one(spark, x=label).x == want


def test_majority_windows_make_no_pairs(spark):
    """Equal to counts in each window, with gaps, a null label and labels outside of all windows; no pairs of labels and windows are grouped."""
    th, draw = Thresholds(), random.Random(4)
    rows = [(r, half, draw.choice(["a", "b", "c", None])) for r in (1, 2, 3) for half in sorted(draw.sample(range(-4, 80), 25))]
    ends = {1: 30.0, 2: 12.5, 3: 5.0}
    lab = spark.createDataFrame([(r, half / 2, x) for r, half, x in rows] + [(1, None, "c")], "route_id int, timestamp double, action_label string")
    w = labels.majority_windows(lab, spark.createDataFrame([(r, 0.0, e) for r, e in ends.items()], "route_id int, t0 double, t1 double"), th)
    want = {}
    for r, end in ends.items():
        for k in range(int((end - 5) / 0.5) + 1 if end >= 6 else 0):
            inside = [x for q, half, x in rows if q == r and k / 2 <= half / 2 < k / 2 + 5]
            if inside:
                want[r, k / 2] = max(inside, key=lambda x: (inside.count(x), -inside.index(x)))
    got = w.collect()
    assert {(g.route_id, g.start_s): g.label for g in got} == want and len(got) == len(want)
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_majority_tie_goes_to_the_first_seen(spark):
    lab = spark.createDataFrame([(1, 0.5, "B"), (1, 1.5, "A"), (1, 2.5, "A"), (1, 3.5, "B"), (1, 4.5, "C")], "route_id int, timestamp double, action_label string")
    w = labels.majority_windows(lab, spark.createDataFrame([(1, 0.0, 6.0)], "route_id int, t0 double, t1 double"), Thresholds())
    assert {r.start_s: r.label for r in w.collect()}[0.0] == "B"


def test_split_prefix_sums(spark):
    r = spark.createDataFrame([(d, f"{d}-{i}") for d in range(10) for i in range(d + 1)], "driver_id int, route_id string")
    parts = {x.driver_id: x.part for x in splits.split_by_key(r, "driver_id", seed=1).collect()}
    assert set(parts.values()) == {"train", "val", "test"} and len(parts) == 10
    n = sum(d + 1 for d, p in parts.items() if p == "train")
    assert n >= int(55 * 0.7)


def test_random_split_counts(spark):
    parts = splits.split_random(spark.range(1000).withColumnRenamed("id", "route_id"), "route_id", seed=3).groupBy("part").count().collect()
    assert {p.part: p["count"] for p in parts} == {"train": 700, "val": 150, "test": 150}


def test_negatives_keep_their_distance(spark):
    ev = spark.createDataFrame([(1, 30.0)], "route_id int, time_s double")
    seg = spark.createDataFrame([(1, 0.0, 60.0, 0)], "route_id int, start_s double, end_s double, state int")
    got = [r.end_s for r in samples.negatives(ev, seg, spark.createDataFrame([(1, 0.0, 60.0)], "route_id int, t0 double, t1 double"), horizon=3.0, state=0, th=Thresholds()).collect()]
    assert got and all(not t - 2 <= 30 <= t + 5 for t in got) and min(got) == 5.0 and max(got) <= 57


def test_interval_join_is_exact(spark):
    p = spark.createDataFrame([(1, float(t)) for t in range(20)], "k int, t double")
    i = spark.createDataFrame([(1, 3.0, 7.0), (1, 6.5, 6.6)], "k int, lo double, hi double")
    assert intervals.interval_join(p, i, ["k"], t="t", low="lo", high="hi", bucket=2.0).count() == 5
    assert intervals.interval_join(p, i, ["k"], t="t", low="lo", high="hi", bucket=2.0, closed=False).count() == 4


def test_savgol_keeps_parabolas(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i * i - 3 * i)) for i in range(20)] + [(2, 0, 0.0, 5.0)], "route_id int, i int, time_s double, x double")
    for r in gps.smooth(df, ["x"]).collect():
        assert r.x_s == pytest.approx(r.x, abs=1e-6)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 4, "label string")
    assert {r.label: r.weight for r in features.class_weights(df, "label", ["a", "b", "c"], 5.0).collect()} == {"a": 1.0, "b": 2.0, "c": 5.0}


def test_parsing(spark):
    p, c = reporting.parse_binary(F.lit('x {"confidence": 0.7, "prediction": 1}'))
    q, d = reporting.parse_binary(F.lit("none"))
    r = one(spark, a=reporting.parse_label(F.lit("It is TURNING, then stopped")), p=p, c=c, q=q, d=d)
    assert tuple(r) == ("Stopped", 1, 0.7, 0, 0.5)
    assert len(CLASSES) == 7


@pytest.fixture
def tree(tmp_path):
    for name, meta in (("a", {"dongle_id": "d1", "route_id": "r1", "total_duration_s": 60.0, "initData": {"version": "v1"}, "segments": [{"seg_num": 0, "duration_s": 60.0}]}), ("b", {"dongle_id": "d2", "route_id": "r2"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps(meta, indent=1))
    (tmp_path / "a" / "radar.csv").write_text("time_s,leadOne_status,extra\n0.0,1,x\n0.05,,y\nbad,1,z\n")
    (tmp_path / "a" / "planning.csv").write_text("laneChangeState,time_s\noff,0.0\npreLaneChange,0.5\n,1.0\n")
    return tmp_path


def test_scans(spark, tree):
    r = {x.route_id: x for x in scans.routes(spark, str(tree)).collect()}
    assert r["d1/r1"].op_version == "v1" and r["d2/r2"].op_version == "unknown" and r["d2/r2"].duration_sec == 0 and r["d2/r2"].segments == []
    radar = scans.signals(spark, str(tree), "radar").orderBy("i").collect()
    assert [(x.time_s, x.leadOne_status, x.leadOne_dRel) for x in radar] == [(0.0, 1.0, 999.0), (0.05, 0.0, 999.0)]
    assert [x.laneChangeState for x in scans.signals(spark, str(tree), "planning").orderBy("i").collect()] == [0.0, 1.0, 0.0]
    flags = {x.dir.rsplit("/", 1)[1]: (x.has_radar, x.has_imu, x.has_dcamera) for x in scans.modality_flags(scans.listing(spark, str(tree))).collect()}
    assert flags == {"a": (1, 0, 0), "b": (0, 0, 0)}
    routes = scans.routes(spark, str(tree)).select("dir")
    assert scans.with_sentinels(routes, scans.signals(spark, str(tree), "radar").select("dir", "i", "time_s", "leadOne_dRel"), ["leadOne_dRel"]).count() == 3


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 0.125), (2, 2.0)], "route_id int, x double")
    old.write.parquet(str(tmp_path / "old"))
    sinks.replace_routes(str(tmp_path / "old"), spark.createDataFrame([(2, 9.0)], "route_id int, x double"), str(tmp_path / "new"))
    assert sorted((r.route_id, r.x) for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [(1, 0.125), (2, 9.0)]
    with pytest.raises(ValueError):
        sinks.replace_routes("p", old, "p")
    assert [r.x for r in sinks.rounded(old.filter("route_id = 1"), {"x": 2}).collect()] == ["0.12"]
    parts = spark.createDataFrame([("train", "b"), ("train", "a")], "part string, route_id string")
    doc = json.loads(sinks.split_documents(parts, spark.createDataFrame([("train", 2, 1, 0)], "part string, n_routes int, n_activations int, n_takeovers int"), "x").first().value)
    assert doc["parts"]["train"]["routes"] == ["a", "b"]
    assert sinks.markdown(old.orderBy("route_id")).splitlines()[2] == "| 1 | 0.125 |"


def test_state_is_one_only_for_exact_ones(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (None, None), (0, 1)], "cc_lat int, cruise_en int")
    assert [r.state for r in events.engaged(df).collect()] == [1, 0, 0, 1]


def test_streaming_transitions(spark, tmp_path):
    from wheeltrace.streaming import transitions

    spark.createDataFrame([(1, float(i), int(4 <= i < 9 or i == 1)) for i in range(14)], "route_id long, time_s double, state int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("route_id long, time_s double, state int").parquet(str(tmp_path / "in"))
    q = transitions.live_transitions(stream, min_samples=2).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.time_s, r.state) for r in spark.sql("select * from live").collect()) == [(4.0, 1), (9.0, 0)]


def test_streaming_transitions_wait_for_late_samples_and_expire(spark, tmp_path):
    from wheeltrace.streaming import transitions

    schema = "route_id long, time_s double, state int, ts timestamp"
    on = {4, 5, 6, 7, 8, 13, 14}
    batches = [[0, 1, 2, 4, 5], [3, 6, 7, 8], [10, 9, 11, 12, 2], [13, 14]]  # 3 and 9 come late, 2 comes again and far too late
    rows = [[(1, float(i), int(i in on), dt.datetime.fromtimestamp(i, dt.UTC)) for i in b] for b in batches]
    rows.append([(2, 100.0, 0, dt.datetime.fromtimestamp(100, dt.UTC))])  # the watermark leaves route 1 behind, which still holds 13 and 14
    (tmp_path / "in").mkdir()
    live = transitions.live_transitions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), min_samples=2, late_s=3.0, ts="ts", idle="10 seconds")
    q = live.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    seen = []
    try:
        for k, own in enumerate(rows):
            spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
            for f in (tmp_path / f"b{k}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{k}.parquet")
            q.processAllAvailable()
            seen.append(sorted((r.time_s, r.state) for r in spark.sql("select * from late").collect()))
    finally:
        q.stop()
    assert seen[-2] == [(4.0, 1), (9.0, 0)]
    assert seen[-1] == [(4.0, 1), (9.0, 0), (13.0, 1)]


def test_signal_files_are_split_and_quoted_cells_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    n = 4000
    lines = ['"note, of the car",leadOne_dRel,time_s,leadOne_status', *(f'"x ""{i}"", y",{i}.5,{i * 0.05:.2f},"1"' for i in range(n)), "", 'z,1,never,1']
    (tmp_path / "a" / "radar.csv").write_text("\r\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = scans.signals(spark, str(tmp_path), "radar").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.i, round(r.time_s, 2), r.leadOne_dRel, r.leadOne_status) for r in got] == [(i, round(i * 0.05, 2), i + 0.5, 1.0) for i in range(n)]
    assert one(spark, c=scans.cells(F.lit('"a ""b"", c",,d'))).c == ['a "b", c', "", "d"]


def test_signal_files_with_many_cells_and_line_breaks(spark, tmp_path):
    for d in ("a b", "c+[1]", "e", "f"):
        (tmp_path / d).mkdir()
    wide = ",".join(f'"{i},"' for i in range(20_000))
    (tmp_path / "a b" / "radar.csv").write_text(f"time_s,leadOne_dRel,{wide}\n0.5,7,{wide}\n1.5,8,{wide}\n")
    (tmp_path / "c+[1]" / "radar.csv").write_text('time_s,note,leadOne_dRel\n0.0,"two\nlines",1\n1.0,"more ""of\nthem""",2\n2.0,x,3\n')
    (tmp_path / "e" / "radar.csv").write_text('"time_s","of\ntwo lines",leadOne_dRel,leadOne_dRel\n4.0,x,5,6\n')
    (tmp_path / "f" / "radar.csv").write_text("")
    got = sorted((r.dir.rsplit("/", 1)[1], r.i, r.time_s, r.leadOne_dRel) for r in scans.signals(spark, str(tmp_path), "radar").collect())
    assert got == [("a%20b", 0, 0.5, 7.0), ("a%20b", 1, 1.5, 8.0), ("c+%5B1%5D", 0, 0.0, 1.0), ("c+%5B1%5D", 1, 1.0, 2.0), ("c+%5B1%5D", 2, 2.0, 3.0), ("e", 0, 4.0, 5.0)]
    plan = scans.signals(spark, str(tmp_path / "a b"), "radar")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert scans.signals(spark, str(tmp_path / "f"), "radar").count() == 0 == scans.signals(spark, str(tmp_path), "imu").count()


def test_road_text_and_messages(spark):
    n = F.lit(None).cast("double")
    r = one(spark, t=reporting.road_context(F.lit(None).cast("string"), F.lit(50.0), n, F.lit(1), F.lit(0), F.lit(12.5), n, F.lit(0.0125), F.lit(-0.04)), m=reporting.messages(F.lit("s"), F.lit("u"), F.array(F.lit(b"x"))))
    assert r.t == "## Road Context\nRoad: unknown | Limit: 50 km/h | Lanes: 0\nHighway: yes | Intersection: no (dist=12m) | On-ramp: no\nCurvature: 0.012 | Heading change: 0.0 deg/s"
    assert r.m[1].content == ["u", "data:image/jpeg;base64,eA=="]


def test_files(spark, tmp_path):
    for name, size in (("0--fcamera.hevc", 2000), ("10--fcamera.hevc", 1500), ("2--qcamera.ts", 900), ("3--fcamera.hevc", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = scans.video_sources(scans.listing(spark, str(tmp_path)), priority=[("fcamera.hevc$", 1000), ("qcamera.ts$", 500)]).collect()
    assert sorted(r.segment for r in got) == [0, 10]
    (tmp_path / "split.json").write_text(json.dumps({"split_type": "x", "train_routes": ["a", "b"], "val_routes": ["c"], "test_routes": []}))
    assert sorted((r.part, r.route_id) for r in scans.split_lists(spark, str(tmp_path / "split.json")).collect()) == [("train", "a"), ("train", "b"), ("val", "c")]
    (tmp_path / "results.json").write_text(json.dumps({"task": "t", "seed": 7, "test_metrics": {"f1": 0.5}}))
    assert scans.run_results(spark, str(tmp_path)).first().test_metrics == {"f1": 0.5}


def test_components_come_from_the_training_rows_only(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    train = x[:200] - x[:200].mean(0)
    val, vec = np.linalg.eigh(train.T @ train)
    got = features.pca(df, "id", "vec", 3, train=df.filter("id < 200")).orderBy("id").collect()
    want = (x - x[:200].mean(0)) @ vec[:, ::-1][:, :3]
    have = np.array([r.pc for r in got])
    assert np.allclose(have * np.sign((have * want).sum(0)), want, atol=1e-6)
    shares = [r.share for r in features.explained_variance(df.filter("id < 200"), "vec", 3).orderBy("component").collect()]
    assert shares == pytest.approx((val[::-1] / val.sum())[:3].tolist())


def test_balanced_logistic_regression_by_newton_steps(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 1).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int")
    got = np.array([r.probability for r in features.logistic(df, "id", ["a", "b"], "y").orderBy("id").collect()])
    weight = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    z = np.column_stack([x / x.std(0, ddof=1), np.ones(400)])  # the library scales columns before the ridge
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.diag([1, 1, 0]) * weight.sum() / 400
        w -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ w)
    assert np.allclose(got, 1 / (1 + np.exp(-z @ w)), atol=0.01)


def test_greedy_gap_of_a_large_key_streams(spark):
    rng = np.random.default_rng(7)
    times = {k: np.sort(rng.integers(0, 200_000, n) / 4.0) for k, n in (("hot", 30_000), ("a", 3), (None, 50))}
    df = spark.createDataFrame([(k, float(t)) for k, ts in times.items() for t in ts] + [("a", None)], "key string, t double")
    got = {}
    for r in temporal.greedy_gap(df, ["key"], "t", 2.5).collect():
        got.setdefault(r.key, []).append(r.t)
    for k, ts in times.items():
        want = []
        for t in ts:
            if not want or t - want[-1] >= 2.5:
                want.append(t)
        assert sorted(got[k]) == want


def test_wide_boxes_shrink_to_the_median_and_hold_their_nodes(spark):
    from wheeltrace.operators import gps
    from wheeltrace.sources import scans

    rows = [(1, 40.0 + i * 0.01, -75.0) for i in range(100)] + [(2, 40.0 + i * 0.0001, -75.0) for i in range(20)] + [(3, 40.0, -75.0)] * 9
    box = gps.bounding_box(spark.createDataFrame(rows, "route_id long, lat double, lon double"))
    got = {r.route_id: r for r in box.collect()}
    assert set(got) == {1, 2}  # nine points make no box
    assert abs(got[1].north - (40.495 + 5000 / 111320)) < 1e-5 and abs(got[1].south - (40.495 - 5000 / 111320)) < 1e-5
    assert abs(got[2].north - (40.0019 + 500 / 111320)) < 1e-5
    places = [(i, -75.0 + (i % 7 - 3) * 0.004, 39.99 + i * 0.002) for i in range(300)]
    found = scans.within_box(spark.createDataFrame(places, "node_id long, x double, y double"), box)
    want = sorted((n, k) for n, x, y in places for k, r in got.items() if r.west <= x <= r.east and r.south <= y <= r.north)
    assert sorted((r.node_id, r.route_id) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_sensor_context_has_the_sections_of_the_streams_with_rows(spark):
    from wheeltrace.operators import reporting

    w = spark.createDataFrame([(1, 0.0, 5.0), (1, 0.0, 5.0), (2, 0.0, 5.0)], "route_id long, start_s double, end_s double")
    car = spark.createDataFrame([(1, 0, -0.6, 9.0, 9.0), (1, 1, 0.25, 1.0, -2.0), (1, 2, -0.25, 3.0, 0.0), (1, 3, 5.5, 4.0, float("nan")), (1, 4, 5.6, 8.0, 8.0)], "route_id long, i int, time_s double, vEgo double, aEgo double")
    plan = spark.createDataFrame([(1, 0, 5.0, "off", None), (1, 1, 9.0, "1", 0.5)], "route_id long, i int, time_s double, laneChangeState string, laneLeft_prob double")
    got = {r.route_id: r.context for r in reporting.sensor_context(w, {"planning": plan, "vehicle_dynamics": car}).collect()}
    car_text = "## Vehicle (5.0s window)\nSpeed: 1.0 → 1.0 → 4.0 m/s | Accel: mean=-1.0, peak=2.0 m/s²\nSteering: 0.0 → 0.0 → 0.0 deg | Brake: OFF | Gas: 0.00\nBlinkers: none | DAS: enabled=no, lat_active=no"
    plan_text = "## Planning\nDesired curvature: 0.000 | Lane change: none\nLane conf: L=N/A R=0.00"
    assert got == {1: car_text + "\n\n" + plan_text, 2: reporting.UNAVAILABLE}
    assert {r.context for r in reporting.sensor_context(w, {}).collect()} == {reporting.UNAVAILABLE}


def test_configurations_and_reports_of_metrics(spark):
    from wheeltrace import config
    from wheeltrace.operators import features, metrics

    assert len(config.CONFIGURATIONS) == 16 and len(config.columns_of("Full-Struct")) == 55 and len(config.columns_of("Full-All")) == 73 and config.columns_of("FV") == []
    one = features.select_configuration(spark.createDataFrame([(1, "2.5")], "route_id long, leadOne_vRel string"), ["route_id"], "Int").first()
    assert (one.leadOne_vRel, one.leadOne_dRel, one.hasLead) == (2.5, 999.0, 0.0)
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    c = metrics.curve(rows, "y", "s")
    want = {"auc_roc": 0.75, "auprc": (1 + 2 / 3) / 2, "f1": 0.8, "accuracy": 0.75, "threshold": 0.7, "precision_at_recall_0.8": 2 / 3, "n_pos": 2.0, "n_neg": 2.0}
    for got, expected in ((metrics.binary_report(c), want), (metrics.binary_report(c, 0.85), want | {"f1": 2 / 3, "threshold": 0.85})):
        m = got.first().metrics
        assert set(m) == set(expected) and all(abs(m[k] - v) < 1e-12 for k, v in expected.items())
    none = metrics.binary_report(metrics.curve(rows.filter("y > 1"), "y", "s")).first().metrics
    assert (none["auc_roc"], none["auprc"], none["threshold"], none["n_pos"]) == (0.5, 0.0, 0.5, 0.0)
    classes = metrics.class_report(metrics.confusion(spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "t int, p int"), "t", "p", 3), ("a", "b", "c")).first().metrics
    assert abs(classes["accuracy"] - 2 / 3) < 1e-12 and abs(classes["f1_a"] - 2 / 3) < 1e-12 and classes["f1_c"] == 0.0 and abs(classes["macro_f1"] - 2 / 3) < 1e-12


def exchanges(df):
    """Shuffles in the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_all_channels_are_packed_in_one_shuffle(spark):
    rng = np.random.default_rng(3)
    names, rows, want = [f"c{k}" for k in range(55)], [], {}
    for route, n in ((1, 300), (2, 2), (3, 1), (4, 40)):
        t = np.round(np.cumsum(rng.uniform(0.01, 0.09, n)), 3)
        t[5:7] = t[5] if n > 7 else t[5:7]  # two samples at one time
        v = rng.normal(size=(n, 55))
        v[rng.random((n, 55)) < 0.05] = np.nan
        rows += [(route, i, float(t[i]), *(None if np.isnan(x) and i % 2 else float(x) for x in v[i])) for i in range(n)]
        grid = t[0] + 0.02 * np.arange(int(np.ceil((t[-1] - t[0]) / 0.02 + 0.5)))
        want[route] = (t[0], np.stack([np.interp(grid, t, np.nan_to_num(v[:, k], nan=0.0)) for k in range(55)], 1)) if n > 1 else None
    df = spark.createDataFrame(rows, "route_id int, i int, time_s double, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    packed = features.pack(df, names, step=0.02, chunk=64)
    assert exchanges(packed) == 1
    got = {}
    for r in packed.orderBy("route_id", "chunk").collect():
        assert r.t_start == want[r.route_id][0] and r.step == 0.02 and len(r.data) == r.n * 55
        got.setdefault(r.route_id, []).append(np.array(r.data).reshape(-1, 55))
    assert sorted(got) == [1, 2, 4]
    for route, parts in got.items():
        assert np.allclose(np.concatenate(parts), want[route][1], atol=1e-6) and all(len(p) == 64 for p in parts[:-1])
    windows = spark.createDataFrame([(r, float(s)) for r in (1, 3, 4, 9) for s in (-1.0, 0.0, 0.51, 3.0, 1e4)], "route_id int, start_s double")
    sliced = {(r.route_id, r.start_s): np.array(r.data).reshape(100, 55) for r in features.packed_slices(windows, packed, 55, length=100, chunk=64).collect()}
    assert len(sliced) == 20
    for (route, start), data in sliced.items():
        full = np.zeros((100, 55))
        if want.get(route):
            t0, whole = want[route]
            part = whole[max(0, round((start - t0) / 0.02)) :][:100]
            full[: len(part)] = part
        assert np.allclose(data, full, atol=1e-6)
    back = features.unpack(packed, names, chunk=64).filter("route_id = 1").orderBy("s").collect()
    assert [r.s for r in back] == list(range(len(want[1][1]))) and np.allclose([r.c7 for r in back], want[1][1][:, 7], atol=1e-6)


def test_smoothing_at_the_ends_and_of_short_routes(spark):
    y = np.random.default_rng(1).normal(size=30)
    rows = [(r, i, float(i), float(y[i])) for r, n in ((1, 30), (2, 11), (3, 10), (4, 15)) for i in range(n)]
    got = gps.smooth(spark.createDataFrame(rows, "route_id int, i int, time_s double, x double"), ["x"]).orderBy("route_id", "i").collect()
    for r, n in ((1, 30), (2, 11), (4, 15)):
        own = [v.x_s for v in got if v.route_id == r]
        for i in range(n):
            lo = min(max(i - 5, 0), n - 11)
            assert own[i] == pytest.approx(np.polyval(np.polyfit(np.arange(11), y[lo : lo + 11], 2), i - lo))
    assert [v.x_s for v in got if v.route_id == 3] == [float(v) for v in y[:10]]


@pytest.mark.parametrize("k", (0, 1, 777, 5_000, 9_999))
def test_bounded_subset_is_exact(spark, k):
    df = spark.range(5_000).select("id", (F.col("id") % 7).alias("x"))
    got = samples.bounded_subset(df, ["id"], k)
    want = sorted(range(5_000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:k]
    assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == df.columns
    assert sorted(r.id for r in samples.bounded_subset(df.repartition(11, "x"), ["id"], k).collect()) == sorted(want)


def test_logits_are_spread_over_ranges(spark):
    df = spark.range(6_000).select((F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 7919 % 4_001) / 100 - 20).alias("s"))
    at = metrics._ranges(df.select(F.col("s").alias("threshold")).distinct(), "threshold", "b")
    sizes = [r["count"] for r in at.groupBy("b").count().collect()]
    assert len(sizes) > 500 and max(sizes) < 40
    rows = df.collect()
    want = {s: (sum(r.y for r in rows if r.s >= s), sum(1 - r.y for r in rows if r.s >= s)) for s in sorted({r.s for r in rows})[::400]}
    got = {r.threshold: (r.tp, r.fp) for r in metrics.curve(df, "y", "s").collect()}
    assert {s: got[s] for s in want} == want and len(got) == len({r.s for r in rows})
    assert metrics.curve(df.filter("false"), "y", "s").count() == 0


def test_partitions_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "route_id int, x string"), path)
    files = lambda r: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "t" / f"route_id={r}").iterdir())
    before = {r: files(r) for r in (1, 2, 3)}
    sinks.replace_partitions(spark.createDataFrame([(2, "new"), (4, "e")], "route_id int, x string"), path)
    read = lambda: sorted((r.route_id, r.x) for r in spark.read.parquet(path).collect())
    assert read() == [(1, "a"), (2, "new"), (3, "d"), (4, "e")] and files(1) == before[1] and files(3) == before[3] and files(2) != before[2]
    bad = spark.createDataFrame([(1, "1"), (3, "no number")], "route_id int, x string").selectExpr("route_id", "string(int(x)) AS x").repartition(2)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.replace_partitions(bad, path)
    assert read() == [(1, "a"), (2, "new"), (3, "d"), (4, "e")]
