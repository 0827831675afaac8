"""Time-series operators against answers by hand and sequential loops."""

import random

import pytest
from pyspark.sql import functions as F

from wheeltrace.operators import temporal


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def stream(spark):
    return spark.createDataFrame([(1, 0, 1.0, "a"), (1, 1, 2.0, "b"), (1, 2, 2.0, "c"), (1, 3, 4.0, "d"), (2, 0, 5.0, "e")], "route_id int, i int, time_s double, v string")


@pytest.fixture
def probe(spark):
    return spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 3.0), (1, 9.0), (2, 5.0), (3, 1.0)], "route_id int, time_s double")


def test_forward_takes_the_first_at_or_after_and_clamps(probe, stream):
    got = rows(temporal.asof_forward(probe, stream, ["route_id"], cols=["v"]), "route_id", "time_s", "v")
    assert got[:5] == [(1, 0.0, "a"), (1, 2.0, "b"), (1, 3.0, "d"), (1, 9.0, "d"), (2, 5.0, "e")] and got[5] == (3, 1.0, None)


def test_forward_without_clamp(probe, stream):
    got = dict(rows(temporal.asof_forward(probe.filter("route_id = 1"), stream, ["route_id"], cols=["v"], clamp=False), "time_s", "v"))
    assert got[9.0] is None and got[3.0] == "d"


def test_backward_takes_the_last_at_or_before(probe, stream):
    got = {(r.route_id, r.time_s): r.v for r in temporal.asof_backward(probe, stream, ["route_id"], cols=["v"]).collect()}
    assert got[1, 0.0] is None and got[1, 2.0] == "c" and got[1, 3.0] == "c" and got[1, 9.0] == "d"


def test_nearest_prefers_the_earlier_row_on_a_tie(probe, stream):
    got = {(r.route_id, r.time_s): r.v for r in temporal.asof_nearest(probe, stream, ["route_id"], cols=["v"]).collect()}
    assert got[1, 3.0] == "b" and got[1, 0.0] == "a" and got[1, 2.0] == "b" and got[1, 9.0] == "d"


def test_asof_plans_have_no_nested_loop(probe, stream):
    plan = temporal.asof_nearest(probe, stream, ["route_id"], cols=["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def debounce(states, least):
    """Sequentially: an inner run that is too short takes the value before it."""
    runs = []
    for s in states:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    out = []
    for k, (s, n) in enumerate(runs):
        out.append(out[-1] if 0 < k < len(runs) - 1 and n < least else s)
    return out


def test_debounce_equals_the_loop(spark):
    rng = random.Random(1)
    routes = {r: [rng.random() < 0.5 for _ in range(rng.randint(1, 40))] for r in range(30)}
    df = spark.createDataFrame([(r, i, float(i), int(s)) for r, ss in routes.items() for i, s in enumerate(ss)], "route_id int, i int, time_s double, state int")
    got = {}
    for r in temporal.debounced_runs(df, ["route_id"], min_samples=3).orderBy("route_id", "run").collect():
        got.setdefault(r.route_id, []).append(r.state)
    assert got == {r: [int(x) for x in debounce(ss, 3)] for r, ss in routes.items()}


def test_debounce_shuffles_once(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1)], "route_id int, i int, time_s double, state int")
    runs = temporal.merged_runs(temporal.debounced_runs(df, ["route_id"], min_samples=3), ["route_id"])
    assert runs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_greedy_gap_equals_the_loop(spark):
    rng = random.Random(2)
    times = {r: sorted(round(rng.random() * 50, 3) for _ in range(rng.randint(1, 60))) for r in range(20)}
    df = spark.createDataFrame([(r, t) for r, ts in times.items() for t in ts], "route_id int, t double")
    want = []
    for r, ts in times.items():
        last = None
        for t in ts:
            if last is None or t - last >= 2.0:
                want.append((r, t))
                last = t
    assert rows(temporal.greedy_gap(df, ["route_id"], "t", 2.0), "route_id", "t") == sorted(want)


def test_interpolation_clamps_and_is_linear(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 4.0)], "route_id int, i int, time_s double, x double")
    p = spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 2.0), (1, 3.0)], "route_id int, time_s double")
    assert rows(temporal.interpolate(p, s, ["route_id"], value="x"), "time_s", "x") == [(-1.0, 0.0), (0.5, 1.0), (2.0, 4.0), (3.0, 4.0)]


def test_sequential_ids_run_on_over_keys(spark):
    df = spark.createDataFrame([(2, 1.0), (1, 5.0), (1, 3.0)], "route_id int, t double")
    got = {(r.route_id, r.t): r.id for r in temporal.sequential_ids(df, "route_id", ["t"], prefix="ACT", width=5, name="id").collect()}
    assert got == {(1, 3.0): "ACT_00001", (1, 5.0): "ACT_00002", (2, 1.0): "ACT_00003"}


@pytest.mark.parametrize("bucket", (0.5, 7.0, 1e6))
def test_spans_give_the_same_rows(spark, bucket):
    """A route with a third of all rows, routes with probes or samples only, equal times, null times and a null route."""
    import random

    rng = random.Random(8)
    at = lambda: rng.choice((None, *(x / 2 for x in range(-20, 80))))
    routes = [1] * 10 + [2, 3, 4, None] * 5
    stream = spark.createDataFrame([(rng.choice(routes), i, at(), i * 10) for i in range(200)] + [(7, 500, 1.0, 5)], "route_id int, i int, time_s double, v int").filter("time_s is not null")
    probe = spark.createDataFrame([(rng.choice([*routes, 9]), k, at()) for k in range(300)], "route_id int, k int, time_s double")
    for f, more in ((temporal.asof_forward, {}), (temporal.asof_forward, {"clamp": False}), (temporal.asof_backward, {}), (temporal.asof_nearest, {})):
        want = sorted(f(probe, stream, ["route_id"], cols=["i", "v"], at="found", **more).collect(), key=str)
        assert sorted(f(probe, stream, ["route_id"], cols=["i", "v"], at="found", bucket=bucket, **more).collect(), key=str) == want


def test_one_route_runs_in_many_tasks(spark):
    stream = spark.range(20_000).select(F.lit(1).alias("route_id"), F.col("id").alias("i"), (F.col("id") / 10).alias("time_s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = temporal.asof_backward(stream.select("route_id", (F.col("time_s") + 0.05).alias("time_s")), stream, ["route_id"], cols=["i"], bucket=50.0).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 20_000 and got.filter(F.col("i") != F.floor(F.col("time_s") * 10)).count() == 0


@pytest.mark.parametrize("gap", (0.5, 3.0, 40.0))
def test_dealt_gaps_equal_the_fold(spark, gap):
    import random

    rng = random.Random(2)
    rows = [(r, rng.randrange(0, 4_000) / 4) for r in [1] * 300 + [2] * 20 + [None] * 9 for _ in (0,)] + [(3, 1.0), (3, 1.0), (4, None)]
    df = spark.createDataFrame(rows, "k int, t double")
    want = sorted(temporal.greedy_gap(df, ["k"], "t", gap).collect(), key=str)
    assert sorted(temporal.greedy_gap_dealt(df, ["k"], "t", gap).collect(), key=str) == want
    assert temporal.greedy_gap_dealt(df.filter("false"), ["k"], "t", gap).count() == 0
