"""Paths by tiles, tags that are lists, road context of traces, samples as they are published."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from wheeltrace.config import Thresholds
from wheeltrace.operators import roadgraph, samples
from wheeltrace.sources import views


def all_paths(edges, sources, cutoff):
    links = {}
    for u, v, length in edges:
        links.setdefault(u, []).append((v, length))
    found = {}
    for s in sources:
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, n = heapq.heappop(heap)
            for v, length in links.get(n, ()) if d == best[n] else ():
                if d + length <= cutoff and d + length < best.get(v, math.inf):
                    best[v] = d + length
                    heapq.heappush(heap, (best[v], v))
        found |= {(s, n): d for n, d in best.items()}
    return found


def rows_of(df):
    rows = df.collect()
    found = {(r.src, r.dst): r.dist for r in rows}
    assert len(found) == len(rows)
    return found


def test_tiles_give_all_paths_of_a_large_network(spark):
    draw = random.Random(5)
    places = [(i, (i % 100) * 60.0 + draw.uniform(-20, 20), (i // 100) * 60.0 + draw.uniform(-20, 20)) for i in range(10_000)]
    edges = []
    for i, x, y in places:
        for j in (i + 1, i - 1, i + 100, i - 100):
            if 0 <= j < 10_000 and draw.random() < 0.8:
                edges.append((i, j, math.hypot(places[j][1] - x, places[j][2] - y) * draw.uniform(0.7, 1.6)))  # some lengths fall short of their spans
    nodes = spark.createDataFrame(places, "node_id long, x double, y double")
    roads = spark.createDataFrame(edges + edges[:50], "u long, v long, length double")
    found = rows_of(roadgraph.tiled_paths(roads, nodes, nodes.unionAll(nodes.limit(9)), 300.0))
    assert found == all_paths(edges, range(10_000), 300.0)


@pytest.mark.parametrize("case", ["no place", "long span", "same place", "no edges", "no sources", "text ids"])
def test_tiles_of_odd_networks(spark, case):
    places, edges, starts = [("a", 0.0, 0.0), ("b", 30.0, 0.0), ("c", 90.0, 10.0)], [("a", "b", 40.0), ("b", "c", 70.0), ("c", "a", 100.0)], ["a", "c", "z", None]
    if case == "no place":
        places = places[:2]
    if case == "long span":
        edges[1] = ("b", "c", 0.0)
    if case == "same place":
        places = [(n, 0.0, 0.0) for n, _, _ in places]
        edges[1] = ("b", "c", 0.0)
    if case == "no edges":
        edges = []
    if case == "no sources":
        starts = []
    nodes, roads = spark.createDataFrame(places, "node_id string, x double, y double"), spark.createDataFrame(edges, "u string, v string, length double")
    found = rows_of(roadgraph.tiled_paths(roads, nodes, spark.createDataFrame([(s,) for s in starts], "node_id string"), 115.0))
    assert found == all_paths(edges, [s for s in starts if s], 115.0)


def test_tiles_and_rounds_agree_on_the_town(spark, data):
    nodes, edges = views.road_network(spark, data)
    assert rows_of(roadgraph.tiled_paths(edges, nodes, nodes, 300.0)) == rows_of(roadgraph.bounded_paths(edges, nodes, 300.0))


def test_roads_far_from_all_sources_are_not_searched(spark):
    """Edges of squares without a source are dropped before tiles are gathered, and sources of neighbouring squares share one task's tile."""
    places = [(i, (i % 50) * 60.0 - 900.0, (i // 50) * 60.0 - 900.0) for i in range(2_500)]
    edges = [(i, j, 60.0) for i, _, _ in places for j in (i + 1, i + 50) if j < 2_500 and (j != i + 1 or j % 50)]
    nodes, roads = spark.createDataFrame(places, "node_id int, x double, y double"), spark.createDataFrame(edges, "u int, v int, length double")
    starts = [0, 15, 16, 1_234]
    paths = roadgraph.tiled_paths(roads, nodes, spark.createDataFrame([(i,) for i in starts], "node_id int"), 200.0)
    assert rows_of(paths) == all_paths(edges, starts, 200.0)
    assert "LeftSemi" in paths._jdf.queryExecution().optimizedPlan().toString()


def test_first_value_of_list_tags(spark):
    rows = spark.createDataFrame([(["primary", "trunk"], "50", [])], "highway array<string>, maxspeed string, lanes array<string>")
    assert tuple(roadgraph.plain_tags(rows).first()) == ("primary", "50", None)


def test_nearest_edge_pairs_no_points_with_edges(spark):
    """Equal to a search over all edges, ties and points without any included; a point stays one row, and no pairs are grouped."""
    draw = random.Random(3)
    places = [(i, draw.randrange(12) * 25.0, draw.randrange(12) * 25.0) for i in range(40)]
    ways = sorted({(draw.randrange(40), draw.randrange(40), draw.randrange(2)) for _ in range(150)})
    spots = [(i, draw.randrange(-8, 20) * 25.0, draw.randrange(-8, 20) * 25.0) for i in range(200)] + [(7, 0.0, 0.0), (None, 50.0, 50.0), (500, None, 1.0)]

    def distance(x, y, u, v):
        (_, x1, y1), (_, x2, y2) = places[u], places[v]
        dx, dy = x2 - x1, y2 - y1
        s = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.sqrt((x - (x1 + s * dx)) ** 2 + (y - (y1 + s * dy)) ** 2)

    nodes, edges = spark.createDataFrame(places, "node_id int, x double, y double"), spark.createDataFrame(ways, "u int, v int, key int")
    got = roadgraph.with_nearest_edge(spark.createDataFrame(spots, "point_id int, px double, py double"), nodes, edges, max_m=60.0)
    want = []
    for i, x, y in spots:
        best = min(((distance(x, y, u, v), u, v, k) for u, v, k in ways if x is not None), default=(math.inf,))
        want.append((i, *best[1:], best[0]) if best[0] <= 60 else (i, None, None, None, None))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.point_id, r.u, r.v, r.key, r.dist) for r in got.collect()), key=key) == sorted(want, key=key)
    plan = roadgraph.nearest_edge(spark.createDataFrame(spots, "point_id int, px double, py double"), nodes, edges, max_m=60.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_trace_features_far_from_roads_and_filled(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 100.0, 0.0, 0.001, 0.0), (3, 200.0, 0.0, 0.002, 0.0)], "node_id int, x double, y double, lon double, lat double")
    edges = spark.createDataFrame([(1, 2, 0, 100.0, ["motorway"], ["100"], ["3"]), (2, 3, 0, 100.0, ["trunk_link"], ["60"], [])], "u int, v int, key int, length double, highway array<string>, maxspeed array<string>, lanes array<string>")
    points = spark.createDataFrame([("r", i, float(i), x, y, 80.0) for i, (x, y) in enumerate([(10.0, 5.0), (20.0, 900.0), (150.0, 1.0), (500.0, 0.0)])] + [("q", 0, 0.0, 160.0, 0.0, 270.0)], "route_id string, i int, time_s double, px double, py double, heading_deg double")
    found = {(r.route_id, r.i): r for r in roadgraph.trace_features(points, nodes, edges, Thresholds(intersection_degree=2)).collect()}
    first, far, second, last, back = (found[k] for k in (("r", 0), ("r", 1), ("r", 2), ("r", 3), ("q", 0)))
    assert (first.road_type, first.is_highway, first.speed_limit_kph, first.n_lanes, first.is_on_ramp, first.bearing_vs_road) == ("motorway", 1, 100.0, 3, 0, 10.0)
    assert (first.dist_to_intersection_m, first.is_near_intersection, first.road_network_density) == (50.0, 0, 3)
    assert (first.hw_dist_to_intersection_m, first.hw_n_intersections_300m, first.hw_is_ramp_ahead_300m, first.hw_speed_limit_decreases) == (300.0, 0, 1, 1)
    assert far.road_type is None and far.bearing_vs_road is None and far.dist_to_intersection_m == 50.0  # filled from the first row
    assert (second.road_type, second.n_lanes, second.is_on_ramp, second.dist_to_intersection_m) == ("trunk", None, 1, 50.0)
    assert (last.dist_to_intersection_m, last.road_network_density, last.hw_dist_to_intersection_m) == (999.0, 0, 300.0)
    assert (back.bearing_vs_road, back.hw_n_intersections_300m, back.road_network_density) == (180.0, 0, 2)


def test_prediction_rows_are_numbered_by_route(spark):
    found = spark.createDataFrame([("b", 1.0, 6.0, 7.0), ("a", 2.0, 7.0, 8.0), ("a", 1.0, 6.0, 8.0)], "route_id string, start_s double, end_s double, nearest_event_s double")
    none = spark.createDataFrame([("a", 0.0, 5.0)], "route_id string, start_s double, end_s double")
    routes = spark.createDataFrame([("a", 4, 1), ("b", 5, 0)], "route_id string, driver_id int, has_gps int")
    out = samples.prediction_rows(found, none, routes, prefix="T2", horizon=3.0, state=0, th=Thresholds()).orderBy("sample_id").collect()
    assert [(r.sample_id, r.route_id, r.end_time_sec, r.label, r.nearest_event_time, r.driver_id) for r in out] == [("T2_0000001", "a", 6.0, 1, 8.0, 4), ("T2_0000002", "a", 7.0, 1, 8.0, 4), ("T2_0000003", "a", 5.0, 0, None, 4), ("T2_0000004", "b", 6.0, 1, 7.0, 5)]
    assert {(r.horizon_sec, r.input_window_sec, r.current_adas_state) for r in out} == {(3.0, 5.0, 0)}
