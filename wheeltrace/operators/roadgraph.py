"""Road graphs as tables: bounded shortest paths, what lies ahead of a node, and the nearest edge of a point."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import geo
from ..functions.numeric import half_even
from .lineage import cut

LIMIT_DROP = 5  #: km/h by which a limit ahead must be lower
MOST_STRETCH = 16.0  #: most that an edge may span for each metre of its length, for tiles
TILE = 4  #: sides of a square, in radii of the circle that paths stay in
NO_INTERSECTION_M = 999.0  #: distance where no intersection is known


def bounded_paths(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """(src, dst, dist): shortest directed distances up to cutoff, the source itself at 0. Each round relaxes all paths
    that the last one improved, over distinct sources only."""
    e = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    best = sources.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("dist")).distinct()
    fresh = best = cut(best)
    while not fresh.isEmpty():
        more = fresh.join(e, F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst"), (F.col("dist") + F.col("length")).alias("dist")).filter(F.col("dist") <= cutoff).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        more = cut(more.join(best.withColumnRenamed("dist", "_was"), ["src", "dst"], "left").filter(F.col("_was").isNull() | (F.col("dist") < F.col("_was"))).select("src", "dst", "dist"))
        best = cut(best.unionByName(more).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
        fresh = more
    return best


def tiled_paths(edges: DataFrame, nodes: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """As bounded_paths, for nodes with places (node_id, x, y in metres): edges get their places, then one shuffle by squares finds all paths, without rounds.

    No path of at most cutoff leaves the circle of cutoff times the largest span of an edge for each metre of its length, so the plane
    is cut into squares of TILE times that size: a square's sources meet the edges that start in it or within the circle's radius of it, and each
    source's paths are searched there. A square holds the roads of a place, whatever the size of the network; edges of squares without sources
    go no further. Where an edge has no place, or
    spans more than MOST_STRETCH times its length, bounded_paths does the work. Null sources have no paths."""
    place = lambda end: nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    own = sources.select("node_id").filter("node_id is not null").distinct()
    e = edges.groupBy("u", "v").agg(F.min("length").alias("length")).join(place("u"), "u", "left").join(place("v"), "v", "left")
    span = F.hypot(F.col("u_x") - F.col("v_x"), F.col("u_y") - F.col("v_y"))
    e = cut(e.withColumn("span", F.when(span == 0, 0.0).otherwise(F.coalesce(F.try_divide(span, F.col("length")), F.lit(math.inf)))))
    stretch = e.agg(F.max("span")).head()[0] or 0.0
    if not stretch <= MOST_STRETCH:
        return bounded_paths(edges, own, cutoff)
    reach = max(1.0, cutoff * max(stretch, 1.0) * 1.001)  # more than the circle, as sums are rounded
    side = TILE * reach
    tile = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) / side)
    around = lambda c: F.explode(F.sequence(tile(c - reach), tile(c + reach)))
    starts = own.join(place("node_id"), "node_id", "left").select("node_id", tile(F.col("node_id_x")).alias("tx"), tile(F.col("node_id_y")).alias("ty"))
    roads = e.withColumn("tx", around(F.col("u_x"))).withColumn("ty", around(F.col("u_y"))).select("tx", "ty", "u", "v", "length")
    roads = roads.join(starts.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
    kind = own.schema["node_id"].dataType.simpleString()
    return starts.groupBy("tx", "ty").cogroup(roads.groupBy("tx", "ty")).applyInPandas(lambda a, b: _paths_of_tile(a, b, cutoff), f"src {kind}, dst {kind}, dist double")


def _paths_of_tile(starts: pd.DataFrame, roads: pd.DataFrame, cutoff: float) -> pd.DataFrame:
    """Shortest distances from each start over the roads of its surroundings."""
    links: dict = {}
    if len(starts):
        for u, v, length in zip(roads["u"].tolist(), roads["v"].tolist(), roads["length"].tolist()):
            links.setdefault(u, []).append((v, length))
    src, dst, dist = [], [], []
    for start in starts["node_id"].tolist():
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, node = heapq.heappop(heap)
            if d > best[node]:
                continue
            for v, length in links.get(node, ()):
                if d + length <= cutoff and d + length < best.get(v, math.inf):
                    best[v] = d + length
                    heapq.heappush(heap, (d + length, v))
        src += [start] * len(best)
        dst += best
        dist += best.values()
    return pd.DataFrame({"src": pd.Series(src, dtype=object), "dst": pd.Series(dst, dtype=object), "dist": pd.Series(dist, dtype=float)})


def plain_tags(edges: DataFrame, tags: tuple[str, ...] = ("highway", "maxspeed", "lanes")) -> DataFrame:
    """Edges with the first value of tags that are lists (null for an empty list); other columns stay."""
    return edges.withColumns({c: F.get(c, F.lit(0)) for c, t in edges.dtypes if c in tags and t.startswith("array")})


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): ends of edges at each node, in and out."""
    return edges.select(F.col("u").alias("node_id")).unionAll(edges.select("v")).groupBy("node_id").agg(F.count("*").alias("degree"))


def ahead(edges: DataFrame, paths: DataFrame, th: Thresholds) -> DataFrame:
    """For each source: intersections in reach, distance to the nearest, density, and changes of road type, ramps and the
    lowest limit on edges between nodes in reach, out of the 50 nearest; of repeated sources one row."""
    d = paths.join(degrees(edges).select(F.col("node_id").alias("dst"), "degree"), "dst", "left")
    crossing = (F.col("degree") >= th.intersection_degree) & (F.col("dist") > 0)
    nodes = d.groupBy("src").agg(F.count("*").alias("density"), F.count_if(crossing).alias("n_intersections"), half_even(F.coalesce(F.min(F.when(crossing, F.col("dist"))), F.lit(th.intersection_horizon_m)), 1).alias("dist_to_intersection"))
    near = paths.withColumn("_rn", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).filter("_rn <= 50")
    out = near.join(edges, near.dst == edges.u).join(paths.select("src", F.col("dst").alias("v")), ["src", "v"], "left_semi")
    changes = out.groupBy("src").agg((F.countDistinct(geo.road_class(F.col("highway"))) > 1).cast("int").alias("road_type_changes"), F.max(geo.is_link(F.col("highway")).cast("int")).alias("ramp_ahead"), F.min(geo.speed_limit(F.col("maxspeed"))).alias("lowest_limit"))
    return nodes.join(changes, "src", "left").select("src", "density", "n_intersections", "dist_to_intersection", F.coalesce("road_type_changes", F.lit(0)).alias("road_type_changes"), F.coalesce("ramp_ahead", F.lit(0)).alias("ramp_ahead"), "lowest_limit")


def trace_context(points: DataFrame, edges: DataFrame, nodes: DataFrame, around: DataFrame, beyond: DataFrame, th: Thresholds) -> DataFrame:
    """For matched trace points (point_id, u, v, key, heading_deg): density as the larger number of nodes around either end of the edge,
    what lies ahead of the end that the heading points to, and whether a limit ahead is more than LIMIT_DROP below the edge's own.

    around: paths of the edge ends up to the density's radius; beyond: paths up to the horizon."""
    place = lambda end: nodes.select(F.col("node_id").alias(end), F.col("y").alias(f"{end}_lat"), F.col("x").alias(f"{end}_lon"))
    rows = points.join(edges.select("u", "v", "key", geo.speed_limit(F.col("maxspeed")).alias("own_limit")), ["u", "v", "key"]).join(place("u"), "u").join(place("v"), "v")
    bearing = geo.bearing(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
    rows = rows.withColumn("src", F.when(F.abs(geo.turn(F.col("heading_deg"), bearing)) < 90, F.col("v")).otherwise(F.col("u")))
    held = around.groupBy("src").agg(F.count("*").alias("_held"))
    for end in ("u", "v"):
        rows = rows.join(held.select(F.col("src").alias(end), F.col("_held").alias(f"_{end}")), end, "left")
    found = rows.join(ahead(edges, beyond, th).drop("density"), "src", "left")
    falls = F.coalesce(F.col("lowest_limit") < F.col("own_limit") - LIMIT_DROP, F.lit(False)).cast("int")
    return found.select("point_id", F.col("src").alias("forward_node"), F.greatest("_u", "_v").alias("road_network_density"), "n_intersections", "dist_to_intersection", "road_type_changes", "ramp_ahead", falls.alias("speed_limit_decreases"))


def intersection_distance(edges: DataFrame, reach: DataFrame, th: Thresholds) -> DataFrame:
    """For each edge: half its length where an end is an intersection; where that is over 100, the nearest intersection in
    reach of its ends; 999 without any. And whether it is near."""
    deg = degrees(edges)
    at = lambda n: F.col(n) >= th.intersection_degree
    e = edges.join(deg.select(F.col("node_id").alias("u"), F.col("degree").alias("du")), "u").join(deg.select(F.col("node_id").alias("v"), F.col("degree").alias("dv")), "v")
    own = F.when(at("du") | at("dv"), F.least(F.lit(999.0), F.col("length") * 0.5)).otherwise(999.0)
    near = reach.join(deg.select(F.col("node_id").alias("dst"), "degree"), "dst").filter(at("degree")).groupBy("src").agg(F.min("dist").alias("_d"))
    e = e.withColumn("_own", own).join(near.select(F.col("src").alias("u"), F.col("_d").alias("_du")), "u", "left").join(near.select(F.col("src").alias("v"), F.col("_d").alias("_dv")), "v", "left")
    dist = F.when(F.col("_own") > 100, F.least("_own", "_du", "_dv")).otherwise(F.col("_own"))
    return e.select("u", "v", "key", half_even(dist, 1).alias("dist_to_intersection_m"), (dist < th.near_intersection_m).cast("int").alias("is_near_intersection"))


def nearest_edge(points: DataFrame, nodes: DataFrame, edges: DataFrame, *, max_m: float, cell: float = 100.0) -> DataFrame:
    """(point_id, u, v, key, dist): each point's nearest edge as a straight segment, within max_m (else null); ties to the
    smaller (u, v, key)."""
    return with_nearest_edge(points, nodes, edges, max_m=max_m, cell=cell).select("point_id", "u", "v", "key", half_even(F.col("dist"), 3).alias("dist"))


def with_nearest_edge(points: DataFrame, nodes: DataFrame, edges: DataFrame, *, max_m: float, cell: float = 100.0) -> DataFrame:
    """points (px, py and any others) with u, v, key and dist of the nearest edge, as nearest_edge finds it.

    Edges go to the grid cells around their box, where a cell's edges are one list; points go to one cell and take the least of its list, so a
    row stays one row: no pairs of points and edges are sorted or grouped."""
    ends = edges.select("u", "v", "key").join(nodes.select(F.col("node_id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1")), "u").join(nodes.select(F.col("node_id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2")), "v")
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - max_m) / cell), F.floor((F.greatest(a, b) + max_m) / cell)))
    e = ends.withColumn("_cx", cells("x1", "x2")).withColumn("_cy", cells("y1", "y2")).withColumn("dx", F.col("x2") - F.col("x1")).withColumn("dy", F.col("y2") - F.col("y1"))
    e = e.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("x1", "y1", "dx", "dy", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("size"), "u", "v", "key")).alias("_edges"))

    def offset(r: Column) -> Column:
        along = ((F.col("px") - r["x1"]) * r["dx"] + (F.col("py") - r["y1"]) * r["dy"]) / F.nullif(r["size"], F.lit(0.0))
        s = F.when(r["size"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
        return F.struct((F.col("px") - (r["x1"] + s * r["dx"])).alias("ex"), (F.col("py") - (r["y1"] + s * r["dy"])).alias("ey"), r["u"].alias("u"), r["v"].alias("v"), r["key"].alias("key"))

    found = lambda r: F.struct(F.sqrt(r["ex"] * r["ex"] + r["ey"] * r["ey"]).alias("dist"), r["u"].alias("u"), r["v"].alias("v"), r["key"].alias("key"))
    p = points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell)).join(e, ["_cx", "_cy"], "left")
    near = F.filter(F.transform(F.transform("_edges", offset), found), lambda m: m["dist"] <= max_m)
    return p.withColumn("_m", F.array_min(near)).select(*points.columns, "_m.u", "_m.v", "_m.key", "_m.dist")


def trace_features(points: DataFrame, nodes: DataFrame, edges: DataFrame, th: Thresholds, *, max_m: float = 60.0, every: int = 10) -> DataFrame:
    """Road context of trace rows (route_id, i, time_s, px, py, heading_deg): the nearest edge's attributes and its angle to the heading at each
    row; intersections, density and what lies ahead at every `every`-th row and the last one of a route, filled forward in between.

    nodes: node_id, x and y in metres, lon and lat; edges: u, v, key, length, highway, maxspeed, lanes (texts or lists). Rows without an edge within max_m have
    no attributes, and count as far from all intersections. Paths are searched once for each end of a matched edge."""
    edges, metres = plain_tags(edges), nodes.select("node_id", "x", "y")
    degree = nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    end = lambda n: nodes.select(F.col("node_id").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon"))
    kind = geo.road_class(F.col("highway"))
    tags = edges.join(end("u"), "u").join(end("v"), "v").select(
        "u", "v", "key", kind.alias("road_type"), (kind == "motorway").cast("int").alias("is_highway"), geo.speed_limit(F.col("maxspeed")).alias("speed_limit_kph"), geo.lanes(F.col("lanes")).alias("n_lanes"),
        geo.is_link(F.col("highway")).cast("int").alias("is_on_ramp"), geo.bearing(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon")).alias("_bearing"),
    )
    w = W.partitionBy("route_id").orderBy("time_s", "i")
    taken = ((F.row_number().over(w) - 1) % every == 0) | F.lead("i").over(w).isNull()
    rows = cut(points.withColumn("point_id", F.struct("route_id", "i")).withColumn("_taken", taken))
    rows = cut(with_nearest_edge(rows, metres, edges, max_m=max_m).drop("dist").join(tags, ["u", "v", "key"], "left").withColumn("bearing_vs_road", half_even(F.abs(geo.turn(F.col("heading_deg"), F.col("_bearing"))), 2)))
    some = rows.filter("_taken").select("point_id", "u", "v", "key", "heading_deg")
    ends = some.select(F.col("u").alias("node_id")).unionAll(some.select("v")).distinct()
    beyond = cut(tiled_paths(edges, metres, ends, max(th.intersection_horizon_m, th.reach_m)))
    around, beyond = beyond.filter(F.col("dist") <= th.reach_m), beyond.filter(F.col("dist") <= th.intersection_horizon_m)
    ahead_of = trace_context(some.filter("u is not null"), edges, degree, around, beyond, th)
    some = some.join(intersection_distance(edges, around, th), ["u", "v", "key"], "left").join(ahead_of, "point_id", "left")
    known = some.select("point_id", F.struct(
        F.coalesce("dist_to_intersection_m", F.lit(NO_INTERSECTION_M)).alias("dist_to_intersection_m"), F.coalesce("is_near_intersection", F.lit(0)).alias("is_near_intersection"),
        F.coalesce("road_network_density", F.lit(0)).alias("road_network_density"), F.coalesce("dist_to_intersection", F.lit(th.intersection_horizon_m)).alias("hw_dist_to_intersection_m"),
        F.coalesce("n_intersections", F.lit(0)).alias("hw_n_intersections_300m"), F.coalesce("road_type_changes", F.lit(0)).alias("hw_road_type_changes"),
        F.coalesce("ramp_ahead", F.lit(0)).alias("hw_is_ramp_ahead_300m"), F.coalesce("speed_limit_decreases", F.lit(0)).alias("hw_speed_limit_decreases"),
    ).alias("_known"))
    filled = rows.join(known, "point_id", "left").withColumn("_known", F.last("_known", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return filled.select("route_id", "i", "road_type", "is_highway", "speed_limit_kph", "n_lanes", "is_on_ramp", "bearing_vs_road", "_known.*")
