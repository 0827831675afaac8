"""Views that read the generic tables as telemetry: the stand-ins for vehicle logs that queries and tests run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("route_id"), "event_id", "ts", "event_type", "value", "props")
    return e.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).try_cast("int"))


def uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for each user on a uniform clock of 2 Hz: state flags and signals from the events' fields."""
    user, kind, k = F.col("route_id"), F.col("event_type"), F.col("k")
    e = _events(spark, sf_dir).withColumn("i", (F.row_number().over(W.partitionBy("route_id").orderBy("ts", "event_id")) - 1).cast("int"))
    return e.select(
        "route_id", "i", (F.col("i") * 0.5).alias("time_s"), "k",
        ((kind == "click") & (user % 7 != 0)).cast("int").alias("cc_lat"),
        (((kind == "view") & ((user % 7 != 0) | (k < 25))) | ((user % 7 == 1) & (kind != "error"))).cast("int").alias("cruise_en"),
        (F.col("value") / 16).alias("v_ego"), ((k - 50) / 4).alias("steer"), ((k - 50) / 50).alias("a_ego"),
        (kind == "error").cast("int").alias("brake"), (kind == "purchase").cast("int").alias("lcs"),
        (kind == "signup").cast("int").alias("lead_status"), (F.col("value") / 4).alias("d_rel"), (k % 10 == 0).cast("int").alias("left_blinker"),
    )


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for each user on the events' own clock, in hours."""
    e = _events(spark, sf_dir)
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000.0)
    return e.select("route_id", F.col("event_id").alias("i"), hours.alias("time_s"), "event_type", "value", "k")


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GPS trace for each user at 10 Hz, with two receivers, gaps, zeros, poor accuracy and jumps at known k."""
    u = uniform(spark, sf_dir).withColumn("time_s", F.col("i") * 0.125)
    lat = 40.0 + F.col("i") * 0.00025 + F.col("k") * 0.0000625
    lon = -75.0 + F.col("i") * 0.0005 - (F.col("k") % 16) * 0.000125
    jump = F.when(F.col("k") == 7, 0.0078125).otherwise(0.0)
    phone = (F.col("route_id") % 3 != 0) & (F.col("k") != 13)
    return u.select(
        "route_id", "i", "time_s", F.when(phone, lat + jump).alias("phone_lat"), F.when(phone, lon).alias("phone_lon"), F.when(phone, F.col("v_ego")).alias("phone_speed"), F.when(phone, F.col("k") / 8).alias("phone_hacc"),
        F.when(F.col("k") == 21, 0.0).otherwise(lat + jump).alias("lat"), lon.alias("lon"), F.when(F.col("k") % 4 == 0, -1.0).otherwise(F.col("v_ego")).alias("speed"), (F.col("k") * 0.625).alias("hacc"),
    )


def road_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a directed graph over nations, with lengths in metres and tags as map data has them."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("int").alias("node_id"), ((F.col("n_nationkey") % 5) * 100.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 80.0).alias("y"))
    steps = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.lit(k).alias("key")) for k, s in enumerate((1, 3, 7)))))
    edges = nodes.select(F.col("node_id").alias("u"), steps.alias("e")).select("u", ((F.col("u") + F.col("e.step")) % 25).cast("int").alias("v"), F.col("e.key").alias("key")).filter("(u + key * 5) % 4 <> 0")
    kinds = F.array(*(F.lit(x) for x in ("motorway", "primary_link", "residential", "secondary", "tertiary")))
    limits = F.array(*(F.lit(x) for x in ("100", "50 mph", "30", "walk", "60")))
    edges = edges.withColumn("length", 40.0 + ((F.col("u") * 7 + F.col("key") * 31) % 13) * 10.0).withColumn("highway", F.element_at(kinds, (F.col("u") + F.col("key")) % 5 + 1)).withColumn("maxspeed", F.element_at(limits, (F.col("u") + 2 * F.col("key")) % 5 + 1))
    return nodes, edges


def road_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a town of one-way streets that grows with the parts, with places in metres and degrees; some tags are lists."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("node_id")).withColumn("c", F.col("node_id") % 40).withColumn("r", F.floor(F.col("node_id") / 40).cast("int"))
    nodes = n.select("node_id", (F.col("c") * 83.0).alias("x"), (F.col("r") * 109.0).alias("y"), (F.col("c") / 1024 - 75).alias("lon"), (F.col("r") / 1024 + 40).alias("lat"))
    u, row, col = F.col("node_id"), F.col("r"), F.col("c")
    east, north = F.when(row % 2 == 0, 1).otherwise(-1), F.when(col % 2 == 0, 1).otherwise(-1)
    road = lambda right, up, key, length: F.struct(right.alias("right"), up.alias("up"), F.lit(key).alias("key"), length.cast("double").alias("length"))
    roads = n.withColumn("e", F.explode(F.array(road(east, F.lit(0), 0, 85 + u * 7 % 13 * 5), road(F.lit(0), north, 0, 110 + u * 3 % 11 * 5), road(F.lit(1), F.when(u % 7 == 0, 1), 1, 138 + u % 5 * 5))))
    roads = roads.filter((col + F.col("e.right")).between(0, 39)).select(u.alias("u"), (u + F.col("e.right") + 40 * F.col("e.up")).alias("v"), "e.key", "e.length").join(nodes.select(F.col("node_id").alias("v")), "v", "left_semi")
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), i % len(xs) + 1)
    at = F.col("u") + F.col("key")
    edges = roads.select("u", "v", "key", "length", F.array(pick(NETWORK_TAGS, at), F.lit("service")).alias("highway"), pick(NETWORK_LIMITS, F.col("u") + 2 * F.col("key")).alias("maxspeed"), F.array(pick(NETWORK_LANES, at)).alias("lanes"))
    return nodes, edges


NETWORK_TAGS, NETWORK_LIMITS, NETWORK_LANES = ("motorway", "primary_link", "residential", "secondary", "tertiary"), ("100", "50 mph", "30", "walk", "60"), ("2", "1", "3;2", "4")

#: The same views in SQL.
SQL = {
    "ev": "ev AS (SELECT user_id AS route_id, event_id, ts, event_type, value, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)",
    "tel_u": """tel_u AS (SELECT route_id, i, i * 0.5::DOUBLE AS time_s, k,
        CAST(event_type = 'click' AND route_id % 7 <> 0 AS INTEGER) AS cc_lat,
        CAST((event_type = 'view' AND (route_id % 7 <> 0 OR k < 25)) OR (route_id % 7 = 1 AND event_type <> 'error') AS INTEGER) AS cruise_en,
        value / 16 AS v_ego, (k - 50) / 4.0::DOUBLE AS steer, (k - 50) / 50.0::DOUBLE AS a_ego,
        CAST(event_type = 'error' AS INTEGER) AS brake, CAST(event_type = 'purchase' AS INTEGER) AS lcs,
        CAST(event_type = 'signup' AS INTEGER) AS lead_status, value / 4 AS d_rel, CAST(k % 10 = 0 AS INTEGER) AS left_blinker
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY route_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i FROM ev))""",
    "tel_x": "tel_x AS (SELECT route_id, event_id AS i, epoch_us(ts) / 3600000000.0::DOUBLE AS time_s, event_type, value, k FROM ev)",
    "gps_raw": """gps_raw AS (SELECT route_id, i, i * 0.125::DOUBLE AS time_s,
        CASE WHEN ok THEN la + jump END AS phone_lat, CASE WHEN ok THEN lo END AS phone_lon, CASE WHEN ok THEN v_ego END AS phone_speed, CASE WHEN ok THEN k / 8.0::DOUBLE END AS phone_hacc,
        CASE WHEN k = 21 THEN 0.0::DOUBLE ELSE la + jump END AS lat, lo AS lon, CASE WHEN k % 4 = 0 THEN -1.0::DOUBLE ELSE v_ego END AS speed, k * 0.625::DOUBLE AS hacc
        FROM (SELECT route_id, i, k, v_ego, 40.0::DOUBLE + i * 0.00025::DOUBLE + k * 0.0000625::DOUBLE AS la, -75.0::DOUBLE + i * 0.0005::DOUBLE - (k % 16) * 0.000125::DOUBLE AS lo,
              CASE WHEN k = 7 THEN 0.0078125::DOUBLE ELSE 0.0::DOUBLE END AS jump, route_id % 3 <> 0 AND k <> 13 AS ok FROM tel_u))""",
    "nodes": "nodes AS (SELECT CAST(n_nationkey AS INTEGER) AS node_id, (n_nationkey % 5) * 100.0::DOUBLE AS x, floor(n_nationkey / 5) * 80.0::DOUBLE AS y FROM nation)",
    "edges": """edges AS (SELECT u, v, key, 40.0::DOUBLE + ((u * 7 + key * 31) % 13) * 10.0::DOUBLE AS length,
        (['motorway', 'primary_link', 'residential', 'secondary', 'tertiary'])[(u + key) % 5 + 1] AS highway, (['100', '50 mph', '30', 'walk', '60'])[(u + 2 * key) % 5 + 1] AS maxspeed
        FROM (SELECT node_id AS u, CAST((node_id + s.step) % 25 AS INTEGER) AS v, s.key AS key FROM nodes, (VALUES (1, 0), (3, 1), (7, 2)) s(step, key) WHERE (node_id + s.key * 5) % 4 <> 0))""",
    "town": f"""nd AS (SELECT CAST(p_partkey AS INTEGER) AS node_id, CAST(p_partkey % 40 AS INTEGER) AS c, CAST(p_partkey // 40 AS INTEGER) AS r FROM part),
nodes AS (SELECT node_id, c * 83.0::DOUBLE AS x, r * 109.0::DOUBLE AS y, c / 1024.0::DOUBLE - 75 AS lon, r / 1024.0::DOUBLE + 40 AS lat FROM nd),
rd AS (SELECT node_id AS u, c, CASE WHEN r % 2 = 0 THEN 1 ELSE -1 END AS ri, 0 AS up, 0 AS key, 85 + node_id * 7 % 13 * 5 AS length FROM nd
  UNION ALL SELECT node_id, c, 0, CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END, 0, 110 + node_id * 3 % 11 * 5 FROM nd UNION ALL SELECT node_id, c, 1, 1, 1, 138 + node_id % 5 * 5 FROM nd WHERE node_id % 7 = 0),
edges AS (SELECT u, CAST(u + ri + 40 * up AS INTEGER) AS v, key, length::DOUBLE AS length, [({list(NETWORK_TAGS)})[(u + key) % 5 + 1], 'service'][1] AS highway, ({list(NETWORK_LIMITS)})[(u + 2 * key) % 5 + 1] AS maxspeed, [({list(NETWORK_LANES)})[(u + key) % 4 + 1]][1] AS lanes
  FROM rd WHERE c + ri BETWEEN 0 AND 39 AND u + ri + 40 * up IN (SELECT node_id FROM nodes))""",
}


def with_views(*names: str) -> str:
    """A WITH clause of these views and those that they need."""
    needs = {"tel_u": ("ev",), "tel_x": ("ev",), "gps_raw": ("ev", "tel_u"), "edges": ("nodes",)}
    order = list(dict.fromkeys(x for n in names for x in (*needs.get(n, ()), n)))
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order)
