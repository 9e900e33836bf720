"""A moving-object dataset derived from the events table, and the same in DuckDB SQL for the oracles.

m is the event time in whole milliseconds; a trip is a user's events within a six-day bucket, one vertex for each m
(the smallest event id); coordinates are multiples of 1/1024, so that equality and sums are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import registry

BUCKET_MS = 6 * 86_400_000
#: (region id, WKT): rectangles, a concave polygon, one with a hole, and one with edges along the vertex grid.
REGIONS = (
    (1, "POLYGON((13.1 52.1,13.4 52.1,13.4 52.4,13.1 52.4,13.1 52.1))"),
    (2, "POLYGON((13.5 52.5,13.75 52.5,13.75 52.75,13.5 52.75,13.5 52.5))"),
    (3, "POLYGON((13.2 52.2,13.8 52.2,13.8 52.8,13.5 52.4,13.2 52.8,13.2 52.2))"),
    (4, "POLYGON((13 52,14 52,14 53,13 53,13 52),(13.25 52.25,13.75 52.25,13.75 52.75,13.25 52.75,13.25 52.25))"),
    (5, "POLYGON((13.90625 52.90625,13.984375 52.90625,13.984375 52.984375,13.90625 52.984375,13.90625 52.90625))"),
)


def functions(spark: SparkSession) -> None:
    """Registers the SQL functions once for a session."""
    if not getattr(spark, "_wayfold_functions", False):
        registry.register(spark)
        spark._wayfold_functions = True


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", m.alias("m"), F.expr("13 + (event_id * 37 % 1024) / 1024D").alias("x"), F.expr("52 + (event_id * 91 % 1024) / 1024D").alias("y"))


def trips(spark: SparkSession, sf_dir: str, moids: DataFrame | None = None) -> DataFrame:
    """trip_id, moid, t (the trajectory) and its envelope xmin, xmax, ymin, ymax, tmin, tmax; of the few vehicles in ``moids``, or of all.

    Both groupings share one shuffle: the trip is a part of the inner key's partitioning.
    """
    functions(spark)
    e = events(spark, sf_dir)
    if moids is not None:
        e = e.join(F.broadcast(moids.select(F.col("moid").alias("user_id"))), "user_id", "left_semi")
    e = e.withColumn("trip_id", F.expr(f"user_id * 100000 + m div {BUCKET_MS}")).repartition("trip_id")
    one = e.groupBy("trip_id", "user_id", "m").agg(F.min("event_id").alias("e"))
    vertex = F.expr("named_struct('m', CAST(m AS DOUBLE), 'x', 13 + (e * 37 % 1024) / 1024D, 'y', 52 + (e * 91 % 1024) / 1024D)")
    rows = one.groupBy("trip_id", F.col("user_id").alias("moid")).agg(F.sort_array(F.collect_list(vertex)).alias("v"))
    t = rows.select("trip_id", "moid", F.expr("transform(v, p -> named_struct('x', p.x, 'y', p.y, 'm', p.m))").alias("t"))
    return t.selectExpr("*", *(f"array_m{a}(transform(t, p -> p.{c})) AS {n}m{a}" for c, n in (("x", "x"), ("y", "y"), ("m", "t")) for a in ("in", "ax")))


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().selectExpr("user_id AS moid", "concat('L-', user_id) AS licence", "CASE user_id % 3 WHEN 0 THEN 'passenger' WHEN 1 THEN 'truck' ELSE 'bus' END AS type", "concat('M', user_id % 7) AS model")


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth plate, with the vehicle by a left join."""
    plates = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().where("user_id % 5 = 0").selectExpr("user_id AS licence_id", "concat('L-', user_id) AS licence")
    return plates.join(cars(spark, sf_dir).select("licence", "moid"), "licence", "left").select("licence_id", "licence", "moid")


def sample(df: DataFrame, key: str, skip: int = 0) -> DataFrame:
    """Ten rows by key: the benchmark's sample views."""
    return df.orderBy(key).offset(skip).limit(10)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_id % 97 = 0").selectExpr("event_id AS point_id", "named_struct('x', x + IF(event_id % 2 = 0, 0D, 1 / 4096D), 'y', y) AS point")


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_id % 101 = 0").selectExpr("event_id AS instant_id", "CAST(timestamp_millis(m + IF(event_id % 2 = 0, 0, 3600000)) AS TIMESTAMP_NTZ) AS instant")


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_id % 103 = 0").selectExpr("event_id AS period_id", "CAST(timestamp_millis(m) AS TIMESTAMP_NTZ) AS start_period", "CAST(timestamp_millis(m + (event_id % 5 + 1) * 86400000) AS TIMESTAMP_NTZ) AS end_period")


def regions(spark: SparkSession) -> DataFrame:
    functions(spark)
    rows = spark.createDataFrame(list(REGIONS), "polygon_id long, wkt string")
    ring = "transform(polygon[0], p -> p.{c})"
    return rows.selectExpr("polygon_id", "polygon_from_text(wkt) AS polygon").selectExpr("*", *(f"array_m{a}({ring.format(c=c)}) AS p{c}m{a}" for c in "xy" for a in ("in", "ax")))


def views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views under the names that the queries use."""
    trips(spark, sf_dir).createOrReplaceTempView("trips")
    cars(spark, sf_dir).createOrReplaceTempView("datamcar")
    for name, df, key in (("licences", licences(spark, sf_dir), "licence_id"), ("points", points(spark, sf_dir), "point_id"), ("instants", instants(spark, sf_dir), "instant_id"), ("periods", periods(spark, sf_dir), "period_id"), ("regions", regions(spark), "polygon_id")):
        df.createOrReplaceTempView(name)
        sample(df, key).createOrReplaceTempView(f"{name}1")
    sample(licences(spark, sf_dir), "licence_id", 10).createOrReplaceTempView("licences2")


def _edges() -> str:
    import re

    rows = []
    for rid, wkt in REGIONS:
        for ring, text in enumerate(re.findall(r"\(([^()]+)\)", wkt)):
            xy = [p.split() for p in text.split(",")]
            rows += [f"({rid},{ring},{a[0]}::DOUBLE,{a[1]}::DOUBLE,{b[0]}::DOUBLE,{b[1]}::DOUBLE)" for a, b in zip(xy, xy[1:], strict=False)]
    return ", ".join(rows)


#: The dataset in DuckDB: vertices v, trips tr, segments s, edges e and the small tables.
ORACLE = f"""
WITH v0 AS (SELECT user_id AS moid, epoch_us(ts) // 1000 AS m, min(event_id) AS e FROM events GROUP BY ALL),
v AS (SELECT moid, moid * 100000 + m // {BUCKET_MS} AS trip_id, m, 13 + (e * 37 % 1024) / 1024.0::DOUBLE AS x, 52 + (e * 91 % 1024) / 1024.0::DOUBLE AS y,
      row_number() OVER (PARTITION BY moid, m // {BUCKET_MS} ORDER BY m) AS i, count(*) OVER (PARTITION BY moid, m // {BUCKET_MS}) AS n FROM v0),
tr AS (SELECT trip_id, moid, min(m) AS f, max(m) AS l, count(*) AS n, arg_min(x, m) AS fx, arg_min(y, m) AS fy, arg_max(x, m) AS lx, arg_max(y, m) AS ly FROM v GROUP BY ALL),
s0 AS (SELECT trip_id, moid, i, n, m AS t0, x AS ax, y AS ay, lead(m) OVER w AS t1, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM v WINDOW w AS (PARTITION BY trip_id ORDER BY m)),
s AS (SELECT trip_id, moid, i, n, t0, ax, ay, coalesce(t1, t0) AS t1, coalesce(bx, ax) AS bx, coalesce(by, ay) AS by FROM s0 WHERE t1 IS NOT NULL OR n = 1),
datamcar AS (SELECT DISTINCT user_id AS moid, 'L-' || user_id AS licence, CASE user_id % 3 WHEN 0 THEN 'passenger' WHEN 1 THEN 'truck' ELSE 'bus' END AS type, 'M' || (user_id % 7) AS model FROM events),
licences AS (SELECT moid AS licence_id, licence, moid FROM datamcar WHERE moid % 5 = 0),
licences1 AS (SELECT * FROM licences ORDER BY licence_id LIMIT 10),
licences2 AS (SELECT * FROM licences ORDER BY licence_id LIMIT 10 OFFSET 10),
points AS (SELECT event_id AS point_id, 13 + (event_id * 37 % 1024) / 1024.0::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 / 4096.0::DOUBLE END AS px, 52 + (event_id * 91 % 1024) / 1024.0::DOUBLE AS py FROM events WHERE event_id % 97 = 0),
points1 AS (SELECT * FROM points ORDER BY point_id LIMIT 10),
instants AS (SELECT event_id AS instant_id, epoch_us(ts) // 1000 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 3600000 END AS im FROM events WHERE event_id % 101 = 0),
instants1 AS (SELECT * FROM instants ORDER BY instant_id LIMIT 10),
periods AS (SELECT event_id AS period_id, epoch_us(ts) // 1000 AS pa, epoch_us(ts) // 1000 + (event_id % 5 + 1) * 86400000 AS pb FROM events WHERE event_id % 103 = 0),
periods1 AS (SELECT * FROM periods ORDER BY period_id LIMIT 10),
e(polygon_id, ring, ax, ay, bx, by) AS (VALUES {_edges()}),
sight AS (SELECT t.trip_id, t.moid, q.instant_id, q.im, s.t0, s.t1,
          CASE WHEN s.t0 = q.im THEN s.ax WHEN s.t1 = q.im THEN s.bx ELSE s.ax + (q.im - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.bx - s.ax) END AS x,
          CASE WHEN s.t0 = q.im THEN s.ay WHEN s.t1 = q.im THEN s.by ELSE s.ay + (q.im - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.by - s.ay) END AS y
          FROM tr t JOIN instants1 q ON t.f <= q.im AND t.l >= q.im JOIN s ON s.trip_id = t.trip_id AND s.t0 <= q.im AND s.t1 >= q.im
          QUALIFY row_number() OVER (PARTITION BY t.trip_id, q.instant_id ORDER BY s.t0) = 1),
clip AS (SELECT s.trip_id, s.moid, p.period_id, greatest(s.t0, p.pa) AS ca, least(s.t1, p.pb) AS cb, s.t0, s.t1,
         CASE WHEN s.t0 >= p.pa OR s.t1 = s.t0 THEN s.ax ELSE s.ax + (p.pa - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.bx - s.ax) END AS ax,
         CASE WHEN s.t0 >= p.pa OR s.t1 = s.t0 THEN s.ay ELSE s.ay + (p.pa - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.by - s.ay) END AS ay,
         CASE WHEN s.t1 <= p.pb THEN s.bx ELSE s.ax + (p.pb - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.bx - s.ax) END AS bx,
         CASE WHEN s.t1 <= p.pb THEN s.by ELSE s.ay + (p.pb - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.by - s.ay) END AS by
         FROM s JOIN periods1 p ON s.t0 <= p.pb AND (s.t1 > p.pa OR (s.n = 1 AND s.t0 >= p.pa)))
"""
