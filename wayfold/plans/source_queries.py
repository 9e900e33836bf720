"""Queries over every source: files are written from the dataset in the shared folder, and read again by their readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shipping import ship
from wayfold.plans import benchmark
from wayfold.plans import dataset as d
from wayfold.plans.engine import Engine
from wayfold.sources import files, folding
from wayfold.sources.jdbc import OVERWRITE, REPLACE, Embedded, Store

QUERIES, ORACLES = {}, {}
_TEXT = "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSS')"
_TIME = _TEXT.format("CAST(timestamp_millis(CAST({0} AS BIGINT)) AS TIMESTAMP_NTZ)")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only where none is named and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wayfold-files-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_csv(df: DataFrame, name: str) -> str:
    """df as CSV files with a header each; their folder."""
    path = folder(df.sparkSession, name)
    df.write.option("header", True).option("emptyValue", "").csv(path)
    return path


def _add(name: str, run, oracle: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d.functions(spark)
        return run(spark, sf_dir)

    QUERIES[f"src_{name}"] = query
    # the database of the oracles takes no column called by
    ORACLES[f"src_{name}"] = re.sub(r"\bby\b", "b_y", oracle)


def segment_rows(trips: DataFrame) -> DataFrame:
    """The rows of a trips file: one for each segment, a trip of one vertex being a segment without length."""
    pairs = "explode(IF(size(t) = 1, array(named_struct('a', t[0], 'b', t[0])), transform(sequence(0, size(t) - 2), i -> named_struct('a', t[i], 'b', t[i + 1]))))"
    return trips.selectExpr("moid", "trip_id", f"{pairs} AS s").selectExpr(
        "moid", "trip_id", f"{_TIME.format('s.a.m')} AS tstart", f"{_TIME.format('s.b.m')} AS tend", "s.a.x AS xstart", "s.a.y AS ystart", "s.b.x AS xend", "s.b.y AS yend"
    )


_LINE = "trip_id", "moid", "size({0}) AS n", "CAST({0}[0].m AS BIGINT) AS f", "CAST(element_at({0}, -1).m AS BIGINT) AS l", "aggregate({0}, 0D, (a, p) -> a + p.x) AS sx", "aggregate({0}, 0D, (a, p) -> a + p.y) AS sy"
_VERTICES = " SELECT trip_id, moid, count(*)::INT AS n, min(m) AS f, max(m) AS l, sum(x) AS sx, sum(y) AS sy FROM v {where} GROUP BY ALL"


def _lines(df: DataFrame, column: str) -> DataFrame:
    return df.selectExpr(*[e.format(column) for e in _LINE])


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.trips(spark, sf_dir).where("size(t) > 1")


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(files.trips(spark, as_csv(segment_rows(_several(spark, sf_dir)), "trips")), "polyline")


def _generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic fold source: neighbouring rows of a trip stand together in one file."""
    ship(spark)
    folding.register(spark)
    pairs = "posexplode(transform(sequence(0, size(t) - 2), i -> named_struct('a', t[i], 'b', t[i + 1]))) AS (i, s)"
    rows = _several(spark, sf_dir).selectExpr("moid", "trip_id", pairs).repartition("trip_id").sortWithinPartitions("trip_id", "i")
    path = as_csv(rows.selectExpr("moid", "trip_id", "s.a.m AS ta", "s.b.m AS tb", "s.a.x AS xa", "s.a.y AS ya", "s.b.x AS xb", "s.b.y AS yb"), "fold")
    schema = "trip_id BIGINT, moid BIGINT, polyline ARRAY<STRUCT<x:DOUBLE,y:DOUBLE,m:DOUBLE>>"
    return _lines(spark.read.format("wayfold_fold").schema(schema).options(path=path, fold="wayfold.sources.folding:adjacent_trips").load(), "polyline")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.regions(spark).selectExpr("polygon_id", "posexplode(transform(sequence(0, size(polygon[0]) - 2), i -> named_struct('a', polygon[0][i], 'b', polygon[0][i + 1]))) AS (seg, s)")
    path = as_csv(rows.selectExpr("polygon_id", "seg", "s.a.x AS xstart", "s.a.y AS ystart", "s.b.x AS xend", "s.b.y AS yend"), "regions")
    return files.regions(spark, path).selectExpr("polygon_id", "size(polygon) AS rings", "explode(slice(polygon[0], 1, size(polygon[0]) - 1)) AS p").groupBy("polygon_id", "rings").agg(F.count("*").cast("int").alias("n"), F.sum("p.x").alias("sx"), F.sum("p.y").alias("sy"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = as_csv(d.points(spark, sf_dir).selectExpr("point_id", "point.x AS x", "point.y AS y"), "points")
    return files.points(spark, path).selectExpr("point_id", "point.x AS x", "point.y AS y")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = as_csv(d.instants(spark, sf_dir).selectExpr("instant_id", f"{_TEXT.format('instant')} AS instant"), "instants")
    return files.instants(spark, path).selectExpr("instant_id", "unix_millis(CAST(instant AS TIMESTAMP)) AS ms")


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = as_csv(d.periods(spark, sf_dir).selectExpr("period_id", f"{_TEXT.format('start_period')} AS a", f"{_TEXT.format('end_period')} AS b"), "periods")
    return files.periods(spark, path).selectExpr("period_id", "unix_millis(CAST(start_period AS TIMESTAMP)) AS a", "unix_millis(CAST(end_period AS TIMESTAMP)) AS b")


def _taxi(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = "concat('[', array_join(transform(t, p -> concat('[', p.x, ',', p.y, ']')), ','), ']')"
    rows = d.trips(spark, sf_dir).selectExpr(
        "concat('T', trip_id) AS trip_id", "element_at(array('A', 'B', 'C'), CAST(moid % 3 + 1 AS INT)) AS call_type", "IF(moid % 3 = 0, moid, NULL) AS origin_call", "IF(moid % 3 = 1, moid % 64, NULL) AS origin_stand",
        "moid AS taxi_id", "CAST(t[0].m AS BIGINT) div 1000 AS timestamp", "'A' AS day_type", "IF(moid % 2 = 0, 'True', 'False') AS missing_data", f"{pairs} AS polyline",
    )
    read = files.taxi(spark, as_csv(rows, "taxi"))
    return read.selectExpr("trip_id", "call_type", "origin_call", "origin_stand", "missing_data", "size(polyline) AS n", "CAST(element_at(polyline, -1).m AS BIGINT) AS last", "aggregate(polyline, 0D, (a, p) -> a + p.x) AS sx")


def _birds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {"event_id": "event_id", "location_long": "IF(event_id % 50 = 0, NULL, x)", "location_lat": "y", "timestamp": _TIME.format("m"), "visible": "IF(event_id % 3 = 0, 'false', 'true')", "gps_satellite_count": "event_id % 9", "sensor_type": "'gps'"}
    cells |= {"individual_taxon_canonical_name": "'Bird'", "tag_local_identifier": "concat('T', user_id)", "individual_local_identifier": "concat('B', user_id)", "study_name": "'S'"}
    names = [f.strip().split()[0] for f in files.BIRD.split(",")]
    read = files.birds(spark, as_csv(d.events(spark, sf_dir).selectExpr(*[f"{cells.get(n, 'CAST(NULL AS STRING)')} AS {n}" for n in names]), "birds"))
    return read.selectExpr(
        "individual_local_identifier AS bird", "size(events) AS n", "size(polyline) AS fixes", "CAST(element_at(polyline, -1).m AS BIGINT) AS last", "aggregate(polyline, 0D, (a, p) -> a + p.x) AS sx",
        "size(filter(events, e -> e.visible)) AS visible", "aggregate(events, 0L, (a, e) -> a + e.gps_satellite_count) AS satellites",
    )


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips written as Parquet and scanned by the front door through their path."""
    path = folder(spark, "trips") + ".parquet"
    d.trips(spark, sf_dir).select("trip_id", "moid", "t").write.parquet(path)
    return Engine(spark).sql(f"SELECT trip_id, moid, array_length(t) AS n, duration(t) AS ms FROM '{path}' WHERE moid % 2 = 0")


def _one_process(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def store(spark: SparkSession, tables: list[str]) -> Store:
    """A database in the memory of the driver, which a local master shares with its executors; elsewhere one in the folder that all share."""
    if _one_process(spark):
        made = Store(spark, f"jdbc:derby:memory:w{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    else:
        made = Embedded.create(spark, folder(spark, "database"))
    made.execute(tables)
    return made


def _readable(db: Store) -> Store:
    """The database for scans: every executor may read it."""
    return db.published() if isinstance(db, Embedded) else db


def _jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk load, then new and changed rows by key, then a scan whose geometry columns are found by their contents."""
    db = store(spark, ["CREATE TABLE TRIPS (TRIP_ID BIGINT PRIMARY KEY, MOID BIGINT, POLYLINE VARCHAR(32000))"])
    trips = d.trips(spark, sf_dir).selectExpr("trip_id AS TRIP_ID", "moid AS MOID", "t AS POLYLINE")
    db.write(trips.where("moid % 3 = 0").withColumn("MOID", F.lit(-1)), "TRIPS", OVERWRITE)
    db.write(trips.where("moid % 3 < 2"), "TRIPS", REPLACE, ["TRIP_ID"])
    db = _readable(db)
    r = db.query("SELECT min(TRIP_ID) AS LOW, max(TRIP_ID) AS HIGH FROM TRIPS").first()
    ranges = None if r["LOW"] is None else ("TRIP_ID", r["LOW"], r["HIGH"], spark.sparkContext.defaultParallelism)
    return _lines(db.decoded(db.table("TRIPS", ranges), {"POLYLINE": "trajectory"}).selectExpr("TRIP_ID AS trip_id", "MOID AS moid", "POLYLINE AS polyline"), "polyline")


def _jdbc_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat table through the database's catalog: filter and aggregate run there."""
    db = store(spark, ["CREATE TABLE CARS (MOID BIGINT, LICENCE VARCHAR(20), KIND VARCHAR(20))"])
    db.write(d.cars(spark, sf_dir).selectExpr("moid AS MOID", "licence AS LICENCE", "type AS KIND"), "CARS")
    name = f"wf{uuid.uuid4().hex}"
    _readable(db).catalog(name)
    return spark.sql(f"SELECT KIND AS kind, count(*) AS n FROM {name}.APP.CARS WHERE MOID > 10 GROUP BY KIND")


_add("csv_trips", _trips, d.ORACLE + _VERTICES.format(where="WHERE n > 1"))
_add("fold", _generic, d.ORACLE + _VERTICES.format(where="WHERE n > 1"))
_add("csv_regions", _regions, d.ORACLE + " SELECT polygon_id, 1::INT AS rings, count(*)::INT AS n, sum(ax) AS sx, sum(ay) AS sy FROM e WHERE ring = 0 GROUP BY polygon_id")
_add("csv_points", _points, d.ORACLE + " SELECT point_id, px AS x, py AS y FROM points")
_add("csv_instants", _instants, d.ORACLE + " SELECT instant_id, im AS ms FROM instants")
_add("csv_periods", _periods, d.ORACLE + " SELECT period_id, pa AS a, pb AS b FROM periods")
_add("csv_licences", lambda spark, sf: files.licences(spark, as_csv(d.licences(spark, sf).select("licence", "licence_id"), "licences")), d.ORACLE + " SELECT licence_id, licence FROM licences")
_add("csv_datamcar", lambda spark, sf: files.datamcar(spark, as_csv(d.cars(spark, sf), "datamcar")), d.ORACLE + " SELECT moid, licence, type, model FROM datamcar")
_add("csv_taxi", _taxi, d.ORACLE + " SELECT 'T' || trip_id AS trip_id, ['A', 'B', 'C'][moid % 3 + 1] AS call_type, CASE WHEN moid % 3 = 0 THEN moid END AS origin_call, CASE WHEN moid % 3 = 1 THEN moid % 64 END AS origin_stand, moid % 2 = 0 AS missing_data, count(*)::INT AS n, min(m) // 1000 + 15 * (count(*) - 1) AS last, sum(x) AS sx FROM v GROUP BY trip_id, moid")
_add("csv_birds", _birds, """SELECT 'B' || user_id AS bird, count(*)::INT AS n, (count(*) FILTER (event_id % 50 <> 0))::INT AS fixes, max(epoch_us(ts) // 1000000) FILTER (event_id % 50 <> 0) AS last,
coalesce(sum(13 + (event_id * 37 % 1024) / 1024.0::DOUBLE) FILTER (event_id % 50 <> 0), 0) AS sx, (count(*) FILTER (event_id % 3 <> 0))::INT AS visible, sum(event_id % 9)::BIGINT AS satellites FROM events GROUP BY user_id""")
_add("parquet", _parquet, d.ORACLE + " SELECT trip_id, moid, n::INT AS n, l - f AS ms FROM tr WHERE moid % 2 = 0")
_add("url_table", lambda spark, sf: Engine(spark).sql(f"SELECT n.n_name, r.r_name FROM '{sf}/nation.parquet' n JOIN '{sf}/region.parquet' r ON n.n_regionkey = r.r_regionkey"), "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_add("jdbc_modes", _jdbc, d.ORACLE + _VERTICES.format(where="WHERE moid % 3 < 2"))
_add("jdbc_pushed", _jdbc_pushed, d.ORACLE + " SELECT type AS kind, count(*) AS n FROM datamcar WHERE moid > 10 GROUP BY type")


def _envelope(lines: DataFrame) -> DataFrame:
    """Lines (trip_id, moid, t) with their envelope, as the dataset's trips have it."""
    return lines.selectExpr("trip_id", "moid", "t", *(f"array_m{a}(transform(t, p -> p.{c})) AS {n}m{a}" for c, n in (("x", "x"), ("y", "y"), ("m", "t")) for a in ("in", "ax")))


def _q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q13 over two kinds of files: half of the vehicles' trips in Parquet, half as CSV segments."""
    d.views(spark, sf_dir)
    trips = d.trips(spark, sf_dir).select("trip_id", "moid", "t")
    path = folder(spark, "trips")
    trips.where("moid % 2 = 0").write.parquet(path)
    other = files.trips(spark, as_csv(segment_rows(trips.where("moid % 2 = 1")), "trips")).selectExpr("trip_id", "moid", "polyline AS t")
    _envelope(spark.read.parquet(path).unionByName(other)).createOrReplaceTempView("all_trips")
    return spark.sql(benchmark.q13_over("all_trips"))


def _q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q13 over CSV files and a database, which holds the trips as EWKB; where the master isn't local, a Parquet table of EWKB stands for the database."""
    d.views(spark, sf_dir)
    trips = d.trips(spark, sf_dir).select("trip_id", "moid", "t")
    own = files.trips(spark, as_csv(segment_rows(trips.where("moid % 2 = 0")), "trips")).selectExpr("trip_id", "moid", "polyline AS t")
    odd = trips.where("moid % 2 = 1")
    if _one_process(spark):
        db = store(spark, ["CREATE TABLE TRIPS (TRIP_ID BIGINT PRIMARY KEY, MOID BIGINT, T VARCHAR(32000))"])
        db.write(odd.toDF("TRIP_ID", "MOID", "T"), "TRIPS")
        other = db.decoded(db.table("TRIPS"), {"T": "trajectory"}).toDF("trip_id", "moid", "t")
    else:
        path = folder(spark, "ewkb")
        odd.selectExpr("trip_id", "moid", "trajectory_to_wkb(t) AS b").write.parquet(path)
        other = spark.read.parquet(path).selectExpr("trip_id", "moid", "wkb_to_trajectory(b) AS t")
    _envelope(own.unionByName(other)).createOrReplaceTempView("all_trips")
    return spark.sql(benchmark.q13_over("all_trips"))


def _plain(name: str, run) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d.functions(spark)
        return run(spark, sf_dir)

    QUERIES[name], ORACLES[name] = query, benchmark.ORACLES["q13"]


_plain("q21", _q21)
_plain("q22", _q22)
