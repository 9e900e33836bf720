"""File sources: path resolution, lenient parsing, and the fold of per-row records into trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.types import POINT, TRAJECTORY


class SourceError(ValueError):
    """A path with nothing to read."""


def resolve(spark: SparkSession, path: str) -> list[str]:
    """A file as itself, a folder as its files (not its folders) in order of name; nothing there is an error.

    Goes through Hadoop's file systems, so any store that Spark reads will do.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceError(f"no such file or folder: {path}")
    if fs.getFileStatus(p).isFile():
        return [path]
    found = sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith((".", "_")))
    if not found:
        raise SourceError(f"no files in: {path}")
    return found


def instant(text: Column | str) -> Column:
    """A timestamp of text that may end after the date, the hour or the minute; null if it is none."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    full = (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit(" 00:00:00")))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}$"), F.concat(c, F.lit(":00:00")))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}$"), F.concat(c, F.lit(":00")))
        .otherwise(c)
    )
    return full.try_cast("timestamp_ntz")


def millis(text: Column | str) -> Column:
    """Epoch milliseconds of such a timestamp."""
    return F.unix_millis(instant(text).cast("timestamp"))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of all files: a bad cell is an error; an empty cell is an empty text, and null in other columns."""
    fields = [f.strip().split() for f in schema.split(",")]
    raw = spark.read.schema(", ".join(f"{n} STRING" for n, _ in fields)).option("header", header).option("enforceSchema", True).option("emptyValue", "").option("mode", "FAILFAST").csv(resolve(spark, path))
    return raw.selectExpr(*[f"coalesce({n}, '') AS {n}" if t == "STRING" else f"CAST(nullif(trim({n}), '') AS {t}) AS {n}" for n, t in fields])


def fold(rows: DataFrame, key: list[str], order: list[str], start: tuple[str, str, str], end: tuple[str, str, str]) -> DataFrame:
    """One trajectory ``polyline`` for each key out of segment rows: the first row gives both its ends, later ones their last.

    Equal rows count once. Each trip is gathered in one row, so a trip must fit a task; trips are spread by key.
    """
    def vertex(v: tuple[str, str, str]) -> str:
        return f"named_struct('x', CAST({v[0]} AS DOUBLE), 'y', CAST({v[1]} AS DOUBLE), 'm', CAST({v[2]} AS DOUBLE))"

    entry = f"named_struct({', '.join(f'{chr(39)}o{i}{chr(39)}, {o}' for i, o in enumerate(order))}, 'a', {vertex(start)}, 'b', {vertex(end)})"
    gathered = rows.groupBy(*key).agg(F.expr(f"array_sort(collect_set({entry}))").alias("e"))
    return gathered.selectExpr(*key, f"CAST(concat(array(e[0].a), transform(e, v -> v.b)) AS {TRAJECTORY}) AS polyline")


TRIPS = "moid BIGINT, trip_id BIGINT, tstart STRING, tend STRING, xstart DOUBLE, ystart DOUBLE, xend DOUBLE, yend DOUBLE"


def trips(spark: SparkSession, path: str) -> DataFrame:
    """trip_id, moid, polyline of a file with one row for each segment; m in epoch milliseconds."""
    rows = read_csv(spark, path, TRIPS).select("*", millis("tstart").alias("ta"), millis("tend").alias("tb"))
    return fold(rows, ["trip_id", "moid"], ["ta", "tb"], ("xstart", "ystart", "ta"), ("xend", "yend", "tb"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """polygon_id, polygon (one ring) of a file with one row for each edge; a file that holds its rows twice gives each region once."""
    rows = read_csv(spark, path, "polygon_id BIGINT, seg BIGINT, xstart DOUBLE, ystart DOUBLE, xend DOUBLE, yend DOUBLE")
    entry = "named_struct('seg', seg, 'a', named_struct('x', xstart, 'y', ystart), 'b', named_struct('x', xend, 'y', yend))"
    gathered = rows.groupBy("polygon_id").agg(F.expr(f"array_sort(collect_set({entry}))").alias("e"))
    return gathered.selectExpr("polygon_id", "array(concat(array(e[0].a), transform(e, v -> v.b))) AS polygon")


def points(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "point_id BIGINT, x DOUBLE, y DOUBLE").selectExpr("point_id", f"CAST(named_struct('x', x, 'y', y) AS {POINT}) AS point")


def instants(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "instant_id BIGINT, instant STRING").select("instant_id", instant("instant").alias("instant"))


def periods(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "period_id BIGINT, a STRING, b STRING").select("period_id", instant("a").alias("start_period"), instant("b").alias("end_period"))


def licences(spark: SparkSession, path: str) -> DataFrame:
    """The file has the plate first, then its id."""
    return read_csv(spark, path, "licence STRING, licence_id BIGINT").select("licence_id", "licence")


def datamcar(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "moid BIGINT, licence STRING, type STRING, model STRING")


TABLES = {"trips": trips, "regions": regions, "points": points, "instants": instants, "periods": periods, "licences": licences, "datamcar": datamcar}


def taxi(spark: SparkSession, path: str) -> DataFrame:
    """Taxi rides: the polyline column is a list of [lon, lat] pairs, 15 seconds apart from ``timestamp`` (seconds).

    A pair that isn't two values is an error; a value that is no number counts as 0.
    """
    raw = read_csv(spark, path, "trip_id STRING, call_type STRING, origin_call BIGINT, origin_stand BIGINT, taxi_id BIGINT, timestamp BIGINT, day_type STRING, missing_data STRING, polyline STRING")
    pairs = "regexp_extract_all(regexp_extract(polyline, '^\\\\s*\\\\[(.*)\\\\]\\\\s*$', 1), '\\\\[([^\\\\[\\\\]]*)\\\\]', 1)"
    number = lambda i: f"coalesce(try_cast(trim(split(p, ',')[{i}]) AS DOUBLE), 0D)"
    vertex = f"named_struct('x', {number(0)}, 'y', {number(1)}, 'm', CAST(timestamp AS DOUBLE) + 15D * i)"
    checked = f"transform({pairs}, (p, i) -> CASE WHEN size(split(p, ',')) = 2 THEN {vertex} ELSE CAST(raise_error(concat('not a pair: ', p)) AS STRUCT<x:DOUBLE,y:DOUBLE,m:DOUBLE>) END)"
    return raw.selectExpr("trip_id", "call_type", "origin_call", "origin_stand", "taxi_id", "timestamp", "day_type", "lower(missing_data) = 'true' AS missing_data", f"CAST({checked} AS {TRAJECTORY}) AS polyline")


#: Fields of a bird's fix, after its id.
EVENT = (
    "event_id BIGINT, location_long DOUBLE, location_lat DOUBLE, timestamp STRING, visible STRING, acceleration_raw_x DOUBLE, acceleration_raw_y DOUBLE, acceleration_raw_z DOUBLE, "
    "bar_barometric_pressure DOUBLE, external_temperature DOUBLE, gps_dop DOUBLE, gps_satellite_count BIGINT, gps_time_to_fix DOUBLE, ground_speed DOUBLE, heading DOUBLE, height_above_msl DOUBLE, "
    "location_error_numerical DOUBLE, manually_marked_outlier STRING, tilt_x DOUBLE, tilt_y DOUBLE, tilt_z DOUBLE, vertical_error_numerical DOUBLE, sensor_type STRING"
)
BIRD = EVENT + ", individual_taxon_canonical_name STRING, tag_local_identifier STRING, individual_local_identifier STRING, study_name STRING"


def birds(spark: SparkSession, path: str) -> DataFrame:
    """One row for each bird: its polyline (m in epoch seconds) and all its fixes, both in order of time and event.

    Fixes without position or time are in the event list only.
    """
    raw = read_csv(spark, path, BIRD).withColumn("at", F.floor(millis("timestamp") / 1000).cast("long"))
    names = [f.strip().split()[0] for f in EVENT.split(",")]
    cell = {"timestamp": "at", "visible": "lower(visible) = 'true'", "manually_marked_outlier": "lower(manually_marked_outlier) = 'true'"}
    event = "named_struct(" + ", ".join(f"'{n}', {cell.get(n, n)}" for n in names) + ")"
    by = ["individual_taxon_canonical_name", "tag_local_identifier", "individual_local_identifier", "study_name"]
    gathered = raw.groupBy(*by).agg(F.expr(f"array_sort(collect_list(named_struct('at', at, 'id', event_id, 'e', {event})))").alias("g"))
    line = "transform(filter(g, v -> v.at IS NOT NULL AND v.e.location_long IS NOT NULL AND v.e.location_lat IS NOT NULL), v -> named_struct('x', v.e.location_long, 'y', v.e.location_lat, 'm', CAST(v.at AS DOUBLE)))"
    return gathered.selectExpr(f"CAST({line} AS {TRAJECTORY}) AS polyline", *by, "transform(g, v -> v.e) AS events")
