"""A time-series store over HTTP: a Python data source that reads JSON lines, and line-protocol writes.

Vertices are stored one a point (``trips,trip_id=1,moid=2 index=0,x=..,y=.. time``) and folded again when read.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from wayfold.functions.types import TRAJECTORY

#: Lines in one write request.
LINES = 5000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def condition(f: Filter) -> str | None:
    """SQL of a pushed filter on a plain column; None if it must be tested here."""
    sign = _SIGNS.get(type(f))
    if not sign or len(f.attribute) != 1 or isinstance(f.value, bool) or not isinstance(f.value, (int, float, str)):
        return None
    return f"{f.attribute[0]} {sign} {_literal(f.value)}"


class SeriesReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields, self.options, self.where = schema.fieldNames(), dict(options), []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            sql = condition(f)
            if sql is None:
                yield f
            else:
                self.where.append(sql)

    def sql(self) -> str:
        where = f" WHERE {' AND '.join(self.where)}" if self.where else ""
        order = f" ORDER BY {self.options['order']}" if "order" in self.options else ""
        return f"SELECT {', '.join(self.fields)} FROM {self.options['measurement']}{where}{order}"

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        query = urllib.parse.urlencode({"db": self.options.get("db", ""), "q": self.sql(), "format": "jsonl"})
        request = urllib.request.Request(f"{self.options['url']}/api/v3/query_sql?{query}", headers={"Authorization": f"Bearer {self.options.get('token', '')}"})
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout_s", 60))) as answer:
            for line in answer:
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(f) for f in self.fields)


class SeriesSource(DataSource):
    """format("wayfold_series") with options url, db, token, measurement and order, and a schema."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_series"

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)


def read(spark: SparkSession, measurement: str, schema: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("wayfold_series").schema(schema).options(measurement=measurement, **options).load()


def trips(spark: SparkSession, **options: str) -> DataFrame:
    """trip_id, moid, polyline: the stored vertices folded by their index."""
    rows = read(spark, "trips", "trip_id BIGINT, moid BIGINT, index BIGINT, x DOUBLE, y DOUBLE, time BIGINT", **options)
    entry = F.expr("named_struct('i', index, 'v', named_struct('x', x, 'y', y, 'm', CAST(time AS DOUBLE)))")
    return rows.groupBy("trip_id", "moid").agg(F.array_sort(F.collect_list(entry)).alias("e")).selectExpr("trip_id", "moid", f"CAST(transform(e, p -> p.v) AS {TRAJECTORY}) AS polyline")


def _tag(c: str) -> str:
    return f"regexp_replace(CAST({c} AS STRING), '([,= ])', '\\\\\\\\$1')"


def trip_lines(df: DataFrame) -> DataFrame:
    """(line) of every vertex of trips (trip_id, moid, polyline)."""
    vertices = df.select("trip_id", "moid", F.posexplode("polyline").alias("i", "v"))
    return vertices.selectExpr("concat('trips,trip_id=', trip_id, ',moid=', moid, ' index=', i, 'i,x=', v.x, ',y=', v.y, ' ', CAST(v.m AS BIGINT)) AS line")


def lines(df: DataFrame, measurement: str, tags: list[str], fields: list[str], time: str = "0") -> DataFrame:
    """(line) of every row of a flat table; text fields are quoted, whole numbers marked."""
    kinds = dict(df.dtypes)

    def value(c: str) -> str:
        if kinds[c] == "string":
            return f"concat('\"', regexp_replace({c}, '([\"\\\\\\\\])', '\\\\\\\\$1'), '\"')"
        if kinds[c].startswith("timestamp"):
            return f"concat(unix_millis(CAST({c} AS TIMESTAMP)), 'i')"
        return f"concat({c}, 'i')" if kinds[c] in ("bigint", "int", "smallint", "tinyint") else f"CAST({c} AS STRING)"

    head = ", ".join([f"'{measurement}'", *(f"',{t}=', {_tag(t)}" for t in tags)])
    body = ", ',', ".join(f"'{f}=', {value(f)}" for f in fields)
    return df.selectExpr(f"concat({head}, ' ', {body}, ' ', CAST({time} AS STRING)) AS line")


def write(lines_: DataFrame, url: str, db: str, token: str = "", precision: str = "ms", post=None) -> None:
    """Sends the lines from the executors, LINES a request. Points of one key and time replace each other, so a repeated task does no harm."""

    def send(body: bytes) -> None:
        query = urllib.parse.urlencode({"db": db, "precision": precision})
        request = urllib.request.Request(f"{url}/api/v3/write_lp?{query}", data=body, headers={"Authorization": f"Bearer {token}"})
        urllib.request.urlopen(request, timeout=60).close()

    ask = post or send

    def part(rows) -> None:
        batch: list[str] = []
        for r in rows:
            batch.append(r["line"])
            if len(batch) == LINES:
                ask("\n".join(batch).encode())
                batch = []
        if batch:
            ask("\n".join(batch).encode())

    lines_.foreachPartition(part)
