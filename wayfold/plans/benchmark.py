"""The moving-object benchmark queries, and a query for each function, with their oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import macros as g
from wayfold.operators.proximity import ON as ON_SEGMENT
from wayfold.operators.proximity import SMALL, at_spots, ids_at, lines_at_spots, segments_of, sighted_at, spots_of, tdwithin_pairs
from wayfold.plans import crop as crops
from wayfold.plans import dataset as d

QUERIES, ORACLES = {}, {}


def _renamed(sql: str) -> str:
    """DuckDB takes no column called by."""
    return re.sub(r"\bby\b", "b_y", sql)


def _sql(name: str, text: str, oracle: str) -> None:
    """A query over the dataset's views; the oracle continues the dataset's WITH list or its last SELECT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d.functions(spark)
        d.views(spark, sf_dir)
        return spark.sql(text)

    QUERIES[name], ORACLES[name] = run, _renamed(d.ORACLE + oracle)


def _frame(name: str, make, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d.functions(spark)
        return make(spark, sf_dir)

    QUERIES[name], ORACLES[name] = run, _renamed(d.ORACLE + oracle)


A, B = 1704672000000, 1705276800000  # 2024-01-08 and 2024-01-15
TS_A, TS_B = "TIMESTAMP_NTZ'2024-01-08 00:00:00'", "TIMESTAMP_NTZ'2024-01-15 00:00:00'"

# functions over time spans
for _name, _call, _test in (
    ("contains", f"traj_contains(t, {TS_A}, TIMESTAMP_NTZ'2024-01-09 00:00:00')", f"f < {A} AND l > {A + 86400000}"),
    ("during", f"during(t, {TS_A}, {TS_B})", f"f > {A} AND l < {B}"),
    ("present", f"present(t, TIMESTAMP_NTZ'2024-01-10 12:00:00')", f"f <= {A + 216000000} AND l >= {A + 216000000}"),
    ("overlaps", f"overlaps(t, {A}, {B})", f"f < {A} AND {A} < l AND l < {B}"),
    ("overlapped_by", f"overlapped_by(t, {A}, {B})", f"{A} < f AND f < {B} AND l > {B}"),
    ("precedes", f"precedes(t, {A})", f"l < {A}"),
    ("preceded_by", f"preceded_by(t, {A})", f"{A} < f"),
    ("equal", "equal(t, CAST(tmin AS BIGINT), CAST(tmax AS BIGINT) + trip_id % 2)", "trip_id % 2 = 0"),
    ("starts", f"starts(t, CAST(tmin AS BIGINT) + trip_id % 2, CAST(tmax AS BIGINT) + 5)", "trip_id % 2 = 0"),
    ("started_by", f"started_by(t, CAST(tmin AS BIGINT), greatest(CAST(tmin AS BIGINT), {A}))", f"l > greatest(f, {A})"),
    ("finishes", "finishes(t, CAST(tmin AS BIGINT) - trip_id % 2, CAST(tmax AS BIGINT))", "trip_id % 2 = 1"),
    ("finished_by", f"finished_by(t, least({A}, CAST(tmax AS BIGINT)), CAST(tmax AS BIGINT))", f"f < least({A}, l)"),
    ("meets", "meets(t, CAST(tmax AS BIGINT) + trip_id % 3)", "trip_id % 3 = 0"),
    ("met_by", "met_by(t, CAST(tmin AS BIGINT) + trip_id % 3)", "trip_id % 3 = 0"),
):
    _sql(f"fn_{_name}", f"SELECT trip_id, {_call} AS v FROM trips", f"SELECT trip_id, {_test} AS v FROM tr")
_sql("fn_duration", "SELECT trip_id, duration(t) AS v, duration(t) > 3600000 AS long FROM trips", "SELECT trip_id, l - f AS v, l - f > 3600000 AS long FROM tr")
_sql("fn_array_length", "SELECT trip_id, array_length(t) AS v FROM trips", "SELECT trip_id, n::INT AS v FROM tr")
_sql("fn_st_length", "SELECT trip_id, round(st_length(t), 6) AS v FROM trips", "SELECT trip_id, round(sum(sqrt((bx - ax) ** 2 + (by - ay) ** 2)), 6) AS v FROM s GROUP BY trip_id")

# positions and slices
_POSITIONS = "SELECT trip_id, instant_id, round({c}.x, 6) AS x, round({c}.y, 6) AS y FROM (SELECT trip_id, instant_id, {call} AS {c} FROM trips JOIN instants1 ON tmin <= {ms} AND tmax >= {ms})"
_sql("fn_point_at_timestamp", _POSITIONS.format(c="p", call="point_at_timestamp(t, instant)", ms=g.millis("instant")), "SELECT trip_id, instant_id, round(x, 6) AS x, round(y, 6) AS y FROM sight")
_sql("fn_subpolyline_at", _POSITIONS.format(c="p", call="subpolyline_at(t, instant)[0]", ms=g.millis("instant")), "SELECT trip_id, instant_id, round(x, 6) AS x, round(y, 6) AS y FROM sight")
_sql(
    "fn_subpolyline_between",
    "SELECT trip_id, period_id, size(c) AS n, CAST(c[0].m AS BIGINT) AS a, CAST(element_at(c, -1).m AS BIGINT) AS b, round(c[0].x, 6) AS x FROM (SELECT trip_id, period_id, subpolyline_between(t, start_period, end_period) AS c FROM trips CROSS JOIN periods1) WHERE size(c) > 0",
    "SELECT trip_id, period_id, (count(*) + (max(cb) > min(ca) OR max(t1) > max(t0))::INT)::INT AS n, min(ca) AS a, max(cb) AS b, round(arg_min(ax, ca), 6) AS x FROM clip WHERE cb > ca OR t0 = t1 GROUP BY ALL "
    "UNION ALL SELECT v.trip_id, p.period_id, 1, v.m, v.m, round(v.x, 6) FROM v JOIN periods1 p ON v.m = p.pb WHERE v.i = 1 AND v.n > 1",
)

# regions: vertices by even-odd crossings, lines by their segments
PIP = """
, side AS (SELECT v.trip_id, v.i, v.n, e.polygon_id, v.x, v.y,
  sum(CASE WHEN (e.ay > v.y) <> (e.by > v.y) AND v.x < (e.bx - e.ax) * (v.y - e.ay) / CASE WHEN e.by = e.ay THEN 1 ELSE e.by - e.ay END + e.ax THEN 1 ELSE 0 END) % 2 = 1 AS odd,
  bool_or((e.bx - e.ax) * (v.y - e.ay) = (e.by - e.ay) * (v.x - e.ax) AND v.x BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND v.y BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by)) AS edge
  FROM v CROSS JOIN e GROUP BY ALL),
inn AS (SELECT *, odd AND NOT edge AS interior, odd OR edge AS covered FROM side),
cut AS (SELECT DISTINCT s.trip_id, e.polygon_id FROM s JOIN e ON least(s.ax, s.bx) <= greatest(e.ax, e.bx) AND least(e.ax, e.bx) <= greatest(s.ax, s.bx) AND least(s.ay, s.by) <= greatest(e.ay, e.by) AND least(e.ay, e.by) <= greatest(s.ay, s.by)
  AND sign((e.bx - e.ax) * (s.ay - e.ay) - (e.by - e.ay) * (s.ax - e.ax)) * sign((e.bx - e.ax) * (s.by - e.ay) - (e.by - e.ay) * (s.bx - e.ax)) <= 0
  AND sign((s.bx - s.ax) * (e.ay - s.ay) - (s.by - s.ay) * (e.ax - s.ax)) * sign((s.bx - s.ax) * (e.by - s.ay) - (s.by - s.ay) * (e.bx - s.ax)) <= 0),
touch AS (SELECT trip_id, polygon_id FROM cut UNION SELECT trip_id, polygon_id FROM inn WHERE covered)
"""
_BOX = "xmin <= pxmax AND xmax >= pxmin AND ymin <= pymax AND ymax >= pymin"
_REGION = "SELECT trip_id, polygon_id FROM trips JOIN regions ON {box} WHERE {call}"
for _name, _call, _oracle in (
    ("properly_contained", "properly_contained(t, polygon)", "SELECT trip_id, polygon_id FROM inn GROUP BY ALL HAVING bool_and(interior)"),
    ("leaves", "leaves(t, polygon)", "SELECT trip_id, polygon_id FROM inn GROUP BY ALL HAVING bool_or(i = 1 AND interior) AND NOT bool_or(i = n AND interior)"),
    ("leaves_and_returns", "leaves_and_returns(t, polygon)", "SELECT trip_id, polygon_id FROM inn GROUP BY ALL HAVING bool_or(i = 1 AND interior) AND bool_or(i = n AND interior) AND NOT bool_and(interior)"),
    ("crosses_strict", "crosses(t, 'strict', polygon)", "SELECT trip_id, polygon_id FROM inn GROUP BY ALL HAVING NOT bool_or(i IN (1, n) AND covered) AND bool_or(covered)"),
    ("crosses_relaxed", "crosses(t, 'relaxed', polygon)", "SELECT trip_id, polygon_id FROM inn SEMI JOIN touch USING (trip_id, polygon_id) GROUP BY ALL HAVING NOT bool_or(i IN (1, n) AND covered)"),
    ("contained_relaxed", "contained(t, 'relaxed', polygon)", "SELECT trip_id, polygon_id FROM touch"),
    ("st_intersects", "st_intersects(t, polygon)", "SELECT trip_id, polygon_id FROM touch"),
):
    _sql(f"fn_{_name}", _REGION.format(box=_BOX, call=_call), PIP + _oracle)
# strictly contained, for the regions that are convex: all vertices covered, one vertex or middle inside
_sql(
    "fn_contained_strict", _REGION.format(box=_BOX, call="polygon_id IN (1, 2, 5) AND contained(t, 'strict', polygon)"),
    PIP + ", box(polygon_id, xa, xb, ya, yb) AS (VALUES (1, 13.1::DOUBLE, 13.4::DOUBLE, 52.1::DOUBLE, 52.4::DOUBLE), (2, 13.5::DOUBLE, 13.75::DOUBLE, 52.5::DOUBLE, 52.75::DOUBLE), (5, 13.90625::DOUBLE, 13.984375::DOUBLE, 52.90625::DOUBLE, 52.984375::DOUBLE)) "
    "SELECT s.trip_id, polygon_id FROM s CROSS JOIN box GROUP BY ALL HAVING bool_and(least(ax, bx) >= xa AND greatest(ax, bx) <= xb AND least(ay, by) >= ya AND greatest(ay, by) <= yb) AND bool_or((ax + bx) / 2 > xa AND (ax + bx) / 2 < xb AND (ay + by) / 2 > ya AND (ay + by) / 2 < yb)",
)
_sql("fn_st_contained", f"SELECT trip_id, polygon_id FROM trips JOIN regions ON {_BOX} WHERE st_contained(t, polygon, {A}, {B})", PIP + f"SELECT trip_id, polygon_id FROM touch JOIN tr USING (trip_id) WHERE polygon_id <> 4 AND f <= {B} AND l >= {A} UNION ALL SELECT trip_id, 4 FROM tr WHERE f <= {B} AND l >= {A}")
_sql("fn_st_contains", "SELECT point_id, polygon_id FROM points JOIN regions ON st_contains(polygon, point)", """
, sd AS (SELECT point_id, polygon_id, sum(CASE WHEN (ay > py) <> (by > py) AND px < (bx - ax) * (py - ay) / CASE WHEN by = ay THEN 1 ELSE by - ay END + ax THEN 1 ELSE 0 END) % 2 = 1 AS odd,
 bool_or((bx - ax) * (py - ay) = (by - ay) * (px - ax) AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by) AND greatest(ay, by)) AS edge FROM points CROSS JOIN e GROUP BY ALL)
SELECT point_id, polygon_id FROM sd WHERE odd AND NOT edge""")  # fmt: skip

# points on lines
ON = "(q.px BETWEEN least(s.ax, s.bx) AND greatest(s.ax, s.bx) AND q.py BETWEEN least(s.ay, s.by) AND greatest(s.ay, s.by) AND (s.bx - s.ax) * (q.py - s.ay) = (s.by - s.ay) * (q.px - s.ax))"
D2 = "CASE WHEN s.ax = s.bx AND s.ay = s.by THEN (q.px - s.ax) ** 2 + (q.py - s.ay) ** 2 ELSE (q.px - s.ax - u * (s.bx - s.ax)) ** 2 + (q.py - s.ay - u * (s.by - s.ay)) ** 2 END"
NEAR = (
    ", along AS (SELECT s.*, q.point_id, q.px, q.py, CASE WHEN s.ax = s.bx AND s.ay = s.by THEN 0 ELSE greatest(0, least(1, ((q.px - s.ax) * (s.bx - s.ax) + (q.py - s.ay) * (s.by - s.ay)) / ((s.bx - s.ax) ** 2 + (s.by - s.ay) ** 2))) END AS u FROM s CROSS JOIN points1 q),"
    f" far AS (SELECT s.trip_id, s.point_id, min({D2.replace('q.', 's.')}) AS d2 FROM along s GROUP BY ALL) "
)
_sql("fn_passes_point", "SELECT trip_id, point_id FROM trips JOIN points1 ON passes_point(t, point, 500)", NEAR + f"SELECT trip_id, point_id FROM far WHERE d2 <= ({500 / g.METRES_PER_DEGREE!r}::DOUBLE) ** 2")
_sql("fn_timestamp_at_position", "SELECT trip_id, point_id, unix_millis(CAST(w AS TIMESTAMP)) AS ms FROM (SELECT trip_id, point_id, timestamp_at_position(t, point) AS w FROM trips CROSS JOIN points1) WHERE w IS NOT NULL", f"""
SELECT s.trip_id, q.point_id, arg_min(CASE WHEN s.ax = q.px AND s.ay = q.py THEN s.t0 WHEN s.bx = q.px AND s.by = q.py THEN s.t1
  ELSE round(s.t0 + (s.t1 - s.t0) * sqrt(((q.px - s.ax) ** 2 + (q.py - s.ay) ** 2) / ((s.bx - s.ax) ** 2 + (s.by - s.ay) ** 2)))::BIGINT END, s.t0)::BIGINT AS ms
FROM s JOIN points1 q ON s.n > 1 AND {ON} GROUP BY ALL""")  # fmt: skip

# pairs of lines: each vehicle's trip and the next vehicle's of the same days, over all trips
_PAIRS = "FROM (SELECT trip_id AS a, t FROM trips) JOIN (SELECT trip_id AS b, t AS u FROM trips) ON b = a + 100000"
_OPAIRS = "FROM s p JOIN s q ON q.trip_id = p.trip_id + 100000"


def _c(s: str, x: str, y: str) -> str:
    return f"(({s}.bx - {s}.ax) * ({y} - {s}.ay) - ({s}.by - {s}.ay) * ({x} - {s}.ax))"


MEET = (
    "(least(p.ax, p.bx) <= greatest(q.ax, q.bx) AND least(q.ax, q.bx) <= greatest(p.ax, p.bx) AND least(p.ay, p.by) <= greatest(q.ay, q.by) AND least(q.ay, q.by) <= greatest(p.ay, p.by)"
    f" AND sign({_c('q', 'p.ax', 'p.ay')}) * sign({_c('q', 'p.bx', 'p.by')}) <= 0 AND sign({_c('p', 'q.ax', 'q.ay')}) * sign({_c('p', 'q.bx', 'q.by')}) <= 0)"
)


def _d(s: str, x: str, y: str) -> str:
    u = f"CASE WHEN {s}.ax = {s}.bx AND {s}.ay = {s}.by THEN 0 ELSE greatest(0, least(1, (({x} - {s}.ax) * ({s}.bx - {s}.ax) + ({y} - {s}.ay) * ({s}.by - {s}.ay)) / (({s}.bx - {s}.ax) ** 2 + ({s}.by - {s}.ay) ** 2))) END"
    return f"(({x} - {s}.ax - ({u}) * ({s}.bx - {s}.ax)) ** 2 + ({y} - {s}.ay - ({u}) * ({s}.by - {s}.ay)) ** 2)"


GAP = f"CASE WHEN {MEET} THEN 0 ELSE sqrt(least({_d('p', 'q.ax', 'q.ay')}, {_d('p', 'q.bx', 'q.by')}, {_d('q', 'p.ax', 'p.ay')}, {_d('q', 'p.bx', 'p.by')})) END"
_sql("fn_st_distance", f"SELECT a, b, round(st_distance(t, u), 6) AS v {_PAIRS}", f"SELECT p.trip_id AS a, q.trip_id AS b, round(min({GAP}), 6) AS v {_OPAIRS} GROUP BY ALL")
_WKT2 = "POLYGON((13.1 52.1,13.9 52.1,13.9 52.9,13.1 52.9,13.1 52.1))"
_sql("fn_polylines_intersect_in_polygon", f"SELECT a, b, polylines_intersect_in_polygon(t, u, polygon_from_text('{_WKT2}')) AS v {_PAIRS}", f"""
, hit AS (SELECT p.trip_id AS a, q.trip_id AS b, {MEET} AS meets, p.ax AS x, p.ay AS y, p.bx - p.ax AS dx, p.by - p.ay AS dy, ((q.ax - p.ax) * (q.by - q.ay) - (q.ay - p.ay) * (q.bx - q.ax)) AS num, ((p.bx - p.ax) * (q.by - q.ay) - (p.by - p.ay) * (q.bx - q.ax)) AS den {_OPAIRS})
SELECT a, b, bool_or(coalesce(meets AND den <> 0 AND x + num / CASE WHEN den = 0 THEN 1 ELSE den END * dx > 13.1 AND x + num / CASE WHEN den = 0 THEN 1 ELSE den END * dx < 13.9 AND y + num / CASE WHEN den = 0 THEN 1 ELSE den END * dy > 52.1 AND y + num / CASE WHEN den = 0 THEN 1 ELSE den END * dy < 52.9, false)) AS v FROM hit GROUP BY ALL""")  # fmt: skip
_VPAIRS = "FROM v p JOIN v q ON q.trip_id = p.trip_id + 100000 GROUP BY ALL"
for _p, _b in (("hour", "{}.m // 3600000"), ("day", "{}.m // 86400000"), ("year", "year(make_timestamp({}.m * 1000))")):
    _sql(f"fn_tdwithin_{_p}", f"SELECT a, b, tdwithin(t, u, 20000, '{_p}') AS v {_PAIRS}", f"SELECT p.trip_id AS a, q.trip_id AS b, bool_or({_b.format('p')} = {_b.format('q')} AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= {20000 / g.METRES_PER_DEGREE!r}::DOUBLE) AS v {_VPAIRS}")

# codecs
_sql("fn_wkb_round_trip", "SELECT trip_id, size(r) AS n, r = t AS same, hex(substring(b, 1, 9)) AS head, octet_length(b) AS bytes FROM (SELECT trip_id, t, b, wkb_to_trajectory(b) AS r FROM (SELECT trip_id, t, trajectory_to_wkb(t) AS b FROM trips))", "SELECT trip_id, n::INT AS n, true AS same, '0102000060E6100000' AS head, (13 + 24 * n)::INT AS bytes FROM tr")
_sql("fn_trajectory_from_text", "SELECT trip_id, size(r) AS n, r = t AS same FROM (SELECT trip_id, t, trajectory_from_text(concat('LINESTRING M(', array_join(transform(t, p -> concat_ws(' ', p.x, p.y, CAST(p.m AS BIGINT))), ', '), ')')) AS r FROM trips)", "SELECT trip_id, n::INT AS n, true AS same FROM tr")


# crop
def _crop(name: str, expression: str, keep: str) -> None:
    """Pieces and vertices kept; keep says in SQL which vertices stay. A piece is a run of kept vertices for regions, an interval's side for times."""
    text = crops.compile_crop("t", expression)
    _sql(f"crop_{name}", f"SELECT trip_id, size(c) AS pieces, size(flatten(c)) AS vertices, CAST(aggregate(flatten(c), 0D, (a, p) -> a + p.m) AS BIGINT) AS total FROM (SELECT trip_id, {text} AS c FROM trips)", keep)


_KEPT = "SELECT trip_id, {pieces}::INT AS pieces, count(*) FILTER ({k})::INT AS vertices, coalesce(sum(m) FILTER ({k}), 0)::BIGINT AS total FROM {source} GROUP BY trip_id"
_ANY = "(count(*) FILTER ({k}) > 0)::INT"
for _name, _expr, _k in (
    ("during", f"during('{A}', '{B}')", f"m BETWEEN {A} AND {B}"),
    ("follows", f"follows('{A}')", f"m > {A}"),
    ("precedes", f"precedes('{A}')", f"m < {A}"),
    ("and", f"follows('{A}') AND precedes('{B}')", f"m > {A} AND m < {B}"),
):
    _crop(_name, _expr, _KEPT.format(pieces=_ANY.format(k=_k), k=_k, source="v"))
_crop("not_during", f"not_during('{A}', '{B}')", _KEPT.format(pieces=f"((count(*) FILTER (m < {A}) > 0)::INT + (count(*) FILTER (m > {B}) > 0)::INT)", k=f"m < {A} OR m > {B}", source="v"))
_crop("or", f"precedes('{A}') OR (during('{A}', '{B}') OR follows('{B}'))", _KEPT.format(pieces=f"((count(*) FILTER (m < {A}) > 0)::INT + (count(*) FILTER (m BETWEEN {A} AND {B}) > 0)::INT + (count(*) FILTER (m > {B}) > 0)::INT)", k="true", source="v"))
_RUNS = PIP + ", runs AS (SELECT r.trip_id, v.m, r.k, lag(r.k) OVER (PARTITION BY r.trip_id ORDER BY v.m) AS before FROM (SELECT trip_id, i, {k} AS k FROM inn WHERE polygon_id = 3) r JOIN v ON v.trip_id = r.trip_id AND v.i = r.i) " + _KEPT.format(pieces="count(*) FILTER (k AND (before IS NULL OR NOT before))", k="k", source="runs")
_crop("contained", f"contained('{d.REGIONS[2][1]}')", _RUNS.format(k="interior"))
_crop("not_contained", f"not_contained('{d.REGIONS[2][1]}')", _RUNS.format(k="NOT interior"))

# benchmark queries
_sql("q1", "SELECT DISTINCT l.licence, c.model FROM datamcar c JOIN licences l ON c.licence = l.licence", "SELECT DISTINCT l.licence, c.model FROM datamcar c JOIN licences l ON c.licence = l.licence")
_sql("q2", "SELECT count(licence) AS n FROM datamcar WHERE type = 'passenger'", "SELECT count(licence) AS n FROM datamcar WHERE type = 'passenger'")
_sql(
    "q3",
    "SELECT DISTINCT licence, instant_id, round(p.x, 6) AS x, round(p.y, 6) AS y FROM (SELECT l.licence, i.instant_id, point_at_timestamp(t.t, i.instant) AS p FROM trips t JOIN licences1 l ON t.moid = l.moid JOIN instants1 i ON present(t.t, i.instant)) ORDER BY licence, instant_id",
    "SELECT DISTINCT licence, instant_id, round(x, 6) AS x, round(y, 6) AS y FROM sight JOIN licences1 USING (moid)",
)
_sql("q4", "SELECT DISTINCT p.point_id, c.licence FROM trips t JOIN datamcar c ON t.moid = c.moid JOIN points1 p ON p.point.x BETWEEN t.xmin AND t.xmax AND p.point.y BETWEEN t.ymin AND t.ymax AND passes_point(t.t, p.point, 0)", f"SELECT DISTINCT q.point_id, c.licence FROM s JOIN points1 q ON {ON} JOIN datamcar c USING (moid)")


def _q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the sampled vehicles' events become trips, and the pairs of trips, not the trips, are dealt to the tasks."""
    plates = d.licences(spark, sf_dir)
    one, two = d.sample(plates, "licence_id"), d.sample(plates, "licence_id", 10)
    a, b = (d.trips(spark, sf_dir, ls).join(F.broadcast(ls.select("moid", F.col("licence").alias(f"licence{k}"))), "moid").select(f"licence{k}", F.col("trip_id").alias(f"trip{k}"), F.col("t").alias(f"t{k}")) for k, ls in ((1, one), (2, two)))
    pairs = a.join(F.broadcast(b), F.col("licence1") < F.col("licence2")).repartition("trip1", "trip2")
    return pairs.groupBy("licence1", "licence2").agg(F.expr("round(min(st_distance(t1, t2)), 6)").alias("distance"))


_frame(
    "q5",
    _q5,
    f", p AS (SELECT s.*, licence FROM s JOIN licences1 USING (moid)), q AS (SELECT s.*, licence FROM s JOIN licences2 USING (moid)) SELECT p.licence AS licence1, q.licence AS licence2, round(min({GAP}), 6) AS distance FROM p JOIN q ON p.licence < q.licence GROUP BY ALL",
)


def _meetings(spark: SparkSession, sf_dir: str, metres: float, precision: str, left, right, condition: str | None) -> DataFrame:
    t = d.trips(spark, sf_dir)
    c = d.cars(spark, sf_dir)
    a = t.join(left(c), "moid").select(F.col("licence").alias("licence1"), "t")
    b = t.join(right(c), "moid").select(F.col("licence").alias("licence2"), "t")
    return tdwithin_pairs(a, b, metres, precision, "licence1", "licence2", same=condition)


_NEAR = "SELECT DISTINCT {a}.licence AS licence1, {b}.licence AS licence2 FROM v p JOIN datamcar c1 ON p.moid = c1.moid JOIN v q ON {bucket} JOIN datamcar c2 ON q.moid = c2.moid WHERE {where} AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= {reach!r}::DOUBLE"
_frame("q6", lambda spark, sf: _meetings(spark, sf, 10_000, "minute", lambda c: c.where("type = 'truck'"), lambda c: c.where("type = 'truck'"), "licence1 < licence2"), _NEAR.format(a="c1", b="c2", bucket="p.m // 60000 = q.m // 60000", where="c1.type = 'truck' AND c2.type = 'truck' AND c1.licence < c2.licence", reach=10_000 / g.METRES_PER_DEGREE))


def _q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vehicles at each spot, then the points that lie there. The time is timestamp_at_position's, by segment: the earliest is the line's first."""
    c = d.cars(spark, sf_dir).where("type = 'passenger'").select("moid", "licence")
    trips, points = d.trips(spark, sf_dir).where("size(t) > 1").join(c, "moid").select("licence", "t"), d.points(spark, sf_dir)
    spots = spots_of(points)
    part = "sqrt((power(qx - ax, 2) + power(qy - ay, 2)) / (power(bx - ax, 2) + power(by - ay, 2)))"
    when = f"CASE WHEN ax = qx AND ay = qy THEN am WHEN bx = qx AND by = qy THEN bm ELSE round((1 - {part}) * am + {part} * bm) END"
    met = at_spots(segments_of(trips, ["licence"]), spots).where(ON_SEGMENT).selectExpr("licence", "qx", "qy", f"CAST({when} AS BIGINT) AS ms")
    hits = met.groupBy("licence", "qx", "qy").agg(F.min("ms").alias("ms"))
    least = hits.groupBy("qx", "qy").agg(F.min("ms").alias("least"))
    first = hits.join(F.broadcast(least) if spots.n <= SMALL else least, ["qx", "qy"]).where("ms = least")
    return first.join(ids_at(points, "point_id", spots), ["qx", "qy"]).select("licence", F.explode("ids").alias("point_id"), "ms")


_frame(
    "q7",
    _q7,
    f""", seen AS (SELECT c.licence, q.point_id, CASE WHEN s.ax = q.px AND s.ay = q.py THEN s.t0 WHEN s.bx = q.px AND s.by = q.py THEN s.t1 ELSE round(s.t0 + (s.t1 - s.t0) * sqrt(((q.px - s.ax) ** 2 + (q.py - s.ay) ** 2) / ((s.bx - s.ax) ** 2 + (s.by - s.ay) ** 2)))::BIGINT END AS ms
FROM s JOIN points q ON s.n > 1 AND {ON} JOIN datamcar c ON s.moid = c.moid AND c.type = 'passenger'), h AS (SELECT licence, point_id, min(ms) AS ms FROM seen GROUP BY ALL)
SELECT licence, point_id, ms::BIGINT AS ms FROM h QUALIFY ms = min(ms) OVER (PARTITION BY point_id)""",
)
_LENGTHS = "SELECT t.moid, p.period_id, subpolyline_between(t.t, p.start_period, p.end_period) AS c FROM trips t JOIN {joined} periods1 p ON t.tmin <= unix_millis(CAST(p.end_period AS TIMESTAMP)) AND t.tmax >= unix_millis(CAST(p.start_period AS TIMESTAMP))"
_sql(
    "q8",
    "SELECT l.licence, k.period_id, round(sum(st_length(k.c)), 6) AS distance FROM (" + _LENGTHS.format(joined="") + ") k JOIN licences1 l ON k.moid = l.moid WHERE array_length(k.c) > 0 GROUP BY l.licence, k.period_id",
    "SELECT licence, period_id, round(sum(sqrt((bx - ax) ** 2 + (by - ay) ** 2)), 6) AS distance FROM (SELECT * FROM clip WHERE cb > ca OR t0 = t1 UNION ALL SELECT v.trip_id, v.moid, p.period_id, v.m, v.m, v.m, v.m, v.x, v.y, v.x, v.y FROM v JOIN periods1 p ON v.m = p.pb WHERE v.i = 1 AND v.n > 1) JOIN licences1 USING (moid) GROUP BY ALL",
)
_sql(
    "q9",
    "SELECT period_id, max(distance) AS longest FROM (SELECT moid, period_id, round(sum(st_length(c)), 6) AS distance FROM (" + _LENGTHS.format(joined="") + ") WHERE array_length(c) > 0 GROUP BY moid, period_id) GROUP BY period_id",
    "SELECT period_id, max(distance) AS longest FROM (SELECT moid, period_id, round(sum(sqrt((bx - ax) ** 2 + (by - ay) ** 2)), 6) AS distance FROM clip WHERE cb > ca OR t0 = t1 GROUP BY ALL) GROUP BY period_id",
)
_frame("q10", lambda spark, sf: _meetings(spark, sf, 3_000, "hour", lambda c: c.join(F.broadcast(d.sample(d.licences(spark, sf), "licence_id").select("licence")), "licence"), lambda c: c, "licence1 <> licence2"), _NEAR.format(a="l", b="c2", bucket="p.m // 3600000 = q.m // 3600000", where="c1.licence <> c2.licence", reach=3_000 / g.METRES_PER_DEGREE).replace("JOIN v q", "JOIN licences1 l ON l.licence = c1.licence JOIN v q"))
# the same, farther and longer apart: it has rows at every scale
_frame("q10_wide", lambda spark, sf: _meetings(spark, sf, 20_000, "day", lambda c: c.join(F.broadcast(d.sample(d.licences(spark, sf), "licence_id").select("licence")), "licence"), lambda c: c, "licence1 <> licence2"), _NEAR.format(a="l", b="c2", bucket="p.m // 86400000 = q.m // 86400000", where="c1.licence <> c2.licence", reach=20_000 / g.METRES_PER_DEGREE).replace("JOIN v q", "JOIN licences1 l ON l.licence = c1.licence JOIN v q"))


def _sightings(spark: SparkSession, sf_dir: str, named) -> DataFrame:
    """(licence, point_id, instant_id): vehicles that are at a point at an instant, by spots and moments. ``named`` makes rows of the sightings (licence, qx, qy, im), which get the ids."""
    points, instants = d.points(spark, sf_dir), d.instants(spark, sf_dir)
    at = instants.select("instant_id", F.expr(f"CAST({g.millis('instant')} AS DOUBLE)").alias("im"))
    r = at.where("im IS NOT NULL").agg(F.countDistinct("im").alias("moments"), F.countDistinct(F.struct("instant_id")).alias("ids"), F.countDistinct(F.struct("instant_id", "im")).alias("times")).first()
    moments = r["moments"]
    spots = spots_of(points)
    own = points.groupBy("point_id").agg(F.countDistinct("point").alias("n")).agg(F.max("n").alias("most")).first()
    seen = sighted_at(d.trips(spark, sf_dir), spots, instants, "moid", moments)
    # one exchange serves the distinct rows and the pairs; a number keeps its parts from being put together by their size, since many rows come of few
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    k = named(seen.join(d.cars(spark, sf_dir).select("moid", "licence"), "moid").select("licence", "qx", "qy", "im").repartition(parts, "qx", "qy", "im").distinct())
    ids = at.groupBy("im").agg(F.collect_set("instant_id").alias("instants"))
    out = k.join(ids_at(points, "point_id", spots), ["qx", "qy"]).join(F.broadcast(ids) if moments <= SMALL else ids, "im")
    names = [c for c in k.columns if c.startswith("licence")]
    # a spot has more points than a moment has instants: the innermost loop is theirs
    out = out.select(*names, "ids", F.explode("instants").alias("instant_id")).select(*names, F.explode("ids").alias("point_id"), "instant_id")
    # an id of several positions or times may come with each of them
    return out.distinct() if r["times"] > r["ids"] or (own["most"] or 1) > 1 else out


def _pairs(k: DataFrame) -> DataFrame:
    a, b = (k.withColumnRenamed("licence", f"licence{i}") for i in (1, 2))
    return a.join(b, ["qx", "qy", "im"]).where("licence1 <= licence2")


_OAT = f""", place AS (SELECT s.moid, q.instant_id, CASE WHEN s.t0 = q.im THEN s.ax WHEN s.t1 = q.im THEN s.bx ELSE s.ax + (q.im - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.bx - s.ax) END AS x, CASE WHEN s.t0 = q.im THEN s.ay WHEN s.t1 = q.im THEN s.by ELSE s.ay + (q.im - s.t0)::DOUBLE / (s.t1 - s.t0) * (s.by - s.ay) END AS y FROM s JOIN instants q ON s.t0 <= q.im AND s.t1 >= q.im),
seen AS (SELECT DISTINCT moid, point_id, instant_id FROM place JOIN points ON x = px AND y = py) """
_frame("q11", lambda spark, sf: _sightings(spark, sf, lambda k: k), _OAT + "SELECT DISTINCT licence, point_id, instant_id FROM seen JOIN datamcar USING (moid)")
_frame("q12", lambda spark, sf: _sightings(spark, sf, _pairs), _OAT + ", k AS (SELECT DISTINCT licence, point_id, instant_id FROM seen JOIN datamcar USING (moid)) SELECT DISTINCT a.licence AS licence1, b.licence AS licence2, point_id, instant_id FROM k a JOIN k b USING (point_id, instant_id) WHERE a.licence <= b.licence")
_CUTS = PIP.replace("FROM v CROSS JOIN e", "FROM pv v CROSS JOIN e").replace("v.trip_id, v.i, v.n,", "v.moid, v.period_id,").replace("inn AS (", "inn AS (").split("cut AS")[0]
_CLIPPED = (
    ", cl AS (SELECT * FROM clip WHERE cb > ca OR t0 = t1 UNION ALL SELECT v.trip_id, v.moid, p.period_id, v.m, v.m, v.m, v.m, v.x, v.y, v.x, v.y FROM v JOIN periods1 p ON v.m = p.pb WHERE v.i = 1 AND v.n > 1), pv AS (SELECT DISTINCT moid, period_id, ax AS x, ay AS y FROM cl UNION SELECT DISTINCT moid, period_id, bx, by FROM cl) "
    + _CUTS
    + " cut AS (SELECT DISTINCT s.moid, s.period_id, e.polygon_id FROM cl s JOIN e ON least(s.ax, s.bx) <= greatest(e.ax, e.bx) AND least(e.ax, e.bx) <= greatest(s.ax, s.bx) AND least(s.ay, s.by) <= greatest(e.ay, e.by) AND least(e.ay, e.by) <= greatest(s.ay, s.by)"
    " AND sign((e.bx - e.ax) * (s.ay - e.ay) - (e.by - e.ay) * (s.ax - e.ax)) * sign((e.bx - e.ax) * (s.by - e.ay) - (e.by - e.ay) * (s.bx - e.ax)) <= 0 AND sign((s.bx - s.ax) * (e.ay - s.ay) - (s.by - s.ay) * (e.ax - s.ax)) * sign((s.bx - s.ax) * (e.by - s.ay) - (s.by - s.ay) * (e.bx - s.ax)) <= 0),"
    " touch AS (SELECT moid, period_id, polygon_id FROM cut UNION SELECT moid, period_id, polygon_id FROM inn WHERE covered) SELECT DISTINCT licence, period_id, polygon_id FROM touch JOIN datamcar USING (moid)"
)


def q13_over(trips: str) -> str:
    return (
        "SELECT DISTINCT c.licence, k.period_id, r.polygon_id FROM (SELECT t.moid, t.xmin, t.xmax, t.ymin, t.ymax, p.period_id, subpolyline_between(t.t, p.start_period, p.end_period) AS part "
        f"FROM {trips} t JOIN periods1 p ON t.tmin <= unix_millis(CAST(p.end_period AS TIMESTAMP)) AND t.tmax >= unix_millis(CAST(p.start_period AS TIMESTAMP))) k "
        f"JOIN regions1 r ON {_BOX} AND st_intersects(k.part, r.polygon) JOIN datamcar c ON k.moid = c.moid"
    )


_sql("q13", q13_over("trips"), _CLIPPED)
_sql("q14", f"SELECT DISTINCT c.licence, k.instant_id, r.polygon_id FROM (SELECT t.moid, i.instant_id, point_at_timestamp(t.t, i.instant) AS p FROM trips t JOIN instants1 i ON present(t.t, i.instant)) k JOIN regions1 r ON st_contains(r.polygon, k.p) JOIN datamcar c ON k.moid = c.moid", PIP.replace("FROM v CROSS JOIN e", "FROM sight v CROSS JOIN e").replace("v.trip_id, v.i, v.n,", "v.moid, v.instant_id,").split("cut AS")[0].rstrip().rstrip(",") + " SELECT DISTINCT licence, instant_id, polygon_id FROM inn JOIN datamcar USING (moid) WHERE interior")
_sql(
    "q15",
    "SELECT DISTINCT c.licence, k.period_id, p.point_id FROM (SELECT t.moid, p.period_id, subpolyline_between(t.t, p.start_period, p.end_period) AS part FROM trips t JOIN periods1 p ON t.tmin <= unix_millis(CAST(p.end_period AS TIMESTAMP)) AND t.tmax >= unix_millis(CAST(p.start_period AS TIMESTAMP))) k JOIN points1 p ON passes_point(k.part, p.point, 200) JOIN datamcar c ON k.moid = c.moid",
    f", cl AS (SELECT * FROM clip WHERE cb > ca OR t0 = t1 UNION ALL SELECT v.trip_id, v.moid, p.period_id, v.m, v.m, v.m, v.m, v.x, v.y, v.x, v.y FROM v JOIN periods1 p ON v.m = p.pb WHERE v.i = 1 AND v.n > 1) SELECT DISTINCT licence, p.period_id, q.point_id FROM cl p CROSS JOIN points1 q JOIN datamcar c ON c.moid = p.moid WHERE {_d('p', 'q.px', 'q.py')} <= ({200 / g.METRES_PER_DEGREE!r}::DOUBLE) ** 2",
)


def _q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d.views(spark, sf_dir)
    part = "SELECT l.licence AS licence{k}, p.period_id, r.polygon_id, t.trip_id AS trip{k}, subpolyline_between(t.t, p.start_period, p.end_period) AS part{k} FROM trips t JOIN licences{k} l ON t.moid = l.moid JOIN periods1 p ON t.tmin <= unix_millis(CAST(p.end_period AS TIMESTAMP)) AND t.tmax >= unix_millis(CAST(p.start_period AS TIMESTAMP)) JOIN regions1 r ON " + _BOX
    side = "SELECT * FROM (" + part + ") WHERE st_intersects(part{k}, polygon{k})"
    side = side.replace("r.polygon_id,", "r.polygon_id, r.polygon AS polygon{k},")
    return spark.sql(f"SELECT DISTINCT a.licence1, b.licence2, a.period_id, a.polygon_id FROM ({side.format(k=1)}) a JOIN ({side.format(k=2)}) b ON a.period_id = b.period_id AND a.polygon_id = b.polygon_id WHERE NOT tdwithin(a.part1, b.part2, 0, 'second')")


_frame("q16", _q16, _CLIPPED.split("SELECT DISTINCT licence, period_id")[0].replace("touch AS (", "touch0 AS (") + """
, per AS (SELECT DISTINCT trip_id, moid, period_id FROM cl),
tv AS (SELECT trip_id, moid, period_id, ca AS m, ax AS x, ay AS y FROM cl UNION SELECT trip_id, moid, period_id, cb, bx, by FROM cl),
tside AS (SELECT t.trip_id, t.moid, t.period_id, e.polygon_id, t.m, sum(CASE WHEN (e.ay > t.y) <> (e.by > t.y) AND t.x < (e.bx - e.ax) * (t.y - e.ay) / CASE WHEN e.by = e.ay THEN 1 ELSE e.by - e.ay END + e.ax THEN 1 ELSE 0 END) % 2 = 1 OR bool_or((e.bx - e.ax) * (t.y - e.ay) = (e.by - e.ay) * (t.x - e.ax) AND t.x BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND t.y BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by)) AS covered FROM tv t JOIN (SELECT moid FROM licences1 UNION SELECT moid FROM licences2) USING (moid) CROSS JOIN e GROUP BY ALL),
tcut AS (SELECT DISTINCT s.trip_id, s.moid, s.period_id, e.polygon_id FROM cl s JOIN e ON least(s.ax, s.bx) <= greatest(e.ax, e.bx) AND least(e.ax, e.bx) <= greatest(s.ax, s.bx) AND least(s.ay, s.by) <= greatest(e.ay, e.by) AND least(e.ay, e.by) <= greatest(s.ay, s.by)
 AND sign((e.bx - e.ax) * (s.ay - e.ay) - (e.by - e.ay) * (s.ax - e.ax)) * sign((e.bx - e.ax) * (s.by - e.ay) - (e.by - e.ay) * (s.bx - e.ax)) <= 0 AND sign((s.bx - s.ax) * (e.ay - s.ay) - (s.by - s.ay) * (e.ax - s.ax)) * sign((s.bx - s.ax) * (e.by - s.ay) - (s.by - s.ay) * (e.bx - s.ax)) <= 0),
tt AS (SELECT trip_id, moid, period_id, polygon_id FROM tcut UNION SELECT trip_id, moid, period_id, polygon_id FROM tside WHERE covered),
close AS (SELECT DISTINCT a.trip_id AS ta, b.trip_id AS tb, a.period_id FROM tv a JOIN tv b ON a.period_id = b.period_id AND a.m // 1000 = b.m // 1000 AND a.x = b.x AND a.y = b.y)
SELECT DISTINCT l1.licence AS licence1, l2.licence AS licence2, a.period_id, a.polygon_id FROM tt a JOIN licences1 l1 ON a.moid = l1.moid JOIN tt b ON a.period_id = b.period_id AND a.polygon_id = b.polygon_id JOIN licences2 l2 ON b.moid = l2.moid ANTI JOIN close ON ta = a.trip_id AND tb = b.trip_id AND close.period_id = a.period_id""")  # fmt: skip


def _q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles are counted once for each spot; its points all have that count."""
    points = d.points(spark, sf_dir)
    spots = spots_of(points)
    hits = lines_at_spots(d.trips(spark, sf_dir), spots, 0.0, "moid").groupBy("qx", "qy").agg(F.count("*").alias("hits"))
    most = hits.join(F.broadcast(hits.agg(F.max("hits").alias("most"))), F.col("hits") == F.col("most"))
    return most.join(ids_at(points, "point_id", spots), ["qx", "qy"]).select(F.explode("ids").alias("point_id"), "hits")


_frame("q17", _q17, f", h AS (SELECT q.point_id, count(DISTINCT s.moid) AS hits FROM s JOIN points q ON {ON} GROUP BY ALL) SELECT point_id, hits FROM h WHERE hits = (SELECT max(hits) FROM h)")
