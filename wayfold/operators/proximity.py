"""Set-oriented joins of trajectories: by vertices close in space within one time bucket, by points on their lines, and by points and instants together.

All turn a predicate over all pairs into an equi-join on grid cells (and time buckets): rows meet only if they share
a cell, and one hot bucket is spread over its cells. The exact predicate decides after the join.

Points of one position are one spot, instants of one time one moment: segments meet those, and ids come back when all is
decided. Up to SMALL spots or moments are broadcast, so that segments and their cells are never shuffled; more are joined by shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import macros as g

BUCKETS = {
    "second": "floor(v.m / 1000)",
    "minute": "floor(v.m / 60000)",
    "hour": "floor(v.m / 3600000)",
    "day": "floor(v.m / 86400000)",
    "year": "CAST(year(timestamp_millis(CAST(v.m AS BIGINT))) AS BIGINT)",
}
#: Different positions, or times, that are broadcast at most.
SMALL = 400_000
#: Time buckets in milliseconds, for short and for long windows.
FINE, COARSE = 1000, 6 * 3_600_000
#: Smallest cell side in degrees, for distances near zero.
LEAST_CELL = 1e-4


def tdwithin_pairs(left: DataFrame, right: DataFrame, metres: float, precision: str, left_id: str, right_id: str, t: str = "t", same: str | None = None) -> DataFrame:
    """Distinct (left_id, right_id) for which tdwithin(left.t, right.t, metres, precision) holds.

    ``same`` may give a further join condition on those two columns. Cells are one distance wide, so partners are in
    the same or a neighbouring cell; the right side is put into all nine.
    """
    if precision not in BUCKETS:
        raise ValueError(f"unknown precision: {precision}")
    reach = metres / g.METRES_PER_DEGREE
    side = max(reach, LEAST_CELL)
    bucket = BUCKETS[precision]
    cells = f"floor(v.x / {side!r}D) AS cx", f"floor(v.y / {side!r}D) AS cy"
    a = left.select(F.col(left_id), F.explode(t).alias("v")).selectExpr(left_id, f"{bucket} AS bucket", "v.x AS lx", "v.y AS ly", *cells)
    b = right.select(F.col(right_id), F.explode(t).alias("v")).selectExpr(right_id, f"{bucket} AS bucket", "v.x AS rx", "v.y AS ry", *cells)
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> named_struct('dx', i, 'dy', j)))))")
    b = b.select("*", around.alias("d")).selectExpr(right_id, "bucket", "rx", "ry", "cx + d.dx AS cx", "cy + d.dy AS cy")
    near = F.expr(f"sqrt(power(lx - rx, 2) + power(ly - ry, 2)) <= {reach!r}D")
    pairs = a.join(b, ["bucket", "cx", "cy"]).where(near)
    if same:
        pairs = pairs.where(same)
    return pairs.select(left_id, right_id).distinct()


@dataclass
class Spots:
    """Different positions (qx, qy) of points: how many, the cell side that gives each cell about one where they lie evenly, and what rounding may move a position."""

    table: DataFrame
    n: int
    cell: float
    slack: float


def spots_of(points: DataFrame, metres: float = 0.0, point: str = "point", cell: float | None = None) -> Spots:
    """The spots of points. Fewer cells make more pairs to test, more cells more entries for a segment; five numbers reach the driver."""
    table = points.selectExpr(f"{point}.x AS qx", f"{point}.y AS qy").where("qx is not null and qy is not null").distinct()
    far = F.max(F.greatest(F.abs("qx"), F.abs("qy")))
    r = table.agg(F.count("*").alias("n"), (F.max("qx") - F.min("qx")).alias("w"), (F.max("qy") - F.min("qy")).alias("h"), far.alias("far")).first()
    if cell is None:
        area = max(r["w"] or 0.0, LEAST_CELL) * max(r["h"] or 0.0, LEAST_CELL)
        cell = max((area / max(r["n"], 1)) ** 0.5, metres / g.METRES_PER_DEGREE, LEAST_CELL)
    return Spots(table, r["n"], cell, 1e-9 * max(1.0, r["far"] or 0.0))


def segments_of(lines: DataFrame, keep: list[str], t: str = "t", own_last: bool = False) -> DataFrame:
    """(keep, ax, ay, am, bx, by, bm, last) of every segment, a line of one vertex being one without length. With own_last the last vertex of every line is one more."""
    last = f"size({t}) - 1"
    starts = t if own_last else f"slice({t}, 1, greatest({last}, 1))"
    cells = f"transform({starts}, (v, i) -> named_struct('v', v, 'w', {t}[least(i + 1, {last})], 'last', i = {last}))"
    s = lines.select(*keep, F.explode(F.expr(cells)).alias("s"))
    return s.selectExpr(*keep, "s.v.x AS ax", "s.v.y AS ay", "s.v.m AS am", "s.w.x AS bx", "s.w.y AS by", "s.w.m AS bm", "s.last AS last")


#: Of a segment (ax, ay, bx, by) and a spot (qx, qy), without lambdas: those keep a join from being compiled.
CROSS = "((bx - ax) * (qy - ay) - (by - ay) * (qx - ax))"
LENGTH = "(power(bx - ax, 2) + power(by - ay, 2))"
ALONG = f"(((qx - ax) * (bx - ax) + (qy - ay) * (by - ay)) / {LENGTH})"
ON = g.on_segment("s", "qx", "qy").replace("s.", "")


def _near(reach: float) -> str:
    """macros.near_segment, the same arithmetic written out."""
    u = f"CASE WHEN {LENGTH} = 0D THEN 0D ELSE greatest(0D, least(1D, {ALONG})) END"
    return f"({ON} OR power(qx - ax - {u} * (bx - ax), 2) + power(qy - ay - {u} * (by - ay), 2) <= power({reach!r}D, 2))"


def at_spots(segments: DataFrame, spots: Spots, metres: float = 0.0) -> DataFrame:
    """segments, each with the (qx, qy) that it passes within the distance and the slack: all that do, and for an exact predicate few others.

    Each segment is put into the cells that it passes within the distance, column by column along the line; each spot
    into its own.
    """
    cell, slack = spots.cell, metres / g.METRES_PER_DEGREE + spots.slack
    at = lambda v: f"CAST(floor({v} / {cell!r}D) AS INT)"
    columns = segments.select("*", F.explode(F.expr(f"sequence({at(f'(least(ax, bx) - {slack!r}D)')}, {at(f'(greatest(ax, bx) + {slack!r}D)')})")).alias("cx"))
    # the part of the segment within the column, widened on both sides
    x = lambda edge: f"greatest(least(ax, bx), least(greatest(ax, bx), {edge}))"
    y = lambda v: f"CASE WHEN ax = bx THEN ay ELSE ay + ({v} - ax) / (bx - ax) * (by - ay) END"
    part = columns.selectExpr("*", f"{y(x(f'(cx * {cell!r}D - {slack!r}D)'))} AS y0", f"CASE WHEN ax = bx THEN by ELSE {y(x(f'((cx + 1) * {cell!r}D + {slack!r}D)'))} END AS y1")
    celled = part.select(*segments.columns, "cx", F.explode(F.expr(f"sequence({at(f'(least(y0, y1) - {slack!r}D)')}, {at(f'(greatest(y0, y1) + {slack!r}D)')})")).alias("cy"))
    own = spots.table.selectExpr("qx", "qy", f"{at('qx')} AS cx", f"{at('qy')} AS cy")
    own = F.broadcast(own) if spots.n <= SMALL else own
    box = f"qx >= least(ax, bx) - {slack!r}D AND qx <= greatest(ax, bx) + {slack!r}D AND qy >= least(ay, by) - {slack!r}D AND qy <= greatest(ay, by) + {slack!r}D"
    by_line = f"({LENGTH} <= power({slack!r}D, 2) OR power({CROSS}, 2) <= power({2 * slack!r}D, 2) * {LENGTH})"
    return celled.join(own, ["cx", "cy"]).where(f"{box} AND {by_line}").select(*segments.columns, "qx", "qy")


def ids_at(points: DataFrame, point_id: str, spots: Spots, point: str = "point") -> DataFrame:
    """(qx, qy, ids): the different ids of each spot, for ``with_ids``."""
    each = points.selectExpr(f"{point}.x AS qx", f"{point}.y AS qy", point_id).groupBy("qx", "qy").agg(F.collect_set(point_id).alias("ids"))
    return F.broadcast(each) if spots.n <= SMALL else each


def lines_at_points(lines: DataFrame, points: DataFrame, metres: float, line_id: str, point_id: str, t: str = "t", point: str = "point", cell: float | None = None) -> DataFrame:
    """Distinct (line_id, point_id) for which passes_point(line, point, metres) holds. Without a cell side given, it follows from the density of the points' positions (one aggregate over them)."""
    spots = spots_of(points, metres, point, cell)
    pairs = lines_at_spots(lines, spots, metres, line_id, t)
    return pairs.join(ids_at(points, point_id, spots, point), ["qx", "qy"]).select(line_id, F.explode("ids").alias(point_id)).distinct()


def lines_at_spots(lines: DataFrame, spots: Spots, metres: float, line_id: str, t: str = "t") -> DataFrame:
    """Distinct (line_id, qx, qy) of lines that pass a spot within the distance."""
    met = at_spots(segments_of(lines, [line_id], t), spots, metres)
    return met.where(_near(metres / g.METRES_PER_DEGREE)).select(line_id, "qx", "qy").distinct()


def sightings_at(lines: DataFrame, spots: Spots, instants: DataFrame, line_id: str, moments: int, t: str = "t", instant: str = "instant") -> DataFrame:
    """Distinct (line_id, qx, qy, im): lines whose point_at_timestamp at time im, that of some instant, is exactly a spot. ``moments`` tells how many different times there are."""
    return sighted_at(lines, spots, instants, line_id, moments, t, instant).distinct()


def sighted_at(lines: DataFrame, spots: Spots, instants: DataFrame, line_id: str, moments: int, t: str = "t", instant: str = "instant") -> DataFrame:
    """The same, but a row may be there again: lines of one id may meet.

    Each instant belongs to the segment that starts at or before it, the last vertex to one of its own. A segment meets
    the spots on it first; where along it one lies leaves a window of time, all of it for a segment without length, and
    only the moments in that window are tried.
    """
    met = at_spots(segments_of(lines, [line_id], t, own_last=True), spots)
    share = f"IF({LENGTH} = 0D, 1D, 4 * {spots.slack!r}D / sqrt({LENGTH}))"  # of the segment, on both sides
    low, high = (f"IF({LENGTH} = 0D, {end}, least(greatest(am + ({ALONG} {sign} {share}) * (bm - am), am), bm))" for end, sign in (("am", "-"), ("bm", "+")))
    windows = met.selectExpr("*", f"floor({low}) - 1 AS low", f"ceil({high}) + 1 AS high").selectExpr("*", f"IF(high - low <= {2 * FINE}, {FINE}, {COARSE}) AS width")
    windows = windows.select("*", F.explode(F.expr("sequence(CAST(floor(low / width) AS BIGINT), CAST(floor(high / width) AS BIGINT))")).alias("bucket"))
    q = instants.selectExpr(f"CAST({g.millis(instant)} AS DOUBLE) AS im").where("im is not null").distinct()
    q = q.select("im", F.explode(F.array(F.lit(FINE), F.lit(COARSE))).alias("width")).selectExpr("im", "width", "CAST(floor(im / width) AS BIGINT) AS bucket")
    q = F.broadcast(q) if moments <= SMALL else q
    both = windows.join(q, ["width", "bucket"]).where("im >= am AND IF(last, im = am, im < bm)")
    part = "IF(abs(bm - am) < 1e-6D, 0D, (im - am) / (bm - am))"
    exact = f"IF(im = am, ax, ax + {part} * (bx - ax)) = qx AND IF(im = am, ay, ay + {part} * (by - ay)) = qy"
    return both.where(exact).select(line_id, "qx", "qy", "im")
