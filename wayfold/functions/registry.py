"""The engine's SQL functions: one entry each with its body as SQL text, its documentation and how its arguments may be written.

``register`` creates them as temporary SQL functions, which Catalyst inlines, so predicates stay JVM-side expressions.
Codecs and map matching are Arrow functions (``codec``).

Conventions: ``t`` is a trajectory; null and empty trajectories give false or null as each entry says; instants are
TIMESTAMP_NTZ and compared in epoch milliseconds; interval ends given as BIGINT are in the unit of m.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wayfold.functions import macros as g
from wayfold.functions.types import POINT, POLYGON, TRAJECTORY

FIRST, LAST = "try_element_at(t, 1).m", "try_element_at(t, -1).m"
TS = "TIMESTAMP_NTZ"


@dataclass(frozen=True)
class Function:
    name: str
    category: str
    args: tuple[tuple[str, str], ...]
    returns: str
    body: str
    doc: str
    example: str = ""
    #: Name by which users call it, where the SQL name differs.
    alias: str = ""

    @property
    def shown(self) -> str:
        return self.alias or self.name

    @property
    def syntax(self) -> str:
        return f"{self.shown}({', '.join(a for a, _ in self.args)})"

    def kinds(self) -> list[tuple[int, str]]:
        """(place, kind) of the arguments that may also be given as WKT text or EWKB: T trajectory, P polygon, O point."""
        short = {TRAJECTORY: "T", POLYGON: "P", POINT: "O"}
        return [(i, short[t]) for i, (_, t) in enumerate(self.args) if t in short]


FUNCTIONS: dict[str, Function] = {}


def _add(name, category, args, returns, body, doc, example="", alias=""):
    FUNCTIONS[name] = Function(name, category, tuple(args), returns, body, doc, example, alias)


T = ("t", TRAJECTORY)


def _checked(condition: str) -> str:
    """An interval predicate: an end before the start is an error; null stays null, an empty trajectory is false."""
    return (
        "CASE WHEN b < a THEN CAST(raise_error('the interval ends before it starts') AS BOOLEAN) "
        f"WHEN t IS NULL THEN NULL WHEN size(t) = 0 THEN false ELSE {condition} END"
    )


def _plain(condition: str) -> str:
    return f"CASE WHEN t IS NULL THEN NULL WHEN size(t) = 0 THEN false ELSE {condition} END"


F_, L_ = f"CAST({FIRST} AS BIGINT)", f"CAST({LAST} AS BIGINT)"
_temporal = "temporal"

# instants: null and empty give false
for name, alias, condition, doc in (
    ("traj_contains", "contains", "{f} < {a} AND {l} > {b}", "Whether the trajectory starts before a and ends after b."),
    ("during", "", "{f} > {a} AND {l} < {b}", "Whether the trajectory starts after a and ends before b."),
):
    text = condition.format(f=FIRST, l=LAST, a=g.millis("a"), b=g.millis("b"))
    _add(name, _temporal, [T, ("a", TS), ("b", TS)], "BOOLEAN", f"coalesce({text}, false)", doc, f"{alias or name}(t, TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-02')", alias)
_add("present", _temporal, [T, ("i", TS)], "BOOLEAN", f"coalesce({FIRST} <= {g.millis('i')} AND {LAST} >= {g.millis('i')}, false)", "Whether the trajectory has begun and not ended at an instant.", "present(t, TIMESTAMP_NTZ'2024-01-01')")
_add("duration", _temporal, [T], "BIGINT", f"CAST({LAST} - {FIRST} AS BIGINT)", "Milliseconds from the first to the last vertex.", "duration(t)")

for name, condition, doc in (
    ("equal", "{f} = a AND {l} = b", "Whether the trajectory's time span is [a, b]."),
    ("starts", "{f} = a AND {l} < b", "Whether it starts at a and ends before b."),
    ("started_by", "{f} = a AND {l} > b", "Whether it starts at a and ends after b."),
    ("finishes", "{f} > a AND {l} = b", "Whether it starts after a and ends at b."),
    ("finished_by", "{f} < a AND {l} = b", "Whether it starts before a and ends at b."),
    ("overlaps", "{f} < a AND a < {l} AND {l} < b", "Whether it starts before a and ends within (a, b)."),
    ("overlapped_by", "a < {f} AND {f} < b AND {l} > b", "Whether it starts within (a, b) and ends after b."),
):
    _add(name, _temporal, [T, ("a", "BIGINT"), ("b", "BIGINT")], "BOOLEAN", _checked(condition.format(f=F_, l=L_)), doc, f"{name}(t, 1000, 3000)")
for name, condition, doc in (
    ("meets", "{l} = a", "Whether it ends at a."),
    ("met_by", "{f} = a", "Whether it starts at a."),
    ("precedes", "{l} < a", "Whether it ends before a."),
    ("preceded_by", "a < {f}", "Whether it starts after a."),
):
    _add(name, _temporal, [T, ("a", "BIGINT")], "BOOLEAN", _plain(condition.format(f=F_, l=L_)), doc, f"{name}(t, 1000)")


def _at(instant: str, found: str, none: str) -> str:
    """``found`` over the vertex pv at an instant, exact or interpolated; ``none`` outside the trajectory."""
    exact = "t[pk - 1].m = pi"
    vertex = g.let("pv", f"CASE WHEN {exact} THEN t[pk - 1] ELSE {g.interpolated('t[pk - 1]', 't[pk]', 'pi')} END", found)
    inside = f"CASE WHEN pk = 0 OR (pk = size(t) AND NOT ({exact})) THEN {none} ELSE {vertex} END"
    return g.let("pi", f"CAST({instant} AS DOUBLE)", g.let("pk", "size(filter(t, pf -> pf.m <= pi))", inside))


_PV = "named_struct('x', pv.x, 'y', pv.y)"
_add(
    "point_at_timestamp", _temporal, [T, ("i", TS)], POINT,
    f"CASE WHEN size(t) > 0 THEN {_at(g.millis('i'), _PV, 'NULL')} END",
    "The position at an instant, interpolated between vertices; null outside the trajectory.", "point_at_timestamp(t, TIMESTAMP_NTZ'2024-01-01')",
)
_add(
    "subpolyline_at", _temporal, [T, ("i", TS)], TRAJECTORY,
    f"CASE WHEN t IS NULL THEN NULL WHEN size(t) = 0 THEN slice(t, 1, 0) ELSE {_at(g.millis('i'), 'array(pv)', 'slice(t, 1, 0)')} END",
    "The one-vertex trajectory at an instant; empty outside the trajectory.", "subpolyline_at(t, TIMESTAMP_NTZ'2024-01-01')",
)


def _between() -> str:
    within = "t[hi].m >= lo AND t[hi].m <= up"
    head = f"CASE WHEN t[hk].m >= lo AND t[hk].m <= up THEN t[hk] ELSE {g.interpolated('t[hk]', 't[hk + 1]', 'lo')} END"
    middle = "filter(t, mv -> mv.m > lo AND mv.m < up AND mv.m > hv.m)"
    exact = "filter(t, tv -> tv.m = up AND tv.m > hv.m)"
    cut = f"transform(filter(sequence(0, size(t) - 2), ti -> t[ti].m < up AND up < t[ti + 1].m), tk -> {g.interpolated('t[tk]', 't[tk + 1]', 'up')})"
    tail = g.let("te", exact, f"CASE WHEN size(te) > 0 THEN slice(te, 1, 1) ELSE slice({cut}, 1, 1) END")
    clipped = g.let("hv", head, f"concat(array(hv), {middle}, {tail})")
    starts = f"slice(filter(sequence(0, size(t) - 2), hi -> ({within}) OR (t[hi].m < lo AND lo < t[hi + 1].m)), 1, 1)"
    several = f"flatten(transform({starts}, hk -> {clipped}))"
    one = "CASE WHEN t[0].m >= lo AND t[0].m <= up THEN t ELSE slice(t, 1, 0) END"
    body = f"CASE WHEN size(t) = 0 THEN t WHEN size(t) = 1 THEN {one} ELSE {several} END"
    bound = g.let("lo", f"CAST({g.millis('a')} AS DOUBLE)", g.let("up", f"CAST({g.millis('b')} AS DOUBLE)", body))
    return f"CASE WHEN a > b THEN CAST(raise_error('the interval ends before it starts') AS {TRAJECTORY}) WHEN t IS NULL OR a IS NULL OR b IS NULL THEN NULL ELSE {bound} END"


_add("subpolyline_between", _temporal, [T, ("a", TS), ("b", TS)], TRAJECTORY, _between(), "The part within [a, b], with interpolated vertices at its ends; empty without overlap.", "subpolyline_between(t, TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-02')")

BUCKET = (
    "CASE p WHEN 'second' THEN floor({m} / 1000) WHEN 'minute' THEN floor({m} / 60000) WHEN 'hour' THEN floor({m} / 3600000) "
    "WHEN 'day' THEN floor({m} / 86400000) WHEN 'year' THEN CAST(year(timestamp_millis(CAST({m} AS BIGINT))) AS BIGINT) "
    "ELSE CAST(raise_error('unknown precision') AS BIGINT) END"
)
_add(
    "tdwithin", _temporal, [T, ("u", TRAJECTORY), ("metres", "DOUBLE"), ("p", "STRING")], "BOOLEAN",
    f"exists(t, ta -> exists(u, tb -> {BUCKET.format(m='ta.m')} = {BUCKET.format(m='tb.m')} AND sqrt(power(ta.x - tb.x, 2) + power(ta.y - tb.y, 2)) <= {g.degrees('metres')}))",
    "Whether a vertex of each lies in the same UTC year, day, hour, minute or second within a distance.", "tdwithin(t, u, 10, 'second')",
)

_spatial = "spatial"
P = ("p", POLYGON)
ENDS = "try_element_at(t, 1).x", "try_element_at(t, 1).y", "try_element_at(t, -1).x", "try_element_at(t, -1).y"
STRICT = "CASE s WHEN 'strict' THEN {strict} WHEN 'relaxed' THEN {relaxed} ELSE CAST(raise_error('strictness is strict or relaxed') AS BOOLEAN) END"
_add(
    "contained", _spatial, [T, ("s", "STRING"), P], "BOOLEAN",
    "CASE WHEN t IS NULL OR p IS NULL THEN NULL WHEN size(t) = 0 THEN false ELSE " + STRICT.format(strict=g.line_inside_polygon("t", "p"), relaxed=g.line_meets_polygon("t", "p")) + " END",
    "strict: the polygon contains the whole line, which may touch its boundary; relaxed: they have a point in common.", "contained(t, 'strict', 'POLYGON((0 0,0 2,2 2,2 0,0 0))')",
)
_add(
    "properly_contained", _spatial, [T, P], "BOOLEAN",
    f"CASE WHEN t IS NULL OR p IS NULL THEN NULL ELSE {g.let('el', g.edges('p'), 'forall(t, v -> ' + g.interior('el', 'v.x', 'v.y') + ')')} END",
    "Whether every vertex is strictly inside.", "properly_contained(t, 'POLYGON((0 0,0 2,2 2,2 0,0 0))')",
)
_covered_end = f"({g.covers('el', ENDS[0], ENDS[1])} OR {g.covers('el', ENDS[2], ENDS[3])})"
_any_vertex = f"exists(t, v -> {g.covers('el', 'v.x', 'v.y')})"
_add(
    "crosses", _spatial, [T, ("s", "STRING"), P], "BOOLEAN",
    f"CASE WHEN t IS NULL OR p IS NULL THEN NULL WHEN size(t) = 0 THEN false ELSE {g.let('el', g.edges('p'), 'CASE WHEN ' + _covered_end + ' THEN false ELSE ' + STRICT.format(strict=_any_vertex, relaxed='(' + _any_vertex + ' OR ' + g.segments_meet(g.segments('t'), 'el') + ')') + ' END')} END",
    "Whether it starts and ends outside and has a vertex (strict) or any point (relaxed) in the polygon.", "crosses(t, 'strict', 'POLYGON((0 0,0 2,2 2,2 0,0 0))')",
)
_inside_ends = g.interior("el", ENDS[0], ENDS[1]), g.interior("el", ENDS[2], ENDS[3])
for name, condition, doc in (
    ("leaves", f"({_inside_ends[0]} AND NOT {_inside_ends[1]})", "Whether it starts strictly inside and does not end so."),
    ("leaves_and_returns", f"({_inside_ends[0]} AND {_inside_ends[1]} AND exists(t, v -> NOT {g.interior('el', 'v.x', 'v.y')}))", "Whether it starts and ends strictly inside with a vertex that is not."),
):
    _add(name, _spatial, [T, P], "BOOLEAN", f"CASE WHEN t IS NULL OR p IS NULL OR size(t) = 0 THEN false ELSE {g.let('el', g.edges('p'), condition)} END", doc, f"{name}(t, 'POLYGON((0 0,0 2,2 2,2 0,0 0))')")
_add(
    "passes_point", _spatial, [T, ("q", POINT), ("metres", "DOUBLE")], "BOOLEAN",
    f"CASE WHEN t IS NULL OR q IS NULL OR metres IS NULL OR size(t) = 0 THEN false ELSE exists({g.segments('t')}, ps -> {g.near_segment('ps', 'q.x', 'q.y', g.degrees('metres'))}) END",
    "Whether the line comes within a distance of a point.", "passes_point(t, point, 10)",
)


def _meet_inside() -> str:
    dx, dy, ex, ey = "(ma.bx - ma.ax)", "(ma.by - ma.ay)", "(mb.bx - mb.ax)", "(mb.by - mb.ay)"
    denom = f"({dx} * {ey} - {dy} * {ex})"
    at = f"(((mb.ax - ma.ax) * {ey} - (mb.ay - ma.ay) * {ex}) / {denom})"
    single = g.let("mu", at, g.interior("el", f"(ma.ax + mu * {dx})", f"(ma.ay + mu * {dy})"))
    ends = "array(" + ", ".join(f"named_struct('x', {s}.{e}x, 'y', {s}.{e}y)" for s in ("ma", "mb") for e in "ab") + ")"
    both = f"{g.on_segment('ma', 'mp.x', 'mp.y')} AND {g.on_segment('mb', 'mp.x', 'mp.y')}"
    overlap = f"exists({ends}, mp -> {both} AND {g.interior('el', 'mp.x', 'mp.y')})"
    pair = f"CASE WHEN NOT {g.meet('ma', 'mb')} THEN false WHEN {denom} != 0D THEN {single} ELSE {overlap} END"
    return g.let("el", g.edges("p"), f"exists({g.segments('t')}, ma -> exists({g.segments('u', 'sw')}, mb -> {pair}))")


_add(
    "polylines_intersect_in_polygon", _spatial, [T, ("u", TRAJECTORY), P], "BOOLEAN",
    f"CASE WHEN t IS NULL OR u IS NULL OR p IS NULL THEN NULL WHEN size(t) = 0 OR size(u) = 0 THEN false ELSE {_meet_inside()} END",
    "Whether two lines meet strictly inside a polygon.", "polylines_intersect_in_polygon(t, u, 'POLYGON((0 0,0 2,2 2,2 0,0 0))')",
)


def _when_at() -> str:
    hit = g.on_segment("ws", "q.x", "q.y")
    index = f"slice(filter(sequence(0, size(t) - 2), wk -> {g.let('ws', 'wl[wk]', hit)}), 1, 1)"
    part = "sqrt((power(q.x - t[wi].x, 2) + power(q.y - t[wi].y, 2)) / (power(t[wi + 1].x - t[wi].x, 2) + power(t[wi + 1].y - t[wi].y, 2)))"
    time = (
        "CASE WHEN t[wi].x = q.x AND t[wi].y = q.y THEN t[wi].m WHEN t[wi + 1].x = q.x AND t[wi + 1].y = q.y THEN t[wi + 1].m "
        f"ELSE {g.let('wa', part, 'round((1 - wa) * t[wi].m + wa * t[wi + 1].m)')} END"
    )
    return g.let("wl", g.segments("t"), f"try_element_at(transform({index}, wi -> {time}), 1)")


_add(
    "timestamp_at_position", _spatial, [T, ("q", POINT)], TS,
    f"CAST(timestamp_millis(CAST(CASE WHEN size(t) > 1 AND q IS NOT NULL THEN {_when_at()} END AS BIGINT)) AS {TS})",
    "When the line first reaches a point on it; null if it never does.", "timestamp_at_position(t, point)",
)
_add(
    "st_contained", "spatio-temporal", [T, P, ("a", "BIGINT"), ("b", "BIGINT")], "BOOLEAN",
    "CASE WHEN b < a THEN CAST(raise_error('the interval ends before it starts') AS BOOLEAN) WHEN t IS NULL OR p IS NULL OR size(t) = 0 THEN NULL "
    f"ELSE {F_} <= b AND {L_} >= a AND {g.line_meets_polygon('t', 'slice(p, 1, 1)')} END",
    "Whether it meets the polygon's outer ring's area and its time span meets [a, b].", "st_contained(t, 'POLYGON((0 0,0 2,2 2,2 0,0 0))', 0, 1000)",
)

_geometry = "geometry"
_add("st_length", _geometry, [T], "DOUBLE", f"CASE WHEN size(t) = 0 THEN 0D ELSE aggregate({g.segments('t')}, 0D, (acc, s) -> acc + sqrt(power(s.bx - s.ax, 2) + power(s.by - s.ay, 2))) END", "Planar length in degrees.", "st_length(t)")
_near = "least(" + ", ".join([g.square_distance("ma", "mb.ax", "mb.ay"), g.square_distance("ma", "mb.bx", "mb.by"), g.square_distance("mb", "ma.ax", "ma.ay"), g.square_distance("mb", "ma.bx", "ma.by")]) + ")"
_add(
    "st_distance", _geometry, [T, ("u", TRAJECTORY)], "DOUBLE",
    f"CASE WHEN size(t) = 0 OR size(u) = 0 THEN NULL ELSE sqrt(array_min(flatten(transform({g.segments('t')}, ma -> transform({g.segments('u', 'sw')}, mb -> CASE WHEN {g.meet('ma', 'mb')} THEN 0D ELSE {_near} END))))) END",
    "Smallest planar distance of two lines in degrees.", "st_distance(t, u)",
)
_add("st_intersects", _geometry, [T, P], "BOOLEAN", f"CASE WHEN t IS NULL OR p IS NULL THEN NULL WHEN size(t) = 0 THEN false ELSE {g.line_meets_polygon('t', 'p')} END", "Whether a line and a polygon have a point in common.", "st_intersects(t, polygon)")
_add("st_contains", _geometry, [P, ("q", POINT)], "BOOLEAN", f"CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE {g.let('el', g.edges('p'), g.interior('el', 'q.x', 'q.y'))} END", "Whether a point is strictly inside a polygon.", "st_contains(polygon, point)")

_codec = "codec"
_NUMBERS = "transform(split(trim({s}), '\\\\s+'), n -> CAST(n AS DOUBLE))"
_INSIDE = "regexp_extract(w, '\\\\(([^()]+)\\\\)', 1)"
_XY = "named_struct('x', c[0], 'y', c[1])"
_XYM = "named_struct('x', c[0], 'y', c[1], 'm', coalesce(try_element_at(c, 3), 0D))"
_add(
    "trajectory_from_text", _codec, [("w", "STRING")], TRAJECTORY,
    "CASE WHEN w IS NULL THEN NULL "
    f"WHEN upper(trim(w)) RLIKE '^LINESTRING\\\\s*M?\\\\s*EMPTY$' THEN CAST(array() AS {TRAJECTORY}) "
    "WHEN NOT upper(trim(w)) RLIKE '^LINESTRING\\\\s*M?\\\\s*\\\\([^()]+\\\\)$' THEN "
    f"CAST(raise_error(concat('not a line: ', w)) AS {TRAJECTORY}) ELSE "
    f"transform(split(regexp_extract(w, '\\\\(([^()]+)\\\\)', 1), ','), s -> {g.let('c', _NUMBERS.format(s='s'), _XYM)}) END",
    "A trajectory from WKT: LINESTRING M(x y m, ...).", "trajectory_from_text('LINESTRING M(0 0 1, 1 1 2)')",
)
_add(
    "polygon_from_text", _codec, [("w", "STRING")], POLYGON,
    "CASE WHEN w IS NULL THEN NULL WHEN NOT upper(trim(w)) RLIKE '^POLYGON\\\\s*\\\\(.*\\\\)$' THEN "
    f"CAST(raise_error(concat('not a polygon: ', w)) AS {POLYGON}) ELSE "
    "transform(regexp_extract_all(w, '\\\\(([^()]+)\\\\)', 1), r -> transform(split(r, ','), s -> "
    f"{g.let('c', _NUMBERS.format(s='s'), _XY)})) END",
    "A polygon from WKT; the first ring is the outer one, others are holes.", "polygon_from_text('POLYGON((0 0,0 2,2 2,2 0,0 0))')",
)
_add(
    "point_from_text", _codec, [("w", "STRING")], POINT,
    f"CASE WHEN w IS NULL THEN NULL ELSE {g.let('c', _NUMBERS.format(s=_INSIDE), _XY)} END",
    "A point from WKT.", "point_from_text('POINT(1 2)')",
)
_add("st_point", _geometry, [("px", "DOUBLE"), ("py", "DOUBLE")], POINT, "named_struct('x', px, 'y', py)", "A point.", "st_point(1, 2)")
_add("array_length", "array", [("t", TRAJECTORY)], "INT", "size(t)", "Number of vertices.", "array_length(t)")


def register(spark: SparkSession) -> None:
    """Create every function in the session; repeated calls replace them."""
    from wayfold.functions import codec

    for f in FUNCTIONS.values():
        args = ", ".join(f"{a} {t}" for a, t in f.args)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({args}) RETURNS {f.returns} RETURN {f.body}")
    codec.register(spark)


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, category, description, syntax, example, arguments) of every function, crop functions included."""
    from wayfold.functions import codec
    from wayfold.plans import crop

    rows = [(f.shown, f.category, f.doc, f.syntax, f.example, [f"{a}: {t}" for a, t in f.args]) for f in FUNCTIONS.values()]
    rows += [(n, "codec", d, s, s, [s[s.index("(") + 1 : -1]]) for n, s, d in codec.DOCS]
    rows += [(n, "crop", d, s, s, list(a)) for n, s, d, a in crop.DOCS]
    return spark.createDataFrame(rows, "name string, category string, description string, syntax string, example string, arguments array<string>")
