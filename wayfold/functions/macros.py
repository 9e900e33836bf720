"""SQL text for planar geometry, for use inside lambdas, where SQL functions can't be called.

Every macro takes and gives SQL text. ``let`` binds a costly text to a name, so that it is evaluated once.
"""

from __future__ import annotations

import math

#: Metres that one degree is taken for: the shorter of a degree of latitude and one of longitude at latitude 52.52.
METRES_PER_DEGREE = min(111_320.0, 111_320.0 * math.cos(math.radians(52.52)))


def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def millis(ts: str) -> str:
    return f"unix_millis(CAST({ts} AS TIMESTAMP))"


def degrees(metres: str) -> str:
    return f"(({metres}) / {METRES_PER_DEGREE!r}D)"


def segments(line: str, v: str = "sv") -> str:
    """Segments (ax, ay, bx, by) of a line; a line of one vertex is one segment without length."""
    nxt = f"{line}[least({v}i + 1, size({line}) - 1)]"
    return (
        f"transform(slice({line}, 1, greatest(size({line}) - 1, 1)), ({v}, {v}i) -> "
        f"named_struct('ax', {v}.x, 'ay', {v}.y, 'bx', {nxt}.x, 'by', {nxt}.y))"
    )


def edges(polygon: str) -> str:
    """Edges of all rings, each closed."""
    return (
        f"flatten(transform({polygon}, er -> transform(er, (ep, ei) -> named_struct('ax', ep.x, 'ay', ep.y, "
        f"'bx', er[(ei + 1) % size(er)].x, 'by', er[(ei + 1) % size(er)].y))))"
    )


def cross(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def on_segment(s: str, px: str, py: str) -> str:
    """Whether a point is on segment s."""
    inside = f"{px} >= least({s}.ax, {s}.bx) AND {px} <= greatest({s}.ax, {s}.bx) AND {py} >= least({s}.ay, {s}.by) AND {py} <= greatest({s}.ay, {s}.by)"
    return f"({inside} AND {cross(f'{s}.ax', f'{s}.ay', f'{s}.bx', f'{s}.by', px, py)} = 0D)"


def on_boundary(edge_list: str, px: str, py: str) -> str:
    return f"exists({edge_list}, be -> {on_segment('be', px, py)})"


def odd(edge_list: str, px: str, py: str) -> str:
    """Whether a ray from the point crosses an odd number of edges."""
    c = cross("re.ax", "re.ay", "re.bx", "re.by", px, py)
    hit = f"((re.ay > {py}) != (re.by > {py}) AND {c} != 0D AND ({c} > 0D) = (re.by > re.ay))"
    return f"(size(filter({edge_list}, re -> {hit})) % 2 = 1)"


def interior(edge_list: str, px: str, py: str) -> str:
    return f"({odd(edge_list, px, py)} AND NOT {on_boundary(edge_list, px, py)})"


def covers(edge_list: str, px: str, py: str) -> str:
    return f"({odd(edge_list, px, py)} OR {on_boundary(edge_list, px, py)})"


def meet(s: str, r: str) -> str:
    """Whether two segments have a point in common."""
    d1, d2 = cross(f"{r}.ax", f"{r}.ay", f"{r}.bx", f"{r}.by", f"{s}.ax", f"{s}.ay"), cross(f"{r}.ax", f"{r}.ay", f"{r}.bx", f"{r}.by", f"{s}.bx", f"{s}.by")
    d3, d4 = cross(f"{s}.ax", f"{s}.ay", f"{s}.bx", f"{s}.by", f"{r}.ax", f"{r}.ay"), cross(f"{s}.ax", f"{s}.ay", f"{s}.bx", f"{s}.by", f"{r}.bx", f"{r}.by")
    boxes = f"least({s}.ax, {s}.bx) <= greatest({r}.ax, {r}.bx) AND least({r}.ax, {r}.bx) <= greatest({s}.ax, {s}.bx) AND least({s}.ay, {s}.by) <= greatest({r}.ay, {r}.by) AND least({r}.ay, {r}.by) <= greatest({s}.ay, {s}.by)"
    return f"({boxes} AND sign({d1}) * sign({d2}) <= 0D AND sign({d3}) * sign({d4}) <= 0D)"


def square_distance(s: str, px: str, py: str) -> str:
    """Squared distance of a point to segment s."""
    length = f"(power({s}.bx - {s}.ax, 2) + power({s}.by - {s}.ay, 2))"
    along = f"(({px} - {s}.ax) * ({s}.bx - {s}.ax) + ({py} - {s}.ay) * ({s}.by - {s}.ay))"
    u = f"CASE WHEN {length} = 0D THEN 0D ELSE greatest(0D, least(1D, {along} / {length})) END"
    return let("su", u, f"power({px} - {s}.ax - su * ({s}.bx - {s}.ax), 2) + power({py} - {s}.ay - su * ({s}.by - {s}.ay), 2)")


def near_segment(s: str, px: str, py: str, reach: str) -> str:
    """Whether a point is within reach of segment s; a point on it is, however the distance is rounded."""
    return f"({on_segment(s, px, py)} OR {square_distance(s, px, py)} <= power({reach}, 2))"


def segments_meet(a: str, b: str) -> str:
    """Whether any of the segments in list a meets one in list b."""
    return f"exists({a}, ma -> exists({b}, mb -> {meet('ma', 'mb')}))"


def line_meets_polygon(line: str, polygon: str) -> str:
    """Whether a line and a polygon (with its inside) have a point in common."""
    vertex = f"exists({line}, lv -> {covers('le', 'lv.x', 'lv.y')})"
    return let("le", edges(polygon), f"({vertex} OR {segments_meet(segments(line), 'le')})")


def line_inside_polygon(line: str, polygon: str) -> str:
    """Whether a polygon contains a line: no point outside, some inside. Each segment is cut at the edges it meets; the middles of its parts must not be outside."""
    dx, dy = "(ws.bx - ws.ax)", "(ws.by - ws.ay)"
    ex, ey = "(we.bx - we.ax)", "(we.by - we.ay)"
    denom = f"({dx} * {ey} - {dy} * {ex})"
    at = f"(((we.ax - ws.ax) * {ey} - (we.ay - ws.ay) * {ex}) / {denom})"
    length = f"({dx} * {dx} + {dy} * {dy})"
    foot = lambda x, y: f"((({x} - ws.ax) * {dx} + ({y} - ws.ay) * {dy}) / {length})"
    cuts = (
        f"flatten(transform(filter(we_list, we -> {meet('ws', 'we')}), we -> "
        f"CASE WHEN {length} = 0D THEN array(0D) WHEN {denom} != 0D THEN array({at}) ELSE array({foot('we.ax', 'we.ay')}, {foot('we.bx', 'we.by')}) END))"
    )
    stops = f"array_sort(filter(array_distinct(concat(array(0D, 1D), {cuts})), wt -> wt >= 0D AND wt <= 1D))"
    middles = let("wl", stops, "transform(sequence(0, size(wl) - 2), wi -> (wl[wi] + wl[wi + 1]) / 2)")
    points = f"flatten(transform({segments(line)}, ws -> transform({middles}, wm -> named_struct('x', ws.ax + wm * {dx}, 'y', ws.ay + wm * {dy}))))"
    vertices = f"transform({line}, wv -> named_struct('x', wv.x, 'y', wv.y))"
    test = let("wp", f"concat({vertices}, {points})", f"(forall(wp, wq -> {covers('we_list', 'wq.x', 'wq.y')}) AND exists(wp, wq -> {interior('we_list', 'wq.x', 'wq.y')}))")
    return let("we_list", edges(polygon), test)


def interpolated(v0: str, v1: str, at: str) -> str:
    """The vertex at time ``at`` between two vertices."""
    alpha = f"CASE WHEN abs({v1}.m - {v0}.m) < 1e-6D THEN 0D ELSE ({at} - {v0}.m) / ({v1}.m - {v0}.m) END"
    return let("al", alpha, f"named_struct('x', {v0}.x + al * ({v1}.x - {v0}.x), 'y', {v0}.y + al * ({v1}.y - {v0}.y), 'm', {at})")
