"""crop(column, expr): cuts trajectories by time or region.

expr is made of calls, AND, OR (one precedence, left to right) and parentheses; arguments are single-quoted strings.
It compiles to SQL over an array of lines: AND applies the right side to the left side's pieces, OR concatenates the
pieces of both. A null column gives no pieces. Vertices are kept or dropped, never interpolated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import macros as g
from wayfold.functions.types import MULTI, TRAJECTORY

DOCS = [
    ("crop.during", "during('a', 'b')", "Vertices with a <= m <= b.", ("a", "b")),
    ("crop.not_during", "not_during('a', 'b')", "The part before a and the part after b.", ("a", "b")),
    ("crop.follows", "follows('t')", "The part after t.", ("t",)),
    ("crop.precedes", "precedes('t')", "The part before t.", ("t",)),
    ("crop.contained", "contained('POLYGON(...)')", "Runs of vertices strictly inside.", ("polygon",)),
    ("crop.not_contained", "not_contained('POLYGON(...)')", "Runs of vertices not strictly inside.", ("polygon",)),
]


class CropError(ValueError):
    """A crop expression that can't be read."""


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<word>[A-Za-z_]\w*)|(?P<sign>[(),]))")


def parse(text: str):
    """The syntax tree of an expression."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CropError(f"unexpected text in crop: {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal place
        k, v = tokens[place]
        if k != kind or (value is not None and v != value):
            raise CropError(f"expected {value or kind}, found {v or 'the end'}")
        place += 1
        return v

    def term():
        if tokens[place] == ("sign", "("):
            take("sign", "(")
            inner = chain()
            take("sign", ")")
            return inner
        name = take("word").lower()
        take("sign", "(")
        args = [take("string")]
        while tokens[place] == ("sign", ","):
            take("sign", ",")
            args.append(take("string"))
        take("sign", ")")
        return Call(name, tuple(a[1:-1].replace("''", "'") for a in args))

    def chain():
        left = term()
        while tokens[place][0] == "word" and tokens[place][1].upper() in ("AND", "OR"):
            op = take("word").upper()
            left = Both(op, left, term())
        return left

    tree = chain()
    take("end")
    return tree


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError as e:
        raise CropError(f"not a time: {text!r}") from e


def _polygon(text: str) -> str:
    rings = re.findall(r"\(([^()]+)\)", text)
    if not re.fullmatch(r"\s*POLYGON\s*\(.*\)\s*", text, re.IGNORECASE | re.DOTALL) or not rings:
        raise CropError(f"not a polygon: {text!r}")
    point = lambda p: "named_struct('x', {0!r}D, 'y', {1!r}D)".format(*map(float, p.split()[:2]))
    return "array(" + ", ".join("array(" + ", ".join(point(p) for p in r.split(",")) + ")" for r in rings) + ")"


def _filtered(condition: str) -> str:
    return f"array(filter(cl, cv -> {condition}))"


def _runs(polygon: str, inside: bool) -> str:
    """Longest runs of vertices that are (not) strictly inside; the bounding box is tested first."""
    points = [tuple(map(float, m)) for m in re.findall(r"'x', (\S+?)D, 'y', (\S+?)D", polygon)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = f"cv.x > {min(xs)!r}D AND cv.x < {max(xs)!r}D AND cv.y > {min(ys)!r}D AND cv.y < {max(ys)!r}D"
    test = f"({box} AND {g.interior('ce', 'cv.x', 'cv.y')})"
    flags = f"transform(cl, cv -> {test if inside else 'NOT ' + test})"
    steps = "sequence(0, size(cf) - 1)"
    starts = f"filter({steps}, ci -> cf[ci] AND (ci = 0 OR NOT cf[greatest(ci - 1, 0)]))"
    ends = f"filter({steps}, ci -> cf[ci] AND (ci = size(cf) - 1 OR NOT cf[least(ci + 1, size(cf) - 1)]))"
    runs = f"zip_with({starts}, {ends}, (ca, cb) -> slice(cl, ca + 1, cb - ca + 1))"
    cut = g.let("ce", g.edges(polygon), g.let("cf", flags, runs))
    return f"CASE WHEN size(cl) = 0 THEN CAST(array() AS {MULTI}) ELSE {cut} END"


def _pieces(call: Call) -> str:
    """SQL for the pieces of a line cl; empty pieces may be among them."""
    arity = {"during": 2, "not_during": 2, "follows": 1, "precedes": 1, "contained": 1, "not_contained": 1}
    if call.name not in arity:
        raise CropError(f"unknown crop function: {call.name}")
    if len(call.args) != arity[call.name]:
        raise CropError(f"{call.name} takes {arity[call.name]} arguments")
    if call.name in ("contained", "not_contained"):
        return _runs(_polygon(call.args[0]), call.name == "contained")
    times = [_number(a) for a in call.args]
    if len(times) == 2 and times[0] > times[1]:
        raise CropError("the interval ends before it starts")
    a, b = f"{times[0]!r}D", f"{times[-1]!r}D"
    return {
        "during": _filtered(f"cv.m >= {a} AND cv.m <= {b}"),
        "not_during": f"concat({_filtered(f'cv.m < {a}')}, {_filtered(f'cv.m > {b}')})",
        "follows": _filtered(f"cv.m > {a}"),
        "precedes": _filtered(f"cv.m < {a}"),
    }[call.name]


def compile_tree(tree, lines: str) -> str:
    """SQL for the pieces that a tree makes of an array of lines."""
    if isinstance(tree, Call):
        return f"filter(flatten(transform({lines}, cl -> {_pieces(tree)})), cp -> size(cp) > 0)"
    if tree.op == "AND":
        return compile_tree(tree.right, compile_tree(tree.left, lines))
    return f"concat({compile_tree(tree.left, lines)}, {compile_tree(tree.right, lines)})"


def compile_crop(column: str, expression: str) -> str:
    """SQL for crop(column, expression)."""
    lines = f"CASE WHEN {column} IS NULL THEN CAST(array() AS {MULTI}) ELSE array(CAST({column} AS {TRAJECTORY})) END"
    return compile_tree(parse(expression), lines)


def crop(df: DataFrame, column: str, expression: str, name: str = "crop") -> DataFrame:
    """df with the cropped trajectory as its last column."""
    return df.withColumn(name, F.expr(compile_crop(column, expression)))
