"""EWKB codecs and map matching, as Arrow functions over whole batches."""

from __future__ import annotations

import json
import struct
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shipping import ship
from wayfold.functions.types import LINE, POINT, POLYGON, TRAJECTORY

#: EWKB flags and type numbers.
Z_FLAG, M_FLAG, SRID_FLAG = 0x80000000, 0x40000000, 0x20000000
POINT_TYPE, LINE_TYPE, POLYGON_TYPE = 1, 2, 3
SRID = 4326

DOCS = [
    ("wkb_to_trajectory", "wkb_to_trajectory(bin)", "A trajectory from little-endian EWKB of a line with m."),
    ("trajectory_to_wkb", "trajectory_to_wkb(t)", "EWKB of a trajectory, SRID 4326."),
    ("polygon_from_wkb", "polygon_from_wkb(bin)", "A polygon from little-endian EWKB."),
    ("point_from_wkb", "point_from_wkb(bin)", "A point from little-endian EWKB."),
    ("map_match", "map_match(t)", "The road line that a matching service gives for a trajectory; null with fewer than two vertices or on failure."),
]


def _header(data: bytes, want: int) -> tuple[int, int]:
    """(offset of the body, numbers a vertex) of EWKB of the wanted type."""
    if len(data) < 5 or data[0] != 1:
        raise ValueError("not little-endian EWKB")
    (code,) = struct.unpack_from("<I", data, 1)
    kind, dims = code & 0x0FFFFFFF, 2 + bool(code & Z_FLAG) + bool(code & M_FLAG)
    if kind >= 1000:  # the ISO numbers
        kind, dims = kind % 1000, 2 + (1, 1, 2)[kind // 1000 - 1]
    if kind != want:
        raise ValueError(f"EWKB of type {kind}, not {want}")
    return 9 if code & SRID_FLAG else 5, dims


def _doubles(data: bytes, at: int, n: int) -> np.ndarray:
    if at + 8 * n > len(data):
        raise ValueError("EWKB ends early")
    return np.frombuffer(data, dtype="<f8", count=n, offset=at)


def line_of(data: bytes) -> np.ndarray:
    """(n, 3) vertices of EWKB of a line with m."""
    at, dims = _header(data, LINE_TYPE)
    if dims != 3:
        raise ValueError("EWKB of a line without m")
    (n,) = struct.unpack_from("<I", data, at)
    return _doubles(data, at + 4, 3 * n).reshape(-1, 3)


def wkb_of(vertices: np.ndarray) -> bytes:
    return struct.pack("<BIII", 1, LINE_TYPE | M_FLAG | SRID_FLAG, SRID, len(vertices)) + np.ascontiguousarray(vertices, dtype="<f8").tobytes()


def polygon_of(data: bytes) -> list[list[dict]]:
    at, dims = _header(data, POLYGON_TYPE)
    (n,) = struct.unpack_from("<I", data, at)
    at, rings = at + 4, []
    for _ in range(n):
        (k,) = struct.unpack_from("<I", data, at)
        xy = _doubles(data, at + 4, dims * k).reshape(-1, dims)
        rings.append([{"x": float(x), "y": float(y)} for x, y in xy[:, :2]])
        at += 4 + 8 * dims * k
    return rings


def point_of(data: bytes) -> dict:
    at, dims = _header(data, POINT_TYPE)
    x, y = _doubles(data, at, dims)[:2]
    return {"x": float(x), "y": float(y)}


_XY = [("x", pa.float64()), ("y", pa.float64())]
_VERTEX = pa.struct([*_XY, ("m", pa.float64())])


def _lists(values: list[np.ndarray | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Arrays of vertices as Arrow lists of structs, nulls as nulls."""
    sizes = [0 if v is None else len(v) for v in values]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate([v for v in values if v is not None and len(v)]) if sum(sizes) else np.zeros((0, len(fields)))
    child = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(fields))], names=[f for f, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets), child, mask=pa.array([v is None for v in values]))


def _vertices(column: pa.Array, names: tuple[str, ...] = ("x", "y", "m")) -> list[np.ndarray | None]:
    """Arrow lists of structs as arrays of vertices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.values, column.offsets.to_numpy()
    xs = np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if len(flat) else np.zeros((0, len(names)))
    return [xs[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist(), strict=True)]


def wkb_to_trajectory(column: pa.Array) -> pa.Array:
    return _lists([None if v is None else line_of(v) for v in column.to_pylist()], [("x", pa.float64()), ("y", pa.float64()), ("m", pa.float64())])


def trajectory_to_wkb(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else wkb_of(v) for v in _vertices(column)], pa.binary())


def polygon_from_wkb(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else polygon_of(v) for v in column.to_pylist()], pa.list_(pa.list_(pa.struct(_XY))))


def point_from_wkb(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else point_of(v) for v in column.to_pylist()], pa.struct(_XY))


def gpx(vertices: np.ndarray, with_time: bool) -> str:
    """The request body; times are given only if they rise strictly."""
    import datetime

    timed = with_time and bool((np.diff(vertices[:, 2]) > 0).all())
    when = lambda m: datetime.datetime.fromtimestamp(m / 1000, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    points = "".join(f'<trkpt lat="{y!r}" lon="{x!r}">{f"<time>{when(m)}</time>" if timed else ""}</trkpt>' for x, y, m in vertices.tolist())
    return f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1"><trk><trkseg>{points}</trkseg></trk></gpx>'


def http_client(endpoint: str, profile: str = "car", accuracy: float = 20.0, timeout_s: float = 10.0) -> Callable[[str], list]:
    """A client that posts GPX and gives the matched [lon, lat] pairs."""

    def ask(body: str) -> list:
        url = f"{endpoint}?profile={profile}&gps_accuracy={accuracy}&type=json&points_encoded=false"
        request = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": "application/gpx+xml"})
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return json.load(answer)["paths"][0]["points"]["coordinates"]

    return ask


def map_matcher(client: Callable[[str], list], concurrency: int = 16, use_time: bool = True):
    """map_match over a client: requests of a batch run side by side, results keep their order."""

    def one(vertices: np.ndarray | None) -> np.ndarray | None:
        if vertices is None or len(vertices) < 2:
            return None
        try:
            return np.array(client(gpx(vertices, use_time)), dtype=np.float64).reshape(-1, 2)
        except Exception:  # any failure of the service is a null
            return None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(concurrency) as pool:
            for column in batches:
                yield _lists(list(pool.map(one, _vertices(column))), _XY)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, LINE).asNondeterministic()


def register(spark: SparkSession) -> None:
    """Create the functions in the session. They are made here: Python workers import this module without a session."""
    ship(spark)
    for f, returns in ((wkb_to_trajectory, TRAJECTORY), (trajectory_to_wkb, "binary"), (polygon_from_wkb, POLYGON), (point_from_wkb, POINT)):
        spark.udf.register(f.__name__, F.arrow_udf(f, returns))
    get = lambda key, default: spark.conf.get(f"wayfold.map_matching.{key}", default)
    client = http_client(get("endpoint", "http://localhost:8989/match"), get("profile", "car"), float(get("gps_accuracy", "20")), float(get("request_timeout_ms", "10000")) / 1000)
    spark.udf.register("map_match", map_matcher(client, int(get("concurrency", "16")), get("use_timestamps", "true") == "true"))
