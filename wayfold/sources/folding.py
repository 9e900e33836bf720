"""A Python data source for files whose records span rows: one partition a file, read by a stateful fold.

``options(path=..., fold="module:name")``; the fold takes an iterator of CSV rows and yields result rows.
"""

from __future__ import annotations

import csv
import importlib
import io
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def named(text: str):
    module, _, name = text.partition(":")
    return getattr(importlib.import_module(module), name)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it: a local path, or a URI of any store that pyarrow opens."""
    if path.startswith("file:"):
        path = "file://" + "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class FoldReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        store, path = located(self.options["path"])
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        if not names:
            raise ValueError(f"nothing to read in: {path}")
        return [InputPartition(f) for f in names]

    def read(self, partition) -> Iterator[tuple]:
        fold = named(self.options["fold"])
        store, _ = located(self.options["path"])
        with io.TextIOWrapper(store.open_input_stream(partition.value), encoding="utf-8", newline="") as f:
            rows = csv.reader(f)
            if self.options.get("header", "true") == "true":
                next(rows, None)
            yield from fold(rows)


class FoldSource(DataSource):
    """format("wayfold_fold"): the files must be where all executors reach them."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_fold"

    def reader(self, schema) -> FoldReader:
        return FoldReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FoldSource)


def adjacent_trips(rows: Iterator[list[str]]) -> Iterator[tuple]:
    """Neighbouring segment rows (moid, trip, tstart, tend, xs, ys, xe, ye) of one trip as (trip_id, moid, vertices); times are numbers here."""
    key, line = None, []
    for moid, trip, ta, tb, xa, ya, xb, yb in rows:
        if (trip, moid) != key:
            if key:
                yield int(key[0]), int(key[1]), line
            key, line = (trip, moid), [(float(xa), float(ya), float(ta))]
        line.append((float(xb), float(yb), float(tb)))
    if key:
        yield int(key[0]), int(key[1]), line
