"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wayfold.functions.shipping import ship as ship_package

#: A key counts as hot when it holds more than this share of all rows, so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Removes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes in an Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, and keeps their Arrow batches small: texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship_package(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Set here only where unset and the master is local, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wayfold-checkpoint-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths written within each open scratch().
_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written within, at its end, but for those written to be kept."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it survives lost executors and cuts the lineage.

    Its shuffle files go when it is written. A table to be kept outlives the innermost scratch() and falls to the next one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a scratch table."""
    return written(df, "scratch")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left to right, whose keys are unique and whose column ``weight`` counts left's rows of the key.

    Keys with over HOT_SHARE of the ``total`` rows go by broadcast: fewer than 1 / HOT_SHARE rows whatever the
    input's size. All others are shuffled, so that no task gets more than that share through one key. left is read
    twice and should be materialised.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(right.where(F.col(weight) > limit))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) <= limit), keys)
    return left.join(hot, keys).unionByName(rest)


#: Bits of the table that ``among`` broadcasts, as a power of two: a million words of 64 bits at most.
AMONG = 26


def among(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of left whose key, a hash, is one of right's; rows of other keys that share their last AMONG bits with one of these may stay too.

    A smaller input for the join that follows: what it has no match for needn't be shuffled. The broadcast is bounded.
    """
    word, bit = f"`{key}` >> 6 & {(1 << AMONG - 6) - 1}", f"int(`{key}` & 63)"
    held = right.select(F.expr(word).alias("among_word"), F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("among_word").agg(F.bit_or("bit").alias("among_bits"))
    both = left.join(F.broadcast(held), F.expr(word) == F.col("among_word"))
    return both.where(F.expr(f"(shiftrightunsigned(among_bits, {bit}) & 1) = 1")).select(*[F.col(f"`{c}`") for c in left.columns])


def free(columns: list[str], name: str) -> str:
    """name, or with the first number from 2 that no column of that name (in any case) has: new columns replace none."""
    taken, out, k = {c.lower() for c in columns}, name, 1
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def with_columns(docs: DataFrame, run: Callable[[pa.RecordBatch], list[pa.Array]], new: list[tuple[str, str]]) -> DataFrame:
    """docs with the columns that run gives for each Arrow batch, of the names and types ``new``; a name that is taken gets a number (``free``). Columns go by place, so any names will do."""
    names = docs.columns
    added = [f"n{i}" for i in range(len(new))]
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    for n, (_, t) in zip(added, new, strict=True):
        schema = schema.add(n, t)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(batch)], names=[*batch.schema.names, *added])

    out = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(each, schema)
    return out.toDF(*names, *[free(names, n) for n, _ in new])
