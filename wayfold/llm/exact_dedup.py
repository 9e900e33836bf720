"""Exact duplicates through an extendible-hash index on shared files.

1. Tasks over the documents combine copies within their split and send one entry for each text to its owner.
2. Owner tasks hold one range of the 64-bit key space each. An owner inserts its entries into buckets; an overfull
   bucket splits by one more key bit, doubling the directory when it must. Texts with one key are chained and told
   apart by comparing bytes. The buckets are written as Parquet files in the shared folder.
3. The directory is written beside them, and documents look up their text through it: owner and low key bits lead to
   the bucket, key and digest to the text in the bucket's chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import HOT_SHARE, attach, scratch, ship, shuffle_partitions, written

#: Keys in a bucket before it splits.
BUCKET = 256
#: Owners at most: beyond it each holds more.
MOST_OWNERS = 200_000
#: Text bytes that one owner should hold, and that a combining task holds before it sends its entries.
OWNER_BYTES = 48 << 20
SEED = 42


class Entry:
    """One text: the largest id, the rows, and the rows that have the largest id."""

    __slots__ = ("n", "text", "top", "top_rows")

    def __init__(self, text: bytes, top: int | None, n: int, top_rows: int):
        self.text, self.top, self.n, self.top_rows = text, top, n, top_rows

    def add(self, top: int | None, n: int, top_rows: int) -> None:
        self.n += n
        if top == self.top:
            self.top_rows += top_rows
        elif self.top is None or (top is not None and top > self.top):
            self.top, self.top_rows = top, top_rows


class Bucket:
    __slots__ = ("chains", "depth", "prefix")

    def __init__(self, depth: int, prefix: int):
        self.depth, self.prefix, self.chains = depth, prefix, {}


class ExtendibleIndex:
    """Directory of 2**depth slots over the low key bits; slots share a bucket until it splits."""

    def __init__(self, capacity: int = BUCKET):
        self.capacity, self.depth, self.slots = capacity, 0, [Bucket(0, 0)]

    def put(self, key: int, text: bytes, top: int | None, n: int, top_rows: int) -> None:
        bucket = self.slots[key & ((1 << self.depth) - 1)]
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            if entry.text == text:
                entry.add(top, n, top_rows)
                return
        chain.append(Entry(text, top, n, top_rows))
        while len(bucket.chains) > self.capacity:
            self._split(bucket)
            bucket = self.slots[key & ((1 << self.depth) - 1)]

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.slots += self.slots
            self.depth += 1
        bit = 1 << bucket.depth
        new = Bucket(bucket.depth + 1, bucket.prefix | bit)
        bucket.depth += 1
        new.chains = {k: c for k, c in bucket.chains.items() if k & bit}
        bucket.chains = {k: c for k, c in bucket.chains.items() if not k & bit}
        for slot in range(new.prefix, len(self.slots), bit << 1):
            self.slots[slot] = new

    def buckets(self) -> Iterator[Bucket]:
        for slot, bucket in enumerate(self.slots):
            if bucket.prefix == slot:
                yield bucket


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _combine(id_type: pa.DataType, owners: int):
    """Entries (owner, key, text, top, n, top_rows) of a split, copies in it combined."""
    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("text", pa.binary()), ("top", id_type), ("n", pa.int64()), ("top_rows", pa.int64())])

    def send(held: dict[bytes, tuple[int, Entry]]) -> pa.RecordBatch:
        rows = [((key >> 32) * owners >> 32, _signed(key), e.text, e.top, e.n, e.top_rows) for key, e in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, Entry]] = {}
        size = 0
        for batch in batches:
            for top, value in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                text = value.as_py()
                digest = hashlib.sha256(text).digest()
                if digest in held and held[digest][1].text == text:
                    held[digest][1].add(top, 1, 1)
                    continue
                held[digest] = (xxhash.xxh64_intdigest(text, SEED), Entry(text, top, 1, 1))
                size += len(text) + 200
                if size >= OWNER_BYTES // 4:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    return run


def _own(id_type: pa.DataType):
    """The index rows (owner, bucket, depth, key, chain, sha, keep, n, top_rows) of an owner's key range."""
    schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int64()), ("depth", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.string()), ("keep", id_type), ("n", pa.int64()), ("top_rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, owner = ExtendibleIndex(), None
        for batch in batches:
            own, keys, tops, ns, rows = (batch.column(c).to_pylist() for c in ("owner", "key", "top", "n", "top_rows"))
            for o, key, text, top, n, top_rows in zip(own, keys, batch.column("text"), tops, ns, rows, strict=True):
                owner = o
                index.put(key & 0xFFFFFFFFFFFFFFFF, text.as_py(), top, n, top_rows)
        out: list[tuple] = []
        for bucket in index.buckets():
            out += [(owner, bucket.prefix, bucket.depth, _signed(key), i, hashlib.sha256(e.text).hexdigest(), e.top, e.n, e.top_rows) for key, chain in sorted(bucket.chains.items()) for i, e in enumerate(chain)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


@dataclass
class Index:
    """The index on files: its buckets' entries, one row for each different text, and the directory that leads from an owner and the low bits of a key to a bucket."""

    buckets: DataFrame
    directory: DataFrame
    owners: int
    depth: int
    rows: int
    ties: int

    def place(self, key: Column) -> tuple[Column, Column]:
        """Owner and directory slot of a key."""
        owner = F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(self.owners).cast("long"), 32).cast("int")
        return owner, key.bitwiseAND(F.lit((1 << self.depth) - 1).cast("long"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Builds the index in the shared folder. Owners grow with the bytes of the input, but are never more than MOST_OWNERS.

    The directory holds all owners' slots at the depth of the deepest one: keys are hashes, so depths differ little.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    owners = min(MOST_OWNERS, max(shuffle_partitions(spark), -(-size // OWNER_BYTES)))
    entries = docs.mapInArrow(_combine(pa.int64(), owners), "owner int, key long, text binary, top long, n long, top_rows long")
    owned = entries.repartitionById(owners, "owner")
    buckets = written(owned.mapInArrow(_own(pa.int64()), "owner int, bucket long, depth int, key long, chain int, sha string, keep long, n long, top_rows long"), "exact-buckets", keep=True)
    facts = buckets.agg(F.sum("n").alias("rows"), F.max("top_rows").alias("ties"), F.max("depth").alias("depth")).first()
    depth = facts["depth"] or 0
    each = buckets.groupBy("owner", "bucket", "depth").agg(F.sum("n").alias("weight"))
    slots = F.sequence(F.col("bucket"), F.lit((1 << depth) - 1).cast("long"), F.expr("shiftleft(1L, depth)"))
    directory = written(each.select("owner", F.explode(slots).alias("slot"), "bucket", "weight"), "exact-directory", keep=True)
    return Index(buckets, directory, owners, depth, facts["rows"] or 0, facts["ties"] or 0)


def looked_up(index: Index, keyed: DataFrame) -> DataFrame:
    """keyed (key, sha and others; a table) with keep, n and top_rows of its text: by the directory to the bucket, by key and digest to the text in its chain.

    The chain's texts were told apart by their bytes when they were put in; the digest stands for them here, since
    two with one SHA-256 can't be made. Hot slots and texts go by broadcast of their few index rows.
    """
    owner, slot = index.place(F.col("key"))
    routed = attach(keyed.withColumn("owner", owner).withColumn("slot", slot), index.directory, ["owner", "slot"], "weight", index.rows)
    routed = written(routed.drop("slot", "weight"), "exact-routed", keep=True)
    entries = index.buckets.select("owner", "bucket", "key", "sha", "keep", "n", "top_rows")
    return attach(routed, entries, ["owner", "bucket", "key", "sha"], "n", index.rows).drop("owner", "bucket")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha")]


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    A null text counts as empty, and empty texts are copies of each other. The row with the largest id stays; a null
    id is smaller than any other. Of rows that repeat both id and text, one stays. Texts are read whole, however
    long. An empty table gives an empty table.
    """
    with scratch(docs.sparkSession):
        index = build_index(docs, id_col, text_col)
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), *_keyed(docs, id_col, text_col)), "exact-rows", keep=True)
        found = looked_up(index, rows)
        stays = F.col("id").eqNullSafe(F.col("keep"))
        if index.ties > 1:
            tied = written(found.where(stays & (F.col("top_rows") > 1)), "exact-tied", keep=True)
            first = written(tied.groupBy("key", "sha").agg(F.min("row").alias("first"), F.count("*").alias("ties")), "exact-first", keep=True)
            one = attach(tied, first, ["key", "sha"], "ties", tied.count()).withColumn("kept", F.col("row") == F.col("first")).drop("first", "ties")
            found = found.where(~(stays & (F.col("top_rows") > 1))).withColumn("kept", stays).unionByName(one)
        else:
            found = found.withColumn("kept", stays)
    return found.select("id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``duplicates`` keeps, with all their columns.

    The index entries of texts with copies are looked up: those of hot texts by broadcast first, so that of their rows
    only those to keep go on. Where rows repeat id and text, one of them stays. An empty table gives an empty table.
    """
    with scratch(docs.sparkSession):
        index = build_index(docs, id_col, text_col)
        copied = written(index.buckets.where("n > 1").select("key", "sha", "keep", "n", "top_rows"), "exact-copied", keep=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, *_keyed(docs, id_col, text_col))
    limit = max(1000, int(index.rows * HOT_SHARE))
    stays = F.col("keep").isNull() & F.col("top_rows").isNull() | F.col("id").eqNullSafe(F.col("keep"))
    hot = keyed.join(F.broadcast(copied.where(F.col("n") > limit).drop("n")), ["key", "sha"], "left").where(stays).drop("keep", "top_rows")
    left = hot.join(copied.drop("n"), ["key", "sha"], "left").where(stays)
    if index.ties > 1:
        tied = F.coalesce(F.col("top_rows"), F.lit(1)) > 1
        one = left.where(tied).groupBy("key", "sha").agg(F.first("row").alias("row"))
        left = left.where(~tied).select("row").unionByName(one.select("row"))
    return left.select("row.*")
