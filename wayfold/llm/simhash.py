"""SimHash near-duplicates over 64-bit fingerprints, searched by a generalised pigeonhole.

Correlated bits are grouped into parts. A pair within TAU bits must, for thresholds t_i with sum(t_i + 1) = TAU + 1,
agree within t_i bits on some part. Parts, widths and thresholds follow from a dynamic programme over the index
entries and candidate pairs expected from bit statistics of all fingerprints. Probing is an equi-join on (part, key)
of each fingerprint's key and the keys within t_i bits; the distance is verified inside the join, so only true links
leave it. Texts with one fingerprint are one node, and never paired.

``drop_near_duplicates`` removes near copies by exact similarity: five-word shingles, Jaccard 0.8. It begins with the
same method: fingerprints of those shingles, linked within TAU bits through the pigeonhole, union-find; each document is
compared with the first one of its component. Pairs of just that similarity differ in ten bits on average and some in
sixteen, where a pigeonhole over 64 bits would list more pairs than it excludes. So the pairs that are left are probed
through the shingles themselves: with all shingles in one order, two similar documents have one of their first
n - ceil(0.8 n) + 1 in common, n being each one's own number. Any order is exact; this one puts shingles that are common
in a sample last, and goes by hash among the others, so that a passage that many documents share brings few of them
together. Of documents that meet, only those whose SimHashes of 192 bits come within FAR are fetched and compared, as
the lines of fuzzy_lines are, and of those that have a leader in common only those whose odd sketches of the shingles
allow it, which rule out no similar pair. Of pairs of just that similarity one in 25,000 lies beyond the first 64 bits'
limit (WIDE), fewer beyond that of the 192.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import attach, checkpointed, scratch, ship, written
from wayfold.llm.components import components
from wayfold.llm.fuzzy_lines import ODD_WORDS, alike, close, joined

BITS = 64
#: Largest distance of a link.
TAU = 3
SHINGLE = 3
#: Seed of XXH64.
SEED = 42
#: A candidate pair is taken to cost as much as so many index entries (fetch, compare, sort).
CANDIDATE_COST = 24
BLOCK = 1 << 20
#: Of the removal of near copies: words of a shingle, least similarity, and the largest distance of fingerprints that is compared.
WORDS, SIMILARITY, WIDE = 5, 0.8, 22
#: The same of fingerprints with two more words of bits, each of the hashes times an odd number.
FAR, ODD = 60, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Documents in the sample of shingles, in how many of them a shingle counts as common, and how many such are listed. They change the order only.
SAMPLE, COMMON, LISTED = 5000, 3, 200_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ONES = np.array([[(b >> k) & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in blocks of about BLOCK bytes."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            m = _SPACE.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text: lower-cased A-Z, word shingles with repeats; no word gives 0."""
    hash64 = xxhash.xxh64_intdigest
    total, ones, held = 0, np.zeros(BITS, dtype=np.int64), []
    for block in _words(data.lower()):
        words = held + block
        if len(words) < size:
            held = words
            continue
        hashes = [hash64(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]
        held = words[-(size - 1) :]
        total += len(hashes)
        cells = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for j in range(8):
            ones[8 * j : 8 * j + 8] += np.bincount(cells[:, j], minlength=256) @ _ONES
    if not total:
        if not held:
            return 0
        return hash64(b" ".join(held), SEED)
    return sum(1 << k for k in np.nonzero(2 * ones > total)[0].tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp signed long) of every row; a null text counts as empty."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), size) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often bits i and j are both set, over all rows of ``fp``; 64 x 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at : at + (1 << 16)]
                both += part.T @ part
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel().astype(np.int64)) for v in (i, j, both)], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def _group(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each starts at the free bit of strongest correlation and takes those closest to it."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (BITS + k) // m
        part = [max(sorted(free), key=lambda b: max((corr[b, x] for x in free if x != b), default=0.0))]
        free -= {part[0]}
        while len(part) < width:
            b = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(b)
            free.remove(b)
        parts.append(sorted(part))
    return parts


def _within(both: np.ndarray, n: int, part: list[int], t: int) -> float:
    """Chance that two fingerprints differ in at most t bits of a part: beta-binomial with the mean and variance that the bit counts give."""
    p = np.diag(both)[part] / max(n, 1)
    q = 2 * p * (1 - p)
    cov = both[np.ix_(part, part)] / max(n, 1) - np.outer(p, p)
    pairs = 2 * cov * cov  # covariance of two bits' mismatches, beyond the marginals
    w, mean = len(part), max(float(q.mean()), 1e-6)
    var = float((q * (1 - q)).sum() + pairs.sum() - np.trace(pairs))
    base = w * mean * (1 - mean)
    rho = min(max((var / base - 1) / max(w - 1, 1), 1e-6), 0.5)
    s = 1 / rho - 1
    a, b = mean * s, (1 - mean) * s
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return sum(math.exp(math.lgamma(w + 1) - math.lgamma(d + 1) - math.lgamma(w - d + 1) + beta(d + a, w - d + b) - beta(a, b)) for d in range(t + 1))


def plan(both: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, thresholds of -1 (part unused) left out, of least expected cost.

    For every number of parts, a dynamic programme deals tau + 1 units among them: u units give a part threshold u - 1.
    """
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    best = None
    for m in range(2, tau + 2):
        parts = _group(corr, m)
        cost = lambda part, t: n * sum(math.comb(len(part), d) for d in range(t + 1)) + CANDIDATE_COST * n * n / 2 * _within(both, n, part, t)
        table = {0: (0.0, ())}
        for part in parts:
            new: dict[int, tuple[float, tuple]] = {}
            for used, (c, ts) in table.items():
                for u in range(tau + 2 - used):
                    x = (c + (cost(part, u - 1) if u else 0.0), (*ts, u - 1))
                    if used + u not in new or x < new[used + u]:
                        new[used + u] = x
            table = new
        if best is None or table[tau + 1][0] < best[0]:
            best = (table[tau + 1][0], [(part, t) for part, t in zip(parts, table[tau + 1][1], strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, parts: list[tuple[list[int], int]], tau: int = TAU) -> DataFrame:
    """(a, b) of distinct fingerprints with a < b and at most tau differing bits; a pair may come more than once."""
    index, probe = [], []
    for k, (bits, t) in enumerate(parts):
        mask = _signed(sum(1 << b for b in bits))
        index.append((k, mask, 0))
        probe += [(k, mask, _signed(sum(1 << b for b in flip))) for d in range(t + 1) for flip in combinations(bits, d)]

    def keyed(table: list[tuple[int, int, int]], name: str) -> DataFrame:
        values = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(m).alias("mask"), F.lit(x).alias("flip")) for k, m, x in table])
        one = fps.select(F.col("fp").alias(name), F.explode(values).alias("e"))
        return one.select(name, F.col("e.part").alias("part"), F.col(name).bitwiseAND(F.col("e.mask")).bitwiseXOR(F.col("e.flip")).alias("key"))

    x, y = keyed(probe, "a"), keyed(index, "b")
    on = (x.part == y.part) & (x.key == y.key) & (x.a < y.b) & (F.bit_count(x.a.bitwiseXOR(y.b)) <= tau)
    return x.join(y, on).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """(id, fp, component_id, component_size) of every row.

    Rows link when their fingerprints differ in at most ``tau`` bits; component_id is the smallest id reachable,
    the row's own included. Null texts count as empty; empty texts have fingerprint 0 and link like any other. A
    null id never names a component unless all of its ids are null. Repeated rows are repeated in the result. An
    empty table gives an empty table.
    """
    with scratch(docs.sparkSession):
        fps = written(fingerprints(docs, id_col, text_col, size), "fingerprints", keep=True)
        classes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
        sizes = classes.agg(F.count("*").alias("classes"), F.sum("n").alias("rows")).first()
        both = bit_counts(classes) if sizes["classes"] else np.zeros((BITS, BITS))
        roots = components(links(classes.select("fp"), plan(both, sizes["classes"], tau), tau))
        rooted = checkpointed(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        whole = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("nodes")))
        named = attach(rooted, whole, ["root"], "nodes", sizes["classes"]).select("fp", "n", "component_id", "component_size")
        named = written(named, "fingerprint-classes", keep=True)
    return attach(fps, named, ["fp"], "n", sizes["rows"] or 0).select("id", "fp", "component_id", "component_size")


def hashes_of(data: bytes, size: int = WORDS) -> np.ndarray:
    """The different shingles of a UTF-8 text as sorted signed 64-bit hashes: lower-cased words; a shorter text is one shingle."""
    words = data.decode(errors="replace").lower().encode(errors="replace").split()
    hash64 = xxhash.xxh64_intdigest
    n = max(len(words) - size + 1, 1)
    return np.unique(np.fromiter((hash64(b" ".join(words[i : i + size]), SEED) for i in range(n)), dtype=np.uint64, count=n).view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of different shingles, signed."""
    cells = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(cells[:, j], minlength=256) @ _ONES for j in range(8)])
    return _signed(sum(1 << k for k in np.nonzero(2 * ones > len(hashes))[0].tolist()))


def more(hashes: np.ndarray) -> list[int]:
    """Two further SimHashes, of other hashes of the same shingles."""
    out = []
    for odd in ODD:
        x = hashes.view(np.uint64) * np.uint64(odd)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(odd)
        out.append(majority((x ^ (x >> np.uint64(29))).view(np.int64)))
    return out


def odd(hashes: np.ndarray) -> list[int]:
    """The odd sketch of different shingles, as that of fuzzy_lines: its words, signed."""
    size = 64 * ODD_WORDS
    return np.packbits((np.bincount(hashes & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def prefix(own: np.ndarray, common: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order of all, so many that two similar sets have one of them in common."""
    take = len(own) - int(np.ceil(len(own) * similarity - 1e-9)) + 1
    if len(common):
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[:take]


def _common(texts: DataFrame, total: int) -> np.ndarray:
    """Hashes of shingles that many documents of a sample have, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("text").cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(hashes_of(x.as_py()))], names=["key"])

    part = max(1, total // SAMPLE)
    often = texts.where(F.pmod(F.col("h"), F.lit(part)) == 0).select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("f"))
    return np.sort(np.array([r["key"] for r in often.where(F.col("f") >= COMMON).orderBy(F.desc("f"), "key").limit(LISTED).collect()], dtype=np.int64))


def marks(keyed: DataFrame, total: int, similarity: float = SIMILARITY) -> DataFrame:
    """(node, i, h, fp, fp1, fp2, n, odd, prefix) of every row (i, h, text): a hash of its keys, the keys, its fingerprints, how many shingles it has, their odd sketch, the first ones of them."""
    spark = keyed.sparkSession
    held = spark.sparkContext.broadcast(_common(keyed, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashes_of(x.as_py()) for x in batch.column("text").cast(pa.binary())]
            fps = [pa.array(v, pa.int64()) for v in zip(*[(majority(x), *more(x)) for x in own], strict=True)] or [pa.array([], pa.int64())] * 3
            first = pa.array([prefix(x, held.value, similarity) for x in own], pa.list_(pa.int64()))
            sketch = pa.array([odd(x) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), *fps, pa.array([len(x) for x in own], pa.int64()), sketch, first], names=["i", "h", "fp", "fp1", "fp2", "n", "odd", "prefix"])

    out = keyed.select("i", "h", "text").mapInArrow(run, "i long, h long, fp long, fp1 long, fp2 long, n long, odd array<long>, prefix array<long>")
    return written(out.select(F.xxhash64("i", "h").alias("node"), "*"), "near-marks")


def seeds(each: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b) of each node and the first one of its component by fingerprints: links within tau bits through the pigeonhole, union-find."""
    classes = written(each.groupBy("fp").agg(F.min("node").alias("first")), "near-classes")
    n = classes.count()
    both = bit_counts(classes) if n else np.zeros((BITS, BITS))
    roots = components(links(classes.select("fp"), plan(both, n, tau), tau))
    rooted = written(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "near-fingerprints")
    heads = rooted.groupBy("root").agg(F.min("first").alias("a"))
    named = rooted.join(heads, "root").select("fp", "a")
    return each.select("fp", F.col("node").alias("b")).join(named, "fp").where("a != b").select("a", "b").distinct()


def sets(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, held): the hashed shingles of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashes_of(x.as_py()) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], names=["node", "held"])

    texts = keyed.select(F.xxhash64("i", "h").alias("node"), "text").join(nodes, "node").dropDuplicates(["node"])
    return written(texts.mapInArrow(run, "node long, held array<long>"), "near-sets")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without all but one row of each component of similar rows, all columns kept.

    The row with the smallest id stays, a null id being the largest; ties go to the smallest text hash, and of rows
    that repeat both id and text one stays. Null texts count as empty; texts without a word are alike. Texts are read
    whole, however long. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    with scratch(spark):
        each = marks(keyed, docs.count(), similarity)

        def near(x: Column, y: Column) -> Column:
            sizes = F.least(x["n"], y["n"]) >= F.lit(similarity - 1e-9) * F.greatest(x["n"], y["n"])
            bits = F.bit_count(x["fp"].bitwiseXOR(y["fp"]))
            more_bits = [F.bit_count(x[c].bitwiseXOR(y[c])) for c in ("fp1", "fp2")]
            return sizes & (bits <= WIDE) & (bits + more_bits[0] + more_bits[1] <= FAR)

        def verified(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            held = sets(keyed, written(ends, "near-ends"))
            both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
            return both.where(alike(F.col("x"), F.col("y"), similarity)).select("a", "b")

        light = each.select("node", F.struct("fp", "fp1", "fp2", "n").alias("light"))

        def finer(ends: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], Column], Callable[[DataFrame], DataFrame]]:
            fine = each.join(ends, "node").select("node", F.struct("fp", "fp1", "fp2", "n", "odd").alias("light")).dropDuplicates(["node"])
            return fine, lambda x, y: near(x, y) & close(x, y, similarity), verified

        first = written(verified(written(seeds(each), "near-seeds")), "near-known")
        roots = components(joined(light, each.select(F.explode("prefix").alias("key"), "node"), near, verified, finer, first))
        rooted = each.select("node", "i", "h").join(roots, "node", "left")
        rooted = written(rooted.select(F.coalesce("root", "node").alias("root"), F.col("i").isNull().alias("none"), "i", "h"), "near-rooted")
        whole = written(rooted.groupBy("root").agg(F.min(F.struct("none", "i", "h")).alias("first"), F.count("*").alias("rows")).where("rows > 1"), "near-firsts")
        members = written(attach(rooted, whole, ["root"], "rows", rooted.count()).select("none", "i", "h", "first"), "near-members", keep=True)
    return staying(docs, members, id_col, text)


def staying(docs: DataFrame, members: DataFrame, id_col: str, text: Column) -> DataFrame:
    """docs without the rows that go. members has (i, h, none, first) of every row of components with several: its id, its text's hash, whether the id is null, and (none, i, h) of the row that stays."""
    fate = members.groupBy("i", "h").agg(F.first(F.struct("none", "i", "h").eqNullSafe(F.col("first"))).alias("stays"), F.count("*").alias("copies"))
    fate = fate.select(F.col("i").alias("fate_i"), F.col("h").alias("fate_h"), "stays", "copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(text).alias("h"))
    marked = keyed.join(fate, keyed.i.eqNullSafe(fate.fate_i) & (keyed.h == fate.fate_h), "left").where("stays is null or stays")
    tied = F.coalesce(F.col("copies"), F.lit(1)) > 1
    if fate.where("stays and copies > 1").limit(1).count():
        one = marked.where(tied).withColumn("at", F.row_number().over(Window.partitionBy("i", "h").orderBy("i"))).where("at = 1")
        marked = marked.where(~tied).select("row").unionByName(one.select("row"))
    return marked.select("row.*")
