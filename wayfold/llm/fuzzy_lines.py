"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's shingles are its substrings of SHINGLE characters (UTF-16 units) at every position, lower-cased; a line of up
to that length is one shingle. Equal lines are one node. Its signature has sixteen minima over the hashes of all its
shingles, each in another order; BANDS names the four of them that make a key. The fours are lines of an affine plane,
three classes of parallels, so sixteen minima give twelve keys and two lines of similarity s share one with the chance
that ``expected_recall`` adds up: 0.98 at 0.8, 0.99 at 0.85. The minima are taken STEP positions a row, by a plain
aggregate. Lines that share a key are candidates:

* each line of a bucket with the bucket's leader, the line that shares buckets with the most others: of a line and its
  changed copies that is the line itself, which most copies are similar to though not to each other. Union-find joins
  those that are similar, so a bucket of copies costs one comparison a line, and a bucket of two lines is done;
* of the others, the pairs of lines that have a leader in common but lie in different components, if they agree on
  AGREED minima and their odd sketches don't rule them out. An odd sketch has a bit for each number that a shingle's
  hash may end in, set if an odd number of shingles do; two of them differ in no more bits than the lines in shingles,
  so it rules out no similar pair. Changed copies of one line are compared exactly only where they may be similar.

So no two similar lines of a bucket stay apart, and pairs that are joined already or aren't similar are never listed.
Candidates are compared by exact Jaccard on their shingles (as 64-bit hashes), their texts being fetched once; of each component's lines, wherever
they stand, the first one stays. Every row of the input is a document of its own, whatever its id.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import among, attach, scratch, written
from wayfold.llm.components import components

SHINGLE = 12
SIMILARITY = 0.8
#: Product in the field of four elements; the sum is the exclusive or.
_TIMES = ((0, 0, 0, 0), (0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 1, 2))
#: Fours of minima: lines of the affine plane over that field, of three directions.
BANDS = [tuple(4 * x + (_TIMES[a][x] ^ c) for x in range(4)) for a in range(3) for c in range(4)]
PERMUTATIONS = 16
#: Orders of hashes: as they are after the exclusive or with one of these. Any numbers would do that begin in other quarters of the range.
MASKS = (0x13C6EF372FE94F82, 0x54FF53A55F1D36F1, 0x9B05688C2B3E6C1F, 0xE0CD19137E2179A5)
#: Least number of equal minima of lines that are compared exactly: at similarity 0.8 two lines in 4,000 have fewer.
AGREED = 7
#: 64-bit words of a set's odd sketch, a power of two.
ODD_WORDS = 16
#: Shingle positions handled by one row.
STEP = 4


def hashed(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of the different shingles of a line."""
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.length(b) - (2 * size - 1), F.lit(1)), F.lit(2))
    # an array of one: the line is encoded once, not at every position
    each = F.transform(F.array(F.encode(F.lower(line), "UTF-16BE")), lambda b: F.transform(at(b), lambda p: F.xxhash64(F.substring(b, p, F.lit(2 * size)))))
    return F.array_distinct(F.get(each, F.lit(0)))


def expected_recall(similarity: float = SIMILARITY) -> float:
    """Chance that two lines of that similarity share a key."""
    found = 0.0
    for agree in product((0, 1), repeat=PERMUTATIONS):
        if any(all(agree[i] for i in band) for band in BANDS):
            found += similarity ** sum(agree) * (1 - similarity) ** (PERMUTATIONS - sum(agree))
    return found


def _line_keys(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def lines_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, line) of every line with a word."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"\S")).select(*_line_keys(), "line")


def nodes(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, k1, k2, n, m0, m1, ...) of each different line: a number, two hashes, how often it occurs, its minima (32 bits each)."""
    units = lines.select("k1", "k2", F.encode(F.lower("line"), "UTF-16BE").alias("b"))
    units = units.withColumn("last", F.greatest(F.expr(f"int(length(b) div 2) - {size}"), F.lit(0)))
    at = units.select("k1", "k2", "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("p"))
    own = at.select("k1", "k2", (F.col("p") == 0).cast("long").alias("one"), *[F.expr(f"xxhash64(substring(b, 2 * least(p + {i}, last) + 1, {2 * size}))").alias(f"h{i}") for i in range(STEP)])
    mixed = own.select("k1", "k2", "one", *[c.alias(f"x{i}_{j}") for i in range(STEP) for j, c in enumerate((F.col(f"h{i}"), F.xxhash64(f"h{i}", F.lit(1))))])
    mixed = mixed.select("*", *[F.shiftleft(f"x{i}_{j}", 32).alias(f"y{i}_{j}") for i in range(STEP) for j in range(2)])
    # two hashes, four masks, and of each the upper and the lower half; no term comes twice, as Spark keeps repeated ones in fields
    least = []
    for j, mask in product(range(2), MASKS):
        for half, by in (("x", mask), ("y", mask << 32 & (1 << 64) - 1)):
            least.append(F.least(*[F.col(f"{half}{i}_{j}").bitwiseXOR(F.lit(by - (1 << 64) if by >> 63 else by)) for i in range(STEP)]))
    least = [c.alias(f"m{j}") for j, c in enumerate(least)]
    minima = mixed.select("k1", "k2", "one", *least).groupBy("k1", "k2").agg(F.sum("one").alias("n"), *[F.min(f"m{j}").alias(f"m{j}") for j in range(PERMUTATIONS)])
    return minima.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", *[F.shiftright(f"m{j}", 32).cast("int").alias(f"m{j}") for j in range(PERMUTATIONS)])


def entries(each: DataFrame) -> DataFrame:
    """(key, node) for each key of each node."""
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{j}") for j in band]) for b, band in enumerate(BANDS)]
    return each.select(F.explode(F.array(*keys)).alias("key"), "node")


def _similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets of shingles have that Jaccard similarity; sizes that rule it out are tested first."""
    same, least = F.size(F.array_intersect(x, y)), similarity - 1e-9
    sizes = F.least(F.size(x), F.size(y)) >= F.lit(least) * F.greatest(F.size(x), F.size(y))
    # same >= least * (size of both together), solved for same: it is made once
    return sizes & (same * F.lit(1 + least) >= F.lit(least) * (F.size(x) + F.size(y)))


def alike(x: Column, y: Column, similarity: float, shingled: Callable[[Column], Column] = lambda c: c) -> Column:
    """Whether two contents are similar. An array of one struct: the shingles are made once, and seen by the whole comparison."""
    return F.exists(F.array(F.struct(shingled(x).alias("x"), shingled(y).alias("y"))), lambda p: _similar(p["x"], p["y"], similarity))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    both = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def odd_bits(x: Column, y: Column) -> Column:
    """In how many bits two odd sketches (arrays of ODD_WORDS longs) differ: never more than the elements in which their sets do."""
    differ = [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(ODD_WORDS)]
    return sum(differ[1:], differ[0])


def close(x: Column, y: Column, similarity: float) -> Column:
    """False only for sets that surely aren't similar. x and y have their sizes n and odd sketches ``odd``.

    Sets of that Jaccard similarity differ in (1 - s) / (1 + s) of their sizes' sum at most.
    """
    sizes = F.least(x["n"], y["n"]) >= F.lit(similarity - 1e-9) * F.greatest(x["n"], y["n"])
    return sizes & (odd_bits(x["odd"], y["odd"]) <= F.lit((1 - similarity) / (1 + similarity) + 1e-9) * (x["n"] + y["n"]))


def sketches(texts: DataFrame) -> DataFrame:
    """(node, n, odd) of (node, line): how many different shingles, and of their hashes' last bits, as numbers, which occur an odd number of times."""
    each = texts.select("node", F.explode(hashed(F.col("line"))).alias("h")).select("node", F.expr(f"int(h >> 6 & {ODD_WORDS - 1})").alias("word"), F.expr("shiftleft(1L, int(h & 63))").alias("bit"))
    words = [F.expr(f"bit_xor(if(word = {i}, bit, 0L))").alias(f"w{i}") for i in range(ODD_WORDS)]
    return each.groupBy("node").agg(F.count("*").alias("n"), *words).select("node", "n", F.array(*[f"w{i}" for i in range(ODD_WORDS)]).alias("odd"))


def joined(
    each: DataFrame,
    entries_: DataFrame,
    near: Callable[[Column, Column], Column],
    verified: Callable[[DataFrame], DataFrame],
    finer: Callable[[DataFrame], tuple[DataFrame, Callable[[Column, Column], Column], Callable[[DataFrame], DataFrame]]],
    known: DataFrame | None = None,
    begun: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(a, b) of similar nodes that share a key of entries_ (key, node): enough pairs to join all that are.

    each has a ``light`` column for each node, by which ``near`` rules most other pairs out; ``verified`` gives those
    of the pairs (a, b) that are similar. Every node meets the leaders of its keys; those of one leader that stay apart
    meet each other once, however many keys they share. ``finer`` gives, for the nodes (node) of these, a larger
    ``light``, the test that goes with it and the comparison of their pairs. Hot leaders are left to adaptive execution,
    which splits them. ``known`` may give similar pairs that were found before; then every node first meets the leader
    that shares buckets with the most others only, and of the other leaders those that aren't joined with it. ``begun``
    may give, for the nodes (node) that share a key, their rows of each; all comparisons are between these.
    """
    sizes = written(entries_.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    sized = among(entries_, sizes, "key").join(sizes, "key")
    weighed = written(sized.groupBy("node").agg(F.collect_list("key").alias("keys"), F.sum("size").alias("weight")), "weighed")
    members = weighed.select("node", "weight", F.explode("keys").alias("key"))
    leaders = members.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("first"))
    led = written(members.select("key", "node").join(leaders, "key").where("first != node").select("first", "node").distinct(), "led")
    met = led.select(F.col("first").alias("a"), F.col("node").alias("b"))
    lights = (each if begun is None else begun(weighed.select("node"))).select("node", "light")
    if known is not None:
        met = _apart(met, components(known))
    both = met.join(lights.toDF("a", "light_a"), "a").join(lights.toDF("b", "light_b"), "b")
    chosen = written(both.where(near(F.col("light_a"), F.col("light_b"))).select("a", "b"), "near-leaders")
    if known is None:
        out = written(verified(chosen), "links")
    else:
        heavy = chosen.join(weighed.select(F.col("node").alias("a"), "weight"), "a")
        best = written(heavy.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).select("a", "b"), "near-best")
        out = written(known.unionByName(verified(best)), "links")
        others = _apart(chosen.join(best, ["a", "b"], "left_anti"), components(out))
        out = written(out.unionByName(verified(written(others, "near-others"))), "links")
    # every node has met its leaders; what is left are those of one leader that lie in different components
    rooted = led.join(components(out), "node", "left").select("first", "node", F.coalesce("root", "node").alias("root"))
    by = Window.partitionBy("first")
    opened = rooted.select("first", "node", "root", F.min("root").over(by).alias("low"), F.max("root").over(by).alias("high"))
    left = written(opened.where("low != high").select("first", "node", "root"), "open")
    fine, close_, verified_ = finer(written(left.select("node").distinct(), "open-nodes"))
    left = left.join(fine.select("node", "light"), "node")
    x, y = (left.select(*[F.col(c).alias(f"{c}_{t}") for c in ("first", "node", "root", "light")]) for t in "ab")
    apart = (F.col("first_a") == F.col("first_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = x.join(y, apart & close_(F.col("light_a"), F.col("light_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return written(out.unionByName(verified_(written(pairs, "near-rest"))), "links")


def _places(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """(row, id, lines) of every row; lines has (at, k1, k2) of each line with a word, at counting all lines from 0."""
    split = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")
    lines = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("at"), F.when(x.rlike(r"\S"), F.xxhash64(x)).alias("k1"), F.xxhash64(F.lit(7), x).alias("k2"))), lambda x: x["k1"].isNotNull())
    return docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), lines.alias("lines"))


def find(docs: DataFrame, places: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(row, at, component, kept) of each line with a word that has an equal or similar line elsewhere. places are those of docs."""
    lines = lines_of(docs, text_col)
    each = written(nodes(lines), "line-nodes")
    sizes = each.agg(F.count("*").alias("nodes"), F.sum("n").alias("lines")).first()
    total = sizes["lines"] or 0

    sharing: list[DataFrame] = []  # (node, light) and (node, line) of the lines that share a key

    def begun(ends: DataFrame) -> DataFrame:
        number = F.xxhash64("node").alias("number")
        few = written(among(each.select("*", number), ends.select(number), "number").drop("number").join(ends, "node"), "sharing")
        # one of each line's copies, taken in each task before any is shuffled
        texts = among(lines, few, "k1").groupBy("k1", "k2").agg(F.min("line").alias("line")).join(few.select("node", "k1", "k2"), ["k1", "k2"])
        sharing.extend([few.select("node", light), written(texts.select("node", "line"), "line-texts")])
        return sharing[0]

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sharing[1].toDF("a", "x"), "a").join(sharing[1].toDF("b", "y"), "b")
        # rows of their own, not a function of the pair: the shingles are made once and met by compiled code
        sets = both.select("a", "b", F.explode(F.array(F.struct(hashed(F.col("x")).alias("x"), hashed(F.col("y")).alias("y")))).alias("sets"))
        return sets.where(_similar(F.col("sets.x"), F.col("sets.y"), similarity)).select("a", "b")

    def near(x: Column, y: Column) -> Column:
        return sum((F.when(x[j] == y[j], 1).otherwise(0) for j in range(1, PERMUTATIONS)), F.when(x[0] == y[0], 1).otherwise(0)) >= AGREED

    light = F.array(*[f"m{j}" for j in range(PERMUTATIONS)]).alias("light")

    def finer(ends: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], Column], Callable[[DataFrame], DataFrame]]:
        minima, texts = (x.join(ends, "node") for x in sharing)
        fine = written(minima.join(sketches(texts), "node").select("node", F.struct("n", "odd", F.col("light").alias("minima")).alias("light")), "sketches")
        return fine, lambda x, y: close(x, y, similarity) & near(x["minima"], y["minima"]), verified

    roots = components(joined(each, entries(each), near, verified, finer, begun=begun))
    groups = each.select("node", "k1", "k2", "n").join(roots, "node", "left").where("n > 1 or root is not null")
    groups = written(groups.select("k1", "k2", "n", F.coalesce("root", "node").alias("component")), "line-groups")
    placed = places.select("row", "id", F.explode("lines").alias("x")).select("row", "id", "x.at", "x.k1", "x.k2")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at").alias("place")
    placed = written(among(placed, groups, "k1"), "placed")
    held = written(attach(placed, groups, ["k1", "k2"], "n", total).select(at, "component"), "copies")
    whole = written(held.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("size")), "firsts")
    out = attach(held, whole, ["component"], "size", held.count())
    return out.select("place.row", "place.at", "component", F.col("place").eqNullSafe(F.col("first")).alias("kept"))


def _gone(found: DataFrame) -> DataFrame:
    """(row, drop): the sorted numbers of the lines that go, of each row that has any."""
    return found.where(~F.col("kept")).groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns and rows kept, with text without the lines that go.

    Of a component of lines the first one by (id, row, line number) stays; null ids come last, and rows that share an
    id, or have none, are documents of their own: a repeated row loses its lines to the first of them. Null texts stay
    null, empty ones empty; blank lines are left alone. Lines are read whole, however long. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    with scratch(spark):
        keyed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered", keep=True)
        flat = keyed.select(F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"), "number")
        places = written(_places(flat, "id", "text", F.col("number")), "places")
        gone = written(_gone(find(flat, places, "text", similarity)), "gone", keep=True)
    both = keyed.join(gone.withColumnRenamed("row", "gone_row"), F.col("number") == F.col("gone_row"), "left")
    text = F.col(f"row.`{text_col}`")
    clean = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("drop"), i)), "\n"))
    return both.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_lines, n_dropped, dropped) of every row: its lines with a word, and how many and which of them ``drop_lines`` drops."""
    with scratch(docs.sparkSession):
        places = written(_places(docs, id_col, text_col, F.monotonically_increasing_id()), "places", keep=True)
        gone = written(_gone(find(docs, places, text_col, similarity)), "gone", keep=True)
    out = places.select("row", "id", F.size("lines").cast("long").alias("n_lines")).join(gone, "row", "left")
    drop = F.coalesce("drop", F.array().cast("array<int>"))
    return out.select("id", "n_lines", F.size(drop).cast("long").alias("n_dropped"), drop.alias("dropped"))
