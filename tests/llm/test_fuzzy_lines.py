import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfold.llm import common, fuzzy_lines


def plain_shingles(line, size=fuzzy_lines.SHINGLE):
    low = line.lower().encode("utf-16-be")
    return {low[2 * i : 2 * (i + size)] for i in range(max(1, len(low) // 2 - size + 1))}


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def plain_dropped(rows):
    """For each row the numbers of the lines that go, by comparing all different lines. A null id comes last."""
    places = defaultdict(list)
    for row, (i, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\x0b\x0c\r"):
                places[line].append((i is None, i or 0, row, at))
    lines = sorted(places)
    sets = [plain_shingles(x) for x in lines]
    root = {x: x for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(lines, sets, strict=True), 2):
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and similar(x, y):
            root[top(a)] = top(b)
    whole = defaultdict(list)
    for x in lines:
        whole[top(x)] += places[x]
    out = [[] for _ in rows]
    for found in whole.values():
        for _, _, row, at in sorted(found)[1:]:
            out[row].append(at)
    return [sorted(x) for x in out]


DIFFERENT = [
    ("https://www.example.com/article/1", "https://www.example.com/about-us"),
    ("id=000000000012345", "id=000000000999999"),
    ("今日は天気がとても良いですから散歩に行きます", "今日は天気がとても良いですが仕事があります"),
    ("see https://example.com/a/first/page for more", "see https://example.com/z/other/site for more"),
    ("a", "b"),
    ("𝒳" * 14 + " b", "𝒳" * 9 + "𝒴 d"),
]


LINES = [x for p in DIFFERENT for x in p] + ["two words", "twelve_chars", "thirteen_char", "x" * 40, "Fest 12345678901234 A", "aé" * 30, "q", "ab" * 6, "the quick brown fox jumps over the lazy dog"]


def hashes(spark, line):
    parts = [(bytearray(x),) for x in plain_shingles(line)]
    return {r["h"] for r in spark.createDataFrame(parts, "s binary").select(F.xxhash64("s").alias("h")).collect()}


def test_shingles_are_all_positions(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    for r in df.select("line", fuzzy_lines.hashed(F.col("line")).alias("sh")).collect():
        assert set(r["sh"]) == hashes(spark, r["line"]) and len(r["sh"]) == len(plain_shingles(r["line"]))


def test_minima_are_those_of_all_shingles(spark):
    """The minima taken four positions a row equal those over every position, one by one."""
    lines = [*LINES, LINES[0]]
    df = fuzzy_lines.lines_of(spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "text string"), "text")
    got = {r["k1"]: r for r in fuzzy_lines.nodes(df).collect()}
    assert len(got) == len(set(lines)) and sum(r["n"] for r in got.values()) == len(lines)
    orders = []
    for x in (F.col("h"), F.xxhash64("h", F.lit(1))):
        for mask in fuzzy_lines.MASKS:
            y = x.bitwiseXOR(F.lit(mask - (1 << 64) if mask >> 63 else mask))
            orders += [F.shiftright(y, 32), F.shiftright(F.shiftleft(y, 32), 32)]
    each = df.select("k1", F.explode(fuzzy_lines.hashed(F.col("line"))).alias("h"))
    for r in each.groupBy("k1").agg(*[F.min(c).alias(f"m{j}") for j, c in enumerate(orders)]).collect():
        assert [r[f"m{j}"] for j in range(fuzzy_lines.PERMUTATIONS)] == [got[r["k1"]][f"m{j}"] for j in range(fuzzy_lines.PERMUTATIONS)]


def test_different_lines_stay(spark):
    rows = [(i, "\n".join(pair)) for i, pair in enumerate(DIFFERENT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_dropped"] for r in fuzzy_lines.report(docs).collect()] == [0] * len(rows)


def test_recall_by_length(spark):
    """Of pairs of lines of a similarity of at least 0.8, most barely so, at every length, with the parameters in use."""
    assert fuzzy_lines.expected_recall() > 0.97
    rnd, pairs = random.Random(11), []
    letters = "abcdefghijklmnopqrstuvwxyz "
    for n in [*range(16, 60, 2), *range(60, 400, 20)]:
        for _ in range(30):
            line = "".join(rnd.choice(letters) for _ in range(n - 1)) + "."
            least = next(k for k in range(1, n + 1) if similar(plain_shingles(line), plain_shingles(line[-k:])) and k >= 0.8 * (n - 11))
            pairs.append((n, line, line[-least:]))
    rnd.shuffle(pairs)
    docs = spark.createDataFrame([(i, f"{a}\n{b}") for i, (_, a, b) in enumerate(pairs)], "doc_id long, text string")
    got = {r["id"]: r["n_dropped"] for r in fuzzy_lines.report(docs).collect()}
    found, all_ = Counter(), Counter()
    for i, (n, a, b) in enumerate(pairs):
        size = "few" if n < 32 else "some" if n < 60 else "many"
        all_[size] += 1
        found[size] += got[i]
    assert all(found[x] >= 0.92 * all_[x] for x in all_) and sum(found.values()) >= 0.95 * len(pairs), (found, all_)


@pytest.fixture(scope="module")
def line_rows():
    rnd = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ren", "tis", "mo") for c in ("lar", "ve", "sun", "x")]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    base = [line(rnd.randint(3, 40)) for _ in range(80)]
    family = line(40)
    texts = []
    for i in range(90):
        parts = [" ".join(rnd.choice(base)) for _ in range(rnd.randint(0, 4))]
        changed = list(rnd.choice(base))
        changed[rnd.randrange(len(changed))] = "changed"
        near = list(family)
        near[rnd.randrange(40)] = f"v{i}"
        parts += [" ".join(changed), "", " ".join(near), "short", "Fest 12345678901234 A" if i % 2 else "fest 12345678901234 b"]
        rnd.shuffle(parts)
        texts.append("\n".join(parts))
    return [*enumerate(texts), (500, None), (501, ""), (502, " \n\t"), (None, texts[0] + "\nonly here, in a row without an id"), (None, "first in a row without an id\n" + texts[1]), (0, texts[0])]


def test_lines_against_all_pairs(spark, line_rows):
    docs = spark.createDataFrame([(i, t, "z") for i, t in line_rows], "doc_id long, text string, line string")
    want = Counter((i, tuple(x)) for (i, _), x in zip(line_rows, plain_dropped(line_rows), strict=True))
    assert Counter((r["id"], tuple(r["dropped"])) for r in fuzzy_lines.report(docs).collect()) == want


def test_dropped_lines(spark, line_rows):
    docs = spark.createDataFrame([(i, t, "z", i) for i, t in line_rows], "`doc.id` long, text string, drop string, `row` long")
    out = fuzzy_lines.drop_lines(docs, "doc.id")
    assert out.columns == docs.columns
    clean = lambda t, gone: None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone)
    want = Counter((i, clean(t, gone), "z", i) for (i, t), gone in zip(line_rows, plain_dropped(line_rows), strict=True))
    assert Counter(tuple(r) for r in out.collect()) == want


def test_unique_lines_of_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "a line that stands twice in the table"), (None, "another line that stands only here"), (7, "a line that stands twice in the table")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in fuzzy_lines.drop_lines(docs).collect())
    assert got == Counter({(None, ""): 1, (None, "another line that stands only here"): 1, (7, "a line that stands twice in the table"): 1})


def test_empty_and_odd_rows(docs, rows, empty):
    assert fuzzy_lines.report(empty).count() == 0 and fuzzy_lines.drop_lines(empty).columns == empty.columns
    assert fuzzy_lines.report(docs).count() == len(rows)


def test_changed_copies_of_a_line_are_compared_where_they_may_be_similar(spark, monkeypatch):
    """Copies that are similar neither to their line nor to each other aren't compared pair by pair, and those that are lose no link."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 8)))
    base, copies = [word() for _ in range(60)], []
    for k in range(60):
        new = list(base)
        for at in rnd.sample(range(60), 5):
            new[at] = word()
        copies.append(" ".join(new))
        if k % 10 == 0:
            copies.append(" ".join([*new[:-1], word()]))
    rows = [(i, x) for i, x in enumerate([" ".join(base), *copies])]
    made, plain = {}, fuzzy_lines.written

    def counted(df, tag, keep=False):
        out = plain(df, tag, keep)
        made[tag] = out.count() if tag == "near-rest" else 0
        return out

    monkeypatch.setattr(fuzzy_lines, "written", counted)
    out = fuzzy_lines.report(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter((i, tuple(x)) for (i, _), x in zip(rows, plain_dropped(rows), strict=True))
    assert Counter((r["id"], tuple(r["dropped"])) for r in out.collect()) == want
    assert sum(len(x) for _, x in want) >= 6 and made["near-rest"] <= 60, made


def test_texts_are_fetched_once(spark, line_rows, monkeypatch):
    """One text of each line that shares a key, however many copies it has, in one pass over the documents."""
    made, plain = defaultdict(list), fuzzy_lines.written

    def counted(df, tag, keep=False):
        out = plain(df, tag, keep)
        made[tag].append(out.count() if tag in ("line-texts", "weighed") else 0)
        return out

    monkeypatch.setattr(fuzzy_lines, "written", counted)
    fuzzy_lines.report(spark.createDataFrame([(i, t) for i, t in line_rows], "doc_id long, text string"))
    assert len(made["line-texts"]) == 1 and made["line-texts"] == made["weighed"] and made["weighed"][0] > 80, made


def test_similarity_at_the_threshold(spark):
    """As by whole numbers, for every size of two sets together up to 40."""
    cases = [(list(range(same + (all_ - same) // 2)), [*range(same), *range(same + (all_ - same) // 2, all_)], same, all_) for all_ in range(1, 41) for same in range(all_ // 2, all_ + 1)]
    df = spark.createDataFrame(cases, "x array<long>, y array<long>, same long, whole long")
    for r in df.select("same", "whole", fuzzy_lines._similar(F.col("x"), F.col("y"), 0.8).alias("found")).collect():
        assert r["found"] == (5 * r["same"] >= 4 * r["whole"]), r


def test_odd_sketches(spark):
    """As made one by one; two of them differ in no more bits than their sets do in elements."""
    df = spark.createDataFrame([*enumerate(LINES)], "node long, line string")
    got = {r["node"]: r for r in fuzzy_lines.sketches(df).collect()}
    for i, line in enumerate(LINES):
        words = [0] * fuzzy_lines.ODD_WORDS
        for h in hashes(spark, line):
            words[h >> 6 & (fuzzy_lines.ODD_WORDS - 1)] ^= 1 << (h & 63)
        assert got[i]["n"] == len(plain_shingles(line)) and [x & (2**64 - 1) for x in got[i]["odd"]] == words
    for i, j in itertools.combinations(got, 2):
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(got[i]["odd"], got[j]["odd"], strict=True))
        assert bits <= len(plain_shingles(LINES[i]) ^ plain_shingles(LINES[j]))


def test_among_keeps_every_row_with_a_match(spark):
    keys = [0, 1, -1, 63, 64, -64, 2**63 - 1, -(2**63), 5 << 40, (5 << 40) + 1]
    left = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, *range(1000, 3000)])], "k long, i long")
    got = common.among(left, spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert got.columns == left.columns
    rows = sorted(r["k"] for r in got.collect())
    assert rows == sorted(keys)
