import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline as pipeline
import numpy as np

from wayfold.llm import fuzzy_lines, simhash

DATA = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def plain_staying(rows):
    """Ids of the first row of each component, by comparing all pairs that share a shingle."""
    own, having, root = [plain_shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(own):
        for g in s:
            having[g].append(k)
    for a, b in {p for ks in having.values() for p in combinations(ks, 2)}:
        if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted(least.values())


def test_near_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").dropDuplicates(["text"])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = pipeline.near_stage(spark, docs, DATA)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == plain_staying(rows)


def test_near_stage_on_changed_copies(spark):
    rnd, texts = random.Random(7), []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(3, 200))]
        texts.append(" ".join(words + passage))
        for changes in (1, 2, 4, 8):
            new = list(words)
            for _ in range(changes):
                new[rnd.randrange(len(new))] = f"c{rnd.randrange(5000)}"
            texts.append(" ".join(new + passage if rnd.random() < 0.5 else new).upper())
    texts += ["", " \n", "one two", "ONE  two", "three"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in pipeline.near_stage(spark, docs, DATA).collect()) == plain_staying(rows)


def test_repeated_and_null_rows(docs, rows, empty):
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == plain_staying([(r[0], r[1]) for r in rows if r[0] is not None])
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_prefixes_of_similar_sets_meet():
    rnd = np.random.default_rng(2)
    for n in range(1, 60):
        own = np.unique(rnd.integers(-(2**62), 2**62, n))
        other = np.sort(rnd.permutation(own)[: int(np.ceil(0.8 * n))])
        common = np.sort(rnd.permutation(own)[: n // 2])
        assert np.intersect1d(simhash.prefix(own, common), simhash.prefix(other, common)).size


def test_similar_sets_have_near_fingerprints():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 5, 9, 20, 80, 2000):
        for _ in range(300):
            own = np.unique(rnd.integers(-(2**62), 2**62, n))
            new = n // 9
            other = np.concatenate([rnd.permutation(own)[: n - new], rnd.integers(-(2**62), 2**62, new)])
            assert ((simhash.majority(own) ^ simhash.majority(other)) & (2**64 - 1)).bit_count() <= simhash.WIDE


def test_near_stage_begins_with_the_pigeonhole(spark, monkeypatch):
    """Texts within three bits are linked through fingerprint parts, before any shingle is probed."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words[:-1], f"z{k}"])) for k in range(6)] + [(9, "something else altogether, said once")]
    docs, planned, plan = spark.createDataFrame(rows, "doc_id long, text string"), [], simhash.plan
    monkeypatch.setattr(simhash, "plan", lambda *a: planned.append(plan(*a)) or planned[-1])
    found = []
    seeds = simhash.seeds
    monkeypatch.setattr(simhash, "seeds", lambda each: found.append(seeds(each)) or found[-1])
    assert sorted(r["doc_id"] for r in pipeline.near_stage(spark, docs, DATA).collect()) == [0, 9]
    assert planned and sum(t + 1 for _, t in planned[0]) == simhash.TAU + 1 and len(found) == 1


def test_similar_sets_have_near_wide_fingerprints():
    rnd = np.random.default_rng(6)
    bits = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    wide = lambda own: (simhash.majority(own), *simhash.more(own))
    for n in (1, 2, 5, 8, 9, 20, 80, 600):
        for _ in range(150):
            own = np.unique(rnd.integers(-(2**62), 2**62, n))
            new = n // 9
            other = np.unique(np.concatenate([rnd.permutation(own)[: n - new], rnd.integers(-(2**62), 2**62, new)]))
            part = np.sort(rnd.permutation(own)[: int(np.ceil(0.8 * n))])
            assert bits(wide(own), wide(other)) <= simhash.FAR and bits(wide(own), wide(part)) <= simhash.FAR


def test_copies_that_stay_apart_meet_once(spark, monkeypatch):
    """Changed copies of one text share many keys; they are listed by leader, and those that can't be similar aren't compared."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(base)]
    for k in range(40):
        new = list(base)
        for at in rnd.sample(range(400), 22):
            new[at] = f"c{k}x{at}"
        texts.append(" ".join(new))
        if k % 8 == 0:
            texts.append(" ".join([*new[:-3], "other"]))
    made, plain = {}, fuzzy_lines.written

    def counted(df, tag, keep=False):
        out = plain(df, tag, keep)
        made[tag] = out.count() if tag in ("open", "near-rest") else 0
        return out

    monkeypatch.setattr(fuzzy_lines, "written", counted)
    monkeypatch.setattr(simhash, "_common", lambda *_: np.array([], dtype=np.int64))  # any order is exact; by hash alone the copies share many keys
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.near_stage(spark, docs, DATA).collect()) == plain_staying(rows)
    assert made["open"] <= 10 * len(rows) and made["near-rest"] <= len(rows), made


def test_odd_sketches_differ_in_no_more_than_the_sets():
    rnd = np.random.default_rng(8)
    for n in (1, 5, 40, 700, 5000):
        own = np.unique(rnd.integers(-(2**62), 2**62, n))
        other = np.unique(np.concatenate([rnd.permutation(own)[: n - n // 5], rnd.integers(-(2**62), 2**62, n // 5)]))
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(simhash.odd(own), simhash.odd(other), strict=True))
        assert bits <= len(np.setxor1d(own, other)) and len(simhash.odd(own)) == fuzzy_lines.ODD_WORDS
