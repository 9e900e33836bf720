import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from wayfold.llm import exact_dedup, simhash
from wayfold.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """Component (smallest id) of each (id, fingerprint) row, by comparing all."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            r = find(f)
            least[r] = min(least.get(r, i), i)
    return Counter((i, f, least.get(find(f))) for i, f in pairs)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"Wörd{i % 97}" for i in range(500))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    assert simhash.fingerprint(text.encode()) == whole
    assert simhash.fingerprint(b"a b") == plain_fingerprint("a b")


def test_near_duplicates(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert Counter((r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want


def test_links_find_all_pairs(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for flips in (1, 2, 3, 4):
            fps.add(int(b) ^ sum(1 << int(k) for k in rnd.choice(64, flips, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    mask = 2**64 - 1
    for parts in (
        simhash.plan(simhash.bit_counts(df), len(fps)),
        [(list(range(32)), 1), (list(range(32, 64)), 1)],
        [(list(range(0, 64, 2)), 3)],
        [(list(range(22)), 0), (list(range(22, 43)), 1), (list(range(43, 64)), 0)],
    ):
        assert sum(t + 1 for _, t in parts) == 4
        got = {tuple(sorted((r.a & mask, r.b & mask))) for r in simhash.links(df, parts).collect()}
        assert got == want


def test_plan_allots_by_cost():
    counts = np.full((64, 64), 250.0)
    np.fill_diagonal(counts, 500.0)
    assert len(simhash.plan(counts, 1000)) == 4
    assert [t for _, t in simhash.plan(counts * 10**8, 10**11)] == [1, 1]
    corr = np.eye(64)
    alike = list(range(3, 64, 4))
    corr[np.ix_(alike, alike)] = 0.9
    assert alike in simhash._group(corr, 4)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (100, 100), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(edges.limit(0)).count() == 0


def test_extendible_index_splits_and_chains():
    index = exact_dedup.ExtendibleIndex(capacity=4)
    for i in range(300):
        index.put(i * 7919, str(i).encode(), i, 1, 1)
    index.put(7919, b"other text of the same key", 5, 1, 1)
    index.put(7919, b"1", 9, 2, 1)
    assert index.depth > 4
    buckets = list(index.buckets())
    assert all(len(b.chains) <= 4 and all(k & ((1 << b.depth) - 1) == b.prefix for k in b.chains) for b in buckets)
    entries = {e.text: e for b in buckets for c in b.chains.values() for e in c}
    assert len(entries) == 301 and entries[b"1"].top == 9 and entries[b"1"].n == 3


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.duplicates(docs).collect()
    want = Counter((r[0], top[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_duplicates(docs, rows):
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    top = defaultdict(lambda: -1)
    for r in rows:
        top[r[1] or ""] = max(top[r[1] or ""], -1 if r[0] is None else r[0])
    assert sorted(got, key=str) == sorted(((i, t) for t, i in top.items()), key=str)


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert exact_dedup.duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0
