import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from wayfold.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = P.path("word_bpe_49k.json")
ODD = ["", "a" * 3000, "ab" * 5000, "é" * 999, " " * 50, "\n\n a", "x\x1cy z", " a b ", "it's  we'll\tgo\n 中文 12,5 　é—"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(open(RANKS, "rb").read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_batch(ranks, library):
    own, rnd = bpe.ByteBPE(ranks, P.PATTERN), random.Random(1)
    signs = "ab cde  \n\t éñ12!?'s 中 　é.—"
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for by_space in (True, False):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts, by_space)]
        assert got == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in got] == [t.encode() for t in texts]


def test_both_trees_agree(ranks):
    own, rnd = bpe.ByteBPE(ranks, P.PATTERN), random.Random(2)
    pieces = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 64))).encode() for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge_many(pieces)] == [own.merge_one(p) for p in pieces]


def test_full_tables_are_emptied(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "STALE", 0.6)
    own = bpe.ByteBPE(ranks, P.PATTERN)
    for t in ("one two three four five", "six  seven eight nine", "one ten"):
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == library.encode_ordinary(t)


def test_round_trip(docs, rows, empty, library):
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    got = sorted(((r["id"], list(r["ids"]), bytes(r["decoded"])) for r in out.collect()), key=str)
    assert got == sorted(((r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=str)
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def fill_one_by_one(lengths, size):
    """The same rule on single documents, for comparing the number of sequences."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        gap, bin_ = size, []
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        best = (bin_[-1], None)
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                if best[0] < a + b <= gap + bin_[-1]:
                    best = (a + b, (a, b))
        if best[1]:
            left.append(bin_.pop())
            for x in best[1]:
                left.remove(x)
                bin_.append(x)
            left.sort(reverse=True)
        bins.append(bin_)
    return bins


def test_best_two_fit():
    rnd = random.Random(5)
    for size, n in ((20, 60), (100, 150), (4096, 200)):
        lengths = [rnd.randint(1, size) for _ in range(n)]
        counts = defaultdict(int)
        for x in lengths:
            counts[x] += 1
        fillings = packing.best_two_fit(counts, size)
        used = defaultdict(int)
        for bin_, repeats in fillings:
            assert sum(bin_) <= size
            for x in bin_:
                used[x] += repeats
        assert used == counts
        got, plain = sum(r for _, r in fillings), len(fill_one_by_one(lengths, size))
        assert -(-sum(lengths) // size) <= got <= plain + 1
    assert packing.best_two_fit({10: 1, 6: 1, 5: 2, 4: 2}, 20)[0] == ([10, 6, 4], 1)
    assert sorted(packing.best_two_fit({9: 1, 8: 1, 7: 1, 4: 1, 5: 1}, 18)[0][0]) == [4, 5, 9]


def test_words_encoded_together(monkeypatch):
    data = open(TOKENIZER, "rb").read()
    library, own = packing.load_tokenizer(data), packing.Encoder(data)
    monkeypatch.setattr(packing, "JOINED", 7)
    odd = ["é", "e\u0301x", "\u0301a", "ﬁ", "İstanbul", "中文字", "A\u030a", "\u212b", "<|endoftext|>", "a<|startoftext|>b", "x\u00a0y", "\u2003", "don't", "१२", "👩\u200d👩", "\u1100\u1161\u11a8", "ſ", "\x1c", "\ufeff", "\u200b", "Ab,cd!!", "n\x00l", "\x00", "Σίσυφος", "DŽ"]
    texts = [*odd, " ".join(odd), "\n".join(odd * 3), ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in own([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack(docs, rows):
    tokenizer = packing.load_tokenizer(open(TOKENIZER, "rb").read())
    want = sorted((str(r[0]), [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    out = packing.pack(docs, TOKENIZER, size=256).collect()
    whole, places = defaultdict(list), defaultdict(list)
    for r in sorted(out, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(ids) <= 256 and r["start"] == 256 * r["piece"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["id"]] += ids
    ids = [r[0] for r in rows]
    once = [(i, w) for i, w in zip(map(str, ids), (whole[i] for i in ids)) if ids.count(None if i == "None" else int(i)) == 1]
    assert sorted(once) == [(i, w) for i, w in want if (i, w) in once]
    assert sum(len(w) for w in whole.values()) == sum(len(w) for _, w in want)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.02 * sum(len(w) for _, w in want) / 256 + 1


def test_pack_empty_table(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert zlib.crc32(b"") == 0
