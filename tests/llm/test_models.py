import zlib
from collections import Counter

import numpy as np

from wayfold.llm import langid, quality

DATA = "/root/testdata/sf0.01"


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_codewords():
    for n in (2, 3, 4, 7, 12):
        code = langid.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= (code.shape[1] + 1) // 2 - (n > 7) * code.shape[1] // 4
    assert langid.codewords(0).shape == (0, 0) and langid.codewords(1).shape == (1, 0)


def test_decoding_corrects_one_wrong_bit():
    model = langid.Model(["a", "b", "c", "d"], langid.codewords(4), np.zeros((1 << langid.DIM_BITS, 7)), np.ones(7), np.zeros(7))
    for i, word in enumerate(model.code):
        margins = 3 * word
        margins[i] = -margins[i]
        assert model.decode(margins).argmax() == i
    assert abs(model.decode(np.zeros(7)).max() - 0.25) < 1e-9


def test_blocks_give_the_same_trigrams(monkeypatch):
    text = "Één straße, two  words! " * 20
    whole = np.concatenate(list(langid.trigrams(text)))
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.array_equal(np.concatenate(list(langid.trigrams(text))), whole)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.identify(docs, langid.train(docs)).collect()
    held = [r for r in out if fold(r["doc_id"], 3) == 1]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in out)


def test_language_of_odd_rows(spark, docs, empty):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !! 7", "en"), (4, "the thing " * 99, "en"), (5, "les choses " * 99, "fr"), (None, "der das " * 99, None), (4, "the thing " * 99, "en")], "doc_id long, text string, lang string")
    model = langid.fit(["the thing and that", "les choses et que"], ["en", "fr"])
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, model).collect())
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == 1 and got[(4, "en")] == 2 and got[(5, "fr")] == 1
    assert langid.identify(docs, langid.train(docs)).count() == docs.count()
    none = langid.train(empty)
    assert langid.identify(empty, none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_quality_accuracy_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    out = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    assert len(out) == docs.count() and all(0 <= s <= 1 for s in out.values())
    held = [(out[r["doc_id"]], r["quality"]) for r in labels.collect() if fold(r["doc_id"], 4) == 2]
    assert np.mean([(s >= quality.THRESHOLD) == (y == 1) for s, y in held]) > 0.95


def test_features_in_blocks(monkeypatch):
    data = ("Ünd so WEITER weiter weiter!! | 12 #\n" * 30).encode()
    whole = quality.features(data)
    monkeypatch.setattr(quality, "BLOCK", 11)
    assert np.allclose(quality.features(data), whole)
    assert len(quality.features(b"")) == len(quality.FEATURES)


def test_prior_without_negatives():
    rnd = np.random.default_rng(0)
    clean = lambda n: rnd.normal(0, 1, (n, 3))
    mixed = np.concatenate([clean(3500), rnd.normal(6, 1, (1500, 3))])
    for prior in (0.7, None):
        model = quality.fit(clean(3000), mixed, prior)
        s = model.score(mixed)
        assert (s[:3500] >= 0.5).mean() > 0.95 and (s[3500:] < 0.5).mean() > 0.95


def test_estimated_prior():
    """The prior comes from positives and unlabelled rows alone, near the true share at every share."""
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.5, 0.7, 0.9):
        n = int(4000 * share)
        mixed = np.concatenate([rnd.normal(0, 1, (n, 3)), rnd.normal(4, 1, (4000 - n, 3))])
        assert abs(quality.estimated_prior(rnd.normal(0, 1, (2000, 3)), mixed) - share) < 0.08


def test_prior_of_the_corpus(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: quality.features((r["text"] or "").encode()) for r in docs.collect()}
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = np.array([text[i] for i, y in told.items() if y == 1 and fold(i, 4) != 2])
    prior = quality.estimated_prior(good, np.array([x for i, x in text.items() if fold(i, 4) != 2]))
    assert abs(prior - np.mean(list(told.values()))) < 0.1


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id that many rows repeat brings no more than the sample."""
    docs = spark.createDataFrame([(1, f"a text of number {i} and more") for i in range(300)] + [(i, "other words") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda *x: sizes.extend(map(len, x)) or quality.Model([], [], 0.0))
    quality.train(docs, labels, sample=40)
    assert max(sizes) <= 40 and sizes[0] > 0


def test_long_texts_of_a_language_are_learned(spark):
    """A language whose texts are all very long is learned like any other."""
    rows = [(i, "les choses et que nous avons dit " * 4000, "fr") for i in range(9)] + [(100 + i, f"the thing and that {i} we said", "en") for i in range(30)]
    docs = spark.createDataFrame([(i, t + str(i), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["en", "fr"] and model.predict("nous avons dit que les choses")[0] == "fr"


def test_training_equals_the_local_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, sample=10**9)
    rows = sorted({(r["text"], r["lang"]) for r in docs.collect() if r["text"] and langid._LETTER.search(r["text"]) and r["lang"] and fold(r["doc_id"], 3) != 1})
    plain = langid.fit([t for t, _ in rows], [x for _, x in rows])
    assert model.languages == plain.languages and np.array_equal(model.weights, plain.weights)
    assert np.allclose(model.scale, plain.scale) and np.allclose(model.offset, plain.offset)


def test_names_that_are_taken_stay(spark):
    docs = spark.createDataFrame([(1, "the thing and that", "mine", 0.5, "x")], "doc_id long, text string, lang_pred string, Quality_Score double, `a.b` string")
    out = langid.identify(docs, langid.fit(["the thing and that", "les choses et que"], ["en", "fr"]))
    assert out.columns == [*docs.columns, "lang_pred_2", "lang_score", "lang_ambiguous"]
    assert out.first()["lang_pred"] == "mine" and out.first()["lang_pred_2"] == "en"
    out = quality.score(docs, quality.Model([], [], 0.0))
    assert out.columns == [*docs.columns, "quality_score_2"] and out.first()["quality_score_2"] == 0.5


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = [r["quality_score"] for r in quality.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    blank = quality.train(empty, labels.limit(0))
    assert quality.score(empty, blank).count() == 0
    assert {r["quality_score"] for r in quality.score(docs, blank).collect()} == {0.5}
