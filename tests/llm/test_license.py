import itertools
import textwrap
from collections import Counter

from wayfold.llm import license_scan
from wayfold.llm.common import read

PLANTED = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


def test_notices_and_others():
    model = license_scan.train()
    for family, texts in license_scan.NOTICES.items():
        for text in texts:
            (found,) = license_scan.find(f"Ein Satz mit Wort.\n{text}\n", model)
            assert found[0] == 1 and found[3] == family and found[5] == 1.0
    for text in license_scan.OTHERS:
        assert not [x for x in license_scan.find(text, model) if x[5] >= license_scan.CONTAINED]


def test_no_known_bigram_is_unknown():
    assert license_scan.grams("see the mit license".split()) == ["see the", "the mit", "mit license", "see the mit", "the mit license", "see the mit license"]
    model = license_scan.train()
    p = model.probabilities(["no", "notice"])
    assert p.argmax() == len(p) - 1 and not model.close(["no", "notice"]) and model.close("by the mit license".split())


#: Notices in words of their own: none is among the module's.
OTHER_WORDS = {
    "This file is licensed under version 2.0 of the Apache License.": "Apache-2.0",
    "The code in this repository is MIT licensed, see the MIT license file.": "MIT",
    "Distributed under the BSD license, 3-clause.": "BSD",
    "This is free software under the GNU General Public License v2.": "GPL",
    "Content is available under Creative Commons Attribution-ShareAlike 4.0.": "CC-BY-SA",
    "Text: CC BY-SA 4.0 unless noted.": "CC-BY-SA",
    "Photos are CC BY 4.0.": "CC-BY",
    "Figures may be used under CC BY-NC 4.0 only.": "CC-BY-NC",
    "No rights reserved: released under the CC0 license.": "CC0",
    "Covered by the Mozilla Public License version 2.0.": "MPL-2.0",
    "GNU Lesser General Public License v3 applies.": "LGPL",
    **PLANTED,
}


def test_held_out_notices_and_calibration(spark):
    """On notices that aren't in the training set and on ordinary lines: the family is right, unknown lines are told, and probabilities mean what they say."""
    assert not set(OTHER_WORDS) & {t for texts in license_scan.NOTICES.values() for t in texts}
    model = license_scan.train()
    judged = [(model.probabilities(license_scan.tokens(t)), f) for t, f in OTHER_WORDS.items()]
    assert sum(model.families[p.argmax()] == f for p, f in judged) >= 0.9 * len(judged)
    docs = read(spark, "/root/testdata/sf0.001", "documents").collect()
    lines = [x for r in docs for x in (r["text"] or "").split("\n") if x.strip() and x not in PLANTED][:2000]
    unknown = [(model.probabilities(license_scan.tokens(x)), license_scan.UNKNOWN) for x in lines]
    assert sum(p.argmax() == len(p) - 1 for p, _ in unknown) >= 0.99 * len(unknown)
    sample = judged + unknown[: len(judged)]
    top = [(p.max(), model.families[p.argmax()] == f) for p, f in sample]
    assert abs(sum(p for p, _ in top) - sum(hit for _, hit in top)) <= 0.12 * len(top)


def test_notices_left_out_of_training():
    """A notice that is skipped in training is still told by the others of its family."""
    skipped = {f: next(t for t in texts if t.startswith(("under", "Licensed under"))) for f, texts in license_scan.NOTICES.items() if f in ("Apache-2.0", "MIT", "BSD", "GPL", "LGPL")}
    model = license_scan.train(frozenset(skipped.values()))
    for family, text in skipped.items():
        p = model.probabilities(license_scan.tokens(text))
        assert model.families[p[:-1].argmax()] == family
    license_scan.train.cache_clear()


def test_planted_lines(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = Counter((r["id"], s["paragraph"], s["family"]) for r in license_scan.scan(docs).select("id", license_scan.confirmed().alias("spans")).collect() for s in r["spans"])
    want = Counter((r["doc_id"], i, PLANTED[x]) for r in docs.collect() for i, x in enumerate((r["text"] or "").split("\n")) if x in PLANTED)
    assert want and not want - got
    assert sum((got - want).values()) <= 0.02 * sum(want.values())


def test_odd_rows(docs, rows, empty):
    assert license_scan.scan(docs).count() == len(rows)
    assert license_scan.scan(empty).count() == 0
    text = "x\n" * 3 + "Released under the MIT License."
    (found,) = license_scan.find(text, license_scan.train())
    assert text[found[1] : found[2]] == "Released under the MIT License."


def test_wrapped_notices():
    model = license_scan.train()
    for family, texts in license_scan.NOTICES.items():
        for text in texts:
            for width, mark in itertools.product((30, 60, 64, 68, 72, 76, 80), ("", "# ", " * ", "// ", "REM ")):
                lines = textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False)
                page = ["Copyright 2020 by the authors.", *lines, "Ein Satz mit Wort."]
                whole = "import x\n\n" + "\n".join(mark + x for x in page) + "\n\nend"
                sure = [x for x in license_scan.find(whole, model) if x[5] >= license_scan.CONTAINED]
                assert {x[3] for x in sure} == {family}, (text, width, mark, sure)
                if len(sure) == 1 and sure[0][5] == 1.0:
                    found = sure[0]
                    assert found[0] in range(3, 3 + len(lines)) and whole[found[1] : found[2]].count("\n") < len(lines)


def test_lines_across_a_blank_one_are_no_notice():
    model = license_scan.train()
    for gap in ("", "  ", " * ", "REM"):
        text = f"Permission is hereby granted, free of charge, to any person\n{gap}\nobtaining a copy of this software and associated documentation files, to deal in it without restriction"
        assert not [x for x in license_scan.find(text, model) if x[5] >= license_scan.CONTAINED]
