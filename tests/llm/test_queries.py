"""Each query's columns, types and rows as its contract has them, and odd tables through every operator and stage."""

import re
import zlib

import corpus_pipeline as pipeline
import pytest

from wayfold.llm import bpe, exact_dedup, fuzzy_lines, langid, license_scan, packing, quality, quality_rules, queries, simhash, url_filter

DATA = "/root/testdata/sf0.001"
TYPES = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_association_rules": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_pu_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_license_scan": {"doc_id": "bigint", "families": "string", "n_confirmed": "bigint"},
    "op6_best_two_fit": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_output_codes": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_fuzzy_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "dropped": "array<int>"},
    "op9_likelihood_ratio": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_extendible_hash": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
}


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_contract(spark, documents, name):
    df = queries.QUERIES[name](spark, DATA)
    found = dict(df.dtypes)
    assert {c: found[c] for c in TYPES[name]} == TYPES[name]
    rows = df.collect()
    ids = [r["page_id" if name == "op2_association_rules" else "doc_id"] for r in rows]
    if name == "op2_association_rules":
        assert sorted(ids) == sorted(r["page_id"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect())
        assert {r["verdict"] for r in rows} <= {"allow", "block"}
        return
    assert set(ids) == set(documents)
    if name != "op6_best_two_fit":
        assert len(ids) == len(documents)
    if name == "op1_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows)
    if name == "op4_pu_quality":
        assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name == "op7_output_codes":
        assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
        assert {r["lang_pred"] for r in rows} <= {d["lang"] for d in documents.values()} | {"und"}
    if name == "op6_best_two_fit":
        at = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == at.get(r["sequence_id"], 0)
            at[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(at.values()) <= 4096
        assert len(at) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    if name == "op10_extendible_hash":
        assert sum(r["kept"] for r in rows) == len({d["text"] or "" for d in documents.values()})


#: Columns with dots, spaces and the names that operators use for their own.
SCHEMA = "`doc.id` long, `the text` string, lang string, `a.b` string, row string, id string, quality_score string, lang_pred long, fp long, n long, key string, kept string, h long, sha string, node long, number long"


@pytest.fixture(scope="module")
def odd(spark):
    more = ("en", "q", "r", "s", "t", 5, 6, 7, "k", "x", 8, "y", 9, 10)
    texts = ["the thing and that are in it and we said so " * 3, "the thing and that are in it and we said so " * 3, "", None, "les choses et que nous avons dit\n" * 4, "word " * 3000, "MIT", "under the MIT License"]
    rows = [(i, t, *more) for i, t in enumerate(texts)] + [(0, texts[0], *more), (None, None, *([None] * 14)), (None, texts[1], *more)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def _operators(spark):
    import public_tokenizers as p

    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (None, 1)], "`doc.id` long, quality int")
    i, t = "doc.id", "the text"
    return {
        "simhash": lambda d: simhash.near_duplicates(d, i, t),
        "simhash drop": lambda d: simhash.drop_near_duplicates(d, i, t),
        "bpe": lambda d: bpe.encode(d, p.path(queries.BYTE_RANKS), p.PATTERN, i, t),
        "quality": lambda d: quality.score(d, quality.train(d, labels, i, t), t),
        "license": lambda d: license_scan.scan(d, i, t),
        "packing": lambda d: packing.pack(d, p.path(queries.WORD_TOKENIZER), i, t),
        "langid": lambda d: langid.identify(d, langid.train(d, i, t), t),
        "lines": lambda d: fuzzy_lines.drop_lines(d, i, t),
        "lines report": lambda d: fuzzy_lines.report(d, i, t),
        "rules": lambda d: quality_rules.judge(d, labels.where("quality = 1"), i, t),
        "exact": lambda d: exact_dedup.duplicates(d, i, t),
        "exact drop": lambda d: exact_dedup.drop_duplicates(d, i, t),
        "url": lambda d: url_filter.judge(d, labels.withColumnRenamed("doc.id", "doc_id"), i, t),
    }


@pytest.mark.parametrize("name", ["simhash", "simhash drop", "bpe", "quality", "license", "packing", "langid", "lines", "lines report", "rules", "exact", "exact drop", "url"])
def test_clashing_and_dotted_columns(spark, odd, name):
    run = _operators(spark)[name]
    out = run(odd)
    n = len(out.collect())
    assert n == (6 if "drop" in name else 11) or (name, n) == ("packing", n)
    if name in ("simhash drop", "exact drop", "lines"):
        assert out.columns == odd.columns
    if name in ("quality", "langid"):
        assert out.columns[: len(odd.columns)] == odd.columns and len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_columns(spark, odd, name):
    docs = odd.drop("id").withColumnRenamed("doc.id", "doc_id").withColumnRenamed("the text", "text")
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, docs, DATA)
    rows = out.collect()
    if name != "best_fit_packing":
        assert out.columns == docs.columns and len(rows) <= 11
