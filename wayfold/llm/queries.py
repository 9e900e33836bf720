"""The opN_<name> queries: each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, exact_dedup, fuzzy_lines, langid, license_scan, packing, quality, quality_rules, simhash, url_filter
from wayfold.llm.common import checkpointed, read

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def op2_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "page_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        langid.held_out("doc_id", 4, 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents")).withColumn("sure", license_scan.confirmed())
    return found.select(
        F.col("id").alias("doc_id"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("sure", lambda s: s["family"]))), ",").alias("families"),
        F.size("sure").cast("long").alias("n_confirmed"),
        F.size("spans").cast("long").alias("n_predicted"),
        F.array_max(F.transform("spans", lambda s: s["probability"])).alias("best_probability"),
        F.transform("sure", lambda s: s["paragraph"]).alias("paragraphs"),
    )


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.cut(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))

    small = pieces.select("id", "piece", "start", "length", "at", "seq", F.crc32("ids").alias("ids_crc32"))
    out = packing.place(checkpointed(small))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.report(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op10_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_association_rules": op2_association_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pu_quality": op4_pu_quality,
    "op5_license_scan": op5_license_scan,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_output_codes": op7_output_codes,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_likelihood_ratio": op9_likelihood_ratio,
    "op10_extendible_hash": op10_extendible_hash,
}

ORACLES: dict[str, str] = {
    "op10_extendible_hash": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
}
