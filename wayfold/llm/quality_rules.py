"""Quality rules, in DataFrame functions only: counts over each text, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS; the multinomials of trusted texts and of the whole corpus, both with
add-one smoothing, give each bucket a log ratio; the raw counts cover every text. A text's mean ratio over its n-grams
is compared with a threshold that follows from the ratios of trusted texts that weren't counted as such, and so from
the two distributions at any size of the corpus.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import scratch, written

BUCKETS = 1 << 16
#: The threshold: this quantile of the trusted ratios, lowered by MARGIN times its distance to their median.
QUANTILE, MARGIN = 0.001, 0.1
LEAST_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _with_words(docs: DataFrame, text_col: str, keep: list[str] | None, id_col: str) -> DataFrame:
    """docs' columns ``keep`` (all, if None) as one struct column ``row``, and the id, text and words."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    d = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return d.withColumn("words", words_of(F.col("text")))


def _buckets(words: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    last = F.size(words) - 2
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.when(last >= 0, F.concat(single, pairs)).otherwise(single)


def base_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(row, id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    n_repeat_words: the starts of 3-word windows whose hash occurs again in the text are found by sorting
    (hash, start); the words they cover are counted from the gaps between starts.
    """
    d = _with_words(docs, text_col, keep, id_col)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NO_SPACE))
    starts = F.sequence(F.lit(0), F.size("words") - 3)
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(
        "row",
        "id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") >= 3, F.sort_array(F.transform(starts, window))).otherwise(none).alias("windows"),
    )
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = F.filter("windows", lambda x, j: same(x, F.get("windows", j - 1)) | same(x, F.get("windows", j + 1)))
    d = d.select(
        "row", "id", "words", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda x: x["i"])).alias("repeats"),
    )
    covered = F.transform("repeats", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("repeats", k + 1) - i, F.lit(3))))
    return d.select("row", "id", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """base_counts with ``id`` and ``grams``, the buckets of all n-grams, as a table: each text is taken apart once. Of docs' columns only ``keep`` stay in row."""
    d = base_counts(docs, text_col, keep, id_col).withColumn("grams", _buckets(F.col("words"), buckets))
    return written(d.drop("words"), "measured", keep=True)


def _chosen(trusted: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """(trusted_id, half) of the different trusted ids, 0 for the counts, 1 for the threshold: all of them, or with a limit those of least hash."""
    ids = trusted.select(F.col(f"`{id_col}`").cast("long").alias("trusted_id")).where("trusted_id is not null").distinct()
    if limit is not None:
        ids = ids.orderBy(F.xxhash64("trusted_id", F.lit(31)), "trusted_id").limit(limit)
    return ids.select("trusted_id", F.pmod(F.xxhash64("trusted_id", F.lit(32)), F.lit(2)).cast("int").alias("half"))


def halves(measures: DataFrame, chosen: DataFrame) -> DataFrame:
    """measures with the ``half`` of their ids, null for others. The ids are broadcast as bits, 64 neighbours a row, so that no text's n-grams are shuffled."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trusted_id").bitwiseAND(F.lit(63)).cast("int"))
    bits = chosen.groupBy(F.shiftright("trusted_id", 6).alias("block")).agg(*[F.bit_or(F.when(F.col("half") == h, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{h}") for h in (0, 1)])
    at = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    has = lambda h: F.call_function("shiftright", F.col(f"bits{h}"), at).bitwiseAND(F.lit(1)) == 1
    told = measures.join(F.broadcast(bits), F.shiftright("id", 6) == F.col("block"), "left")
    return told.select(*[F.col(f"`{c}`") for c in measures.columns], F.when(has(0), 0).when(has(1), 1).alias("half"))


def ratios(measures: DataFrame, chosen: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket, the chosen trusted texts of half 0 to all texts, by add-one smoothed shares. Only ``buckets`` counts reach the driver."""
    told = halves(measures, chosen)
    grams = told.select(F.explode("grams").alias("b"), F.when(F.col("half") == 0, 1).otherwise(0).alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for r in grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("target").alias("t")).collect():
        raw[r["b"]], target[r["b"]] = r["n"], r["t"]
    if not sum(target):
        return [0.0] * buckets
    raw_total, target_total = sum(raw) + buckets, sum(target) + buckets
    return [math.log((t + 1) / target_total) - math.log((n + 1) / raw_total) for t, n in zip(target, raw, strict=True)]


def scored(measures: DataFrame, ratio: list[float]) -> DataFrame:
    """measures with base_failed and llr, the mean log ratio of a text's n-grams (0 without any), in place of its buckets."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratio])), "array<double>")  # folded into one constant
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    llr = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))
    return measures.withColumn("base_failed", failed).withColumn("llr", llr).drop("grams")


def threshold(measures: DataFrame, chosen: DataFrame, ratio: list[float]) -> float:
    """The least mean ratio to be kept: QUANTILE of the ratios of the trusted texts of half 1 that pass the base rules, none of which the ratios were counted from, and MARGIN lower by the distance to their median. Without such texts everything is kept."""
    own = scored(halves(measures, chosen).where("half = 1"), ratio).where(~F.col("base_failed"))
    low, middle = own.agg(F.percentile("llr", F.array(F.lit(QUANTILE), F.lit(0.5))).alias("q")).first()["q"] or (-math.inf, 0.0)
    return low - MARGIN * (middle - low) if math.isfinite(low) else low


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, buckets: int = BUCKETS, limit: int | None = None) -> DataFrame:
    """(row, the five counts, base_failed, llr, kept) of every row; row is the input row as a struct, or its columns ``keep``.

    base_failed: under 50 words, or more than half of the words in repeated windows. Otherwise kept tells whether the
    mean log ratio reaches ``threshold``. ``trusted`` holds the trusted ids; all are learned from, or ``limit`` of
    them if that is given; null ids match nothing, rows that repeat a trusted id all count. A null or empty text has no words and
    fails. Without trusted texts all ratios are 0 and only the base rules decide. An empty table gives an empty
    table. A text is handled within one row, its words in arrays: executors need about 100 bytes of memory for each
    word of the longest text.
    """
    with scratch(docs.sparkSession):
        measures = measured(docs, id_col, text_col, keep, buckets)
        chosen = written(_chosen(trusted, id_col, limit), "trusted")
        ratio = ratios(measures, chosen, buckets)
        least = threshold(measures, chosen, ratio)
    d = scored(measures, ratio).drop("id")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))
