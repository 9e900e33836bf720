"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of it a binary trigram classifier (weights: log ratio of the trigrams'
shares in the two sides' texts, averaged over a text, then a fitted scale and offset) predicts the bit's margin. A
text gets the language whose codeword has the smallest logistic loss over all bits, every bit weighted by its margin;
the softmax of the losses is its score, and near ties are flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import scratch, ship, with_columns, written

#: Hashed trigrams.
DIM_BITS = 17
#: Texts learned from for each language, about, chosen by a hash; whole, however long.
SAMPLE = 400
#: Smallest difference of the two best scores that isn't ambiguous.
GAP = 0.2
BLOCK = 1 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b > 127 or bytes([b]).isalpha() else 32 for b in range(256))


def held_out(id_col: Column | str, parts: int, part: int) -> Column:
    """Whether crc32(id as text) mod parts is part; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def sampled(of: Column, share: Column | float, salt: int) -> Column:
    """Whether a hash of the value falls into the share."""
    return F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the lower-cased text, everything in ASCII but letters as spaces; in blocks."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", dtype=np.uint8)
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        x = data[at : at + BLOCK + 2].astype(np.uint32)
        codes = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        codes = codes[codes != 0x202020]
        yield (codes * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: the exhaustive code for 3 to 7 languages, else the widest spaced of some fixed random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        width = (1 << (n - 1)) - 1
        rows = [np.ones(width)]
        for r in range(1, n):
            run = 1 << (n - 1 - r)
            rows.append(np.array([-1.0 if (j // run) % 2 == 0 else 1.0 for j in range(width)]))
        return np.stack(rows)
    rnd, best = np.random.default_rng(7), None
    for _ in range(50):
        code = rnd.choice([-1.0, 1.0], size=(n, math.ceil(15 * math.log2(n))))
        code = code[:, np.abs(code.sum(0)) < n]
        gram = code @ code.T
        np.fill_diagonal(gram, -np.inf)
        if best is None or gram.max() < best[0]:
            best = (gram.max(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    offset: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for idx in trigrams(text):
            total += self.weights[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        return self.scale * (total / max(n, 1)) + self.offset

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Scores of the languages: softmax of minus the logistic loss of each codeword."""
        loss = np.logaddexp(0, -self.code * margins[None, :]).sum(axis=1)
        e = np.exp(loss.min() - loss)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        scores = self.decode(self.margins(text))
        order = np.argsort(-scores, kind="stable")
        gap = scores[order[0]] - (scores[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(scores[order[0]]), bool(gap < GAP)


#: Counts are summed as whole multiples of this, so that their order doesn't matter.
UNIT = 2.0**-30


def _counts(text: str) -> np.ndarray:
    """Trigram counts of a text over the root of its length, in UNITs."""
    out = np.zeros(1 << DIM_BITS)
    for idx in trigrams(text):
        out += np.bincount(idx, minlength=1 << DIM_BITS)
    return np.rint(out / (max(len(text), 1) ** 0.5 * UNIT)).astype(np.int64)


def uncalibrated(counts: dict[str, np.ndarray]) -> Model:
    """A model of the languages with these trigram counts, margins as they come."""
    languages, dim, floor = sorted(counts), 1 << DIM_BITS, 1e-6
    code = codewords(len(languages))
    shares = np.stack([counts[x] / max(counts[x].sum(), 1) for x in languages]) if languages else np.zeros((0, dim))
    weights = np.zeros((dim, code.shape[1]), dtype=np.float32)
    for j in range(code.shape[1]):
        up, down = shares[code[:, j] > 0].mean(0), shares[code[:, j] < 0].mean(0)
        weights[:, j] = np.log(up + floor) - np.log(down + floor)
    return Model(languages, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]))


def calibrated(model: Model, margins: np.ndarray, labels: list[str]) -> Model:
    """The model with a scale and offset of each bit's margin, fitted on texts whose languages count alike."""
    if model.code.shape[1] and labels:
        row = {x: i for i, x in enumerate(model.languages)}
        y = model.code[[row[v] for v in labels]]
        often = Counter(labels)
        w = np.array([1 / often[v] for v in labels])
        for j in range(model.code.shape[1]):
            model.scale[j], model.offset[j] = _platt(margins[:, j], y[:, j], w / w.sum())
    return model


def fit(texts: list[str], labels: list[str]) -> Model:
    """A model of the languages in labels."""
    counts = {x: np.zeros(1 << DIM_BITS, dtype=np.int64) for x in labels}
    for text, lang in zip(texts, labels, strict=True):
        counts[lang] += _counts(text)
    model = uncalibrated(counts)
    return calibrated(model, np.array([model.margins(t) for t in texts]).reshape(len(texts), model.code.shape[1]), labels)


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Scale and offset of the logistic fit of y (+-1) on x, with a small penalty on the scale."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(y * (a * x + b), -500, 500)))
        g = np.array([-(w * p * y * x).sum() + 1e-4 * a, -(w * p * y).sum() + 1e-4 * b])
        h = w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _drawn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, parts: int, part: int, sample: int) -> DataFrame:
    """(text, lang) of about ``sample`` different texts of each language, by a hash of the text, of the rows that aren't held out and have an id, a language and a letter."""
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    known = known.where(~held_out("id", parts, part) & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    shares = written(known.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")), "language-shares")
    hit = known.join(shares, "lang").where(sampled(F.col("text"), F.col("share"), 11))
    return hit.select("text", "lang").distinct()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, part: int = 1, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null language of the rows that aren't held out, about ``sample`` texts of each language.

    Rows without id, text, language or letter are left out, repeated ones count once, ties of the hash stay together.
    Texts are counted whole in the executors; what reaches the driver are sums by language and trigram, and one vector
    for each text. Without any row the model knows no language.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + _counts(t.as_py())
        for lang, x in sorted(held.items()):
            at = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(x[at])], names=["lang", "at", "n"])

    with scratch(docs.sparkSession):
        rows = written(_drawn(docs, id_col, text_col, lang_col, parts, part, sample), "languages")
        sums = rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pydict()
        counts: dict[str, np.ndarray] = {x: np.zeros(1 << DIM_BITS, dtype=np.int64) for x in set(sums["lang"])}
        for lang, at, n in zip(sums["lang"], sums["at"], sums["n"], strict=True):
            counts[lang][at] = n
        model = uncalibrated(counts)
        held = docs.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([held.value.margins(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))], names=["lang", "margins"])

        found = sorted((r["lang"], r["margins"]) for r in rows.mapInArrow(measure, "lang string, margins array<double>").collect())
    return calibrated(model, np.array([m for _, m in found]).reshape(len(found), model.code.shape[1]), [x for x, _ in found])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with last columns lang_pred, lang_score and lang_ambiguous; a name that docs has already gets a number, from lang_pred_2.

    A text that is null or has no letter, or any text when no language was learned, is ``und`` with score 0 and
    ambiguous. Long texts are read whole, repeated rows predicted alike; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [held.value.predict(t.as_py()) for t in batch.column(at)]
        return [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return with_columns(docs, run, [("lang_pred", "string"), ("lang_score", "double"), ("lang_ambiguous", "boolean")])
