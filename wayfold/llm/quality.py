"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts of the learning fold give a logistic additive model over binned text
statistics that minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
with the sigmoid loss, which is bounded and so keeps sampling noise out of the difference.
Label 0 is never read; the class prior is estimated from the density ratio of the two sides.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import scratch, ship, with_columns, written
from wayfold.llm.langid import held_out, sampled

#: Positives and unlabelled rows learned from, each, at most.
SAMPLE = 10_000
THRESHOLD = 0.7
BINS = 64
STEPS = 400
#: Penalties on a bin's weight and on the difference of neighbours.
RIDGE, SMOOTH = 2e-5, 5e-3
#: Bytes of a text that are taken apart at once.
BLOCK = 4 << 20
FEATURES = ("log_words", "word_bytes", "upper", "marks", "exclaims", "bars", "digits", "stops", "adjacent", "distinct", "line_copies", "line_words", "long_words", "other")


def features(data: bytes) -> list[float]:
    """Statistics of a whole UTF-8 text; all are shares or logarithms."""
    hist = np.zeros(256, dtype=np.int64)
    n = same = longest = 0
    last, vocabulary = None, set()
    for at in range(0, len(data), BLOCK):
        hist += np.bincount(np.frombuffer(data, dtype=np.uint8, count=min(BLOCK, len(data) - at), offset=at), minlength=256)
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        words = data[at:end].split()
        at = end
        if words:
            n += len(words)
            same += sum(map(operator.eq, words, words[1:])) + (words[0] == last)
            last = words[-1]
            vocabulary.update(words)
            longest += sum(map((24).__lt__, map(len, words)))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    size, upper = max(int(hist.sum()), 1), int(hist[65:91].sum())
    letters = upper + int(hist[97:123].sum())
    marks = int(sum(hist[ord(c)] for c in "#*$%&<>~^_=+{}[]\\/@"))
    w = max(n, 1)
    return [
        math.log1p(n),
        math.log1p(size / w),
        upper / max(letters, 1),
        marks / size,
        int(hist[33]) / w,
        int(hist[124]) / w,
        int(hist[48:58].sum()) / size,
        int(hist[44] + hist[46]) / w,
        same / w,
        len(vocabulary) / w ** 0.85,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        longest / w,
        int(hist[:32].sum() - hist[10]) / size,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, b in enumerate(self.bins(x).T if len(self.edges) else []):
            z += self.weights[j][b]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(bins: np.ndarray, sizes: list[int], loss_grad, steps: int = STEPS) -> tuple[list[np.ndarray], float]:
    """Adam over the additive model's weights; loss_grad gives the gradient by row's output."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = bins + starts[:-1][None, :]
    w = np.zeros(starts[-1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    inner = np.ones(len(w) - 2, dtype=bool)  # neighbouring bins of one feature
    inner[starts[1:-1] - 1] = False
    for t in range(1, steps + 1):
        g_row = loss_grad(w[flat].sum(axis=1) + w[-1])
        g = np.bincount(flat.ravel(), weights=np.repeat(g_row, bins.shape[1]), minlength=len(w))
        g[-1] = g_row.sum()
        d = SMOOTH * np.where(inner, np.diff(w[:-1]), 0.0)
        g[:-1] += RIDGE * w[:-1]
        g[:-2] -= d
        g[1:-1] += d
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return [w[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], float(w[-1])


def _edges(x: np.ndarray) -> np.ndarray:
    """Bin edges of one feature: even steps of its range, and of its ranks."""
    n = int(min(BINS, max(4, len(x) // 60)))
    return np.unique(np.concatenate([np.linspace(x.min(), x.max(), n + 1)[1:-1], np.quantile(x, np.linspace(0, 1, n // 2 + 1)[1:-1])]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows: where all rows are positive, the ratio of the two sides' densities is 1 / prior, so it is the inverse of the median ratio on positives that a classifier of the two sides gives."""
    both = np.concatenate([positive, unlabelled])
    pos = np.arange(len(both)) < len(positive)
    edges = [_edges(both[:, j]) for j in range(both.shape[1])]
    n_pos, n_unl = len(positive), len(unlabelled)
    w, b = _descend(Model(edges, [], 0.0).bins(both), [len(e) + 1 for e in edges], lambda z: np.where(pos, (_sig(z) - 1) / n_pos, _sig(z) / n_unl))
    other = Model(edges, w, b).score(positive)
    return min(max(1 / max(float(np.median(other / np.maximum(1 - other, 1e-9))), 1.0), 0.01), 0.99)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model of least non-negative risk, with the estimated prior unless one is given. Without rows on either side the score is one half for every text."""
    if not len(positive) or not len(unlabelled):
        return Model([], [], 0.0)
    both = np.concatenate([positive, unlabelled])
    edges = [_edges(both[:, j]) for j in range(both.shape[1])]
    model = Model(edges, [], 0.0)
    x = model.bins(both)
    sizes = [len(e) + 1 for e in edges]
    pos = np.zeros(len(both), dtype=bool)
    pos[: len(positive)] = True
    n_pos, n_unl = pos.sum(), (~pos).sum()
    prior = estimated_prior(positive, unlabelled) if prior is None else min(max(prior, 0.01), 0.99)

    def grad(z: np.ndarray) -> np.ndarray:
        p = _sig(z)  # the sigmoid loss: loss(-) is p, loss(+) is 1 - p
        slope = p * (1 - p)
        if p[~pos].mean() - prior * p[pos].mean() < 0:  # step back from a negative part of the risk
            return np.where(pos, prior * slope / n_pos, -slope / n_unl)
        return np.where(pos, -2 * prior * slope / n_pos, slope / n_unl)

    model.weights, model.bias = _descend(x, sizes, grad)
    return model


def _with_features(docs: DataFrame) -> DataFrame:
    """(id, kind, x) of the rows (id, text, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [features(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array(xs, pa.list_(pa.float64()))], names=["id", "kind", "x"])

    return docs.select("id", "text", "kind").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, kind int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 4, part: int = 2, sample: int = SAMPLE) -> Model:
    """Learns from ``sample`` positive and as many unlabelled rows of the fold that isn't held out, at most.

    An id with several labels counts with the smallest; null ids and labels are left out. Rows are drawn by a hash of
    id and text, ties by the id, so one id that many rows repeat brings no more than ``sample``. Null texts count as
    empty, long ones are read whole. Without documents or positives the model scores one half.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null and y is not null").where(~held_out("id", parts, part)).groupBy("id").agg(F.min("y").alias("y"))
    ones = known.where("y = 1")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where("id is not null").where(~held_out("id", parts, part))
    total, n_ones = rows.count(), ones.count()
    # the drawn positives' ids are about ``sample`` in number, whatever the size of the tables
    trusted = F.broadcast(ones.where(sampled(F.col("id"), min(1.0, sample / max(n_ones, 1)), 21)).select("id", F.lit(1).alias("trusted")))
    drawn = sampled(F.struct("id", "text"), min(1.0, sample / max(total, 1)), 22)
    with scratch(docs.sparkSession):
        marked = rows.join(trusted, "id", "left").withColumn("drawn", drawn).where("trusted = 1 or drawn")
        kinds = written(_with_features(marked.withColumn("kind", F.coalesce("trusted", F.lit(0)) + F.when(F.col("drawn"), 2).otherwise(0))), "quality-sample")
        got = [kinds.where(F.col("kind").bitwiseAND(bit) > 0).orderBy(F.xxhash64("id", "x"), "id").limit(sample).select("x").collect() for bit in (1, 2)]
    return fit(*[np.array([r["x"] for r in g]).reshape(-1, len(FEATURES)) for g in got])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a last column quality_score, 0 to 1, of every whole text; where docs has that name already, it is quality_score_2.

    A null text scores as an empty one. Rows are scored each by itself, so repeated ones alike; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.array([features(t.as_py() or b"") for t in batch.column(at).cast(pa.binary())]).reshape(-1, len(FEATURES))
        return [pa.array(held.value.score(x))]

    return with_columns(docs, run, [("quality_score", "double")])
