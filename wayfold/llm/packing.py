"""Best-fit packing of tokenised documents into sequences by best-two-fit.

A sequence is filled greedily, largest document first; then its smallest document makes way for two unpacked ones
that fit the widened gap more tightly. Which documents share a length does not matter, so the rule runs on the counts
of the at most ``size`` lengths: a filling is repeated as often as its counts allow. Every repeat at least halves the
count of some length, so there are at most about size * (1 + log2(size)) different fillings, however many documents.
Documents are then dealt to them by their rank among those of their length.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import checkpointed, ship, written

SIZE = 4096
#: Ends every document.
END = 1
#: Words whose ids a worker remembers.
CACHE = 500_000
#: Longer ones, in bytes, aren't remembered: so the table holds at most CACHE times some 300 bytes.
LONG = 64
#: A full table is begun anew when more than this share of a batch's words isn't in it.
STALE = 0.2
#: Unseen words that are encoded at once.
JOINED = 4000
_ODD = regex.compile(r"[^\S ]|[\x00\x1c-\x1f\x85\xa0]")
_ASCII = "".join(map(chr, range(33, 65))) + " " + "".join(map(chr, range(91, 127)))
_state: dict = {}


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Fillings (lengths, repeats) that use up the counts of lengths 1..size."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while len(have := np.nonzero(left)[0]):
        bin_, gap = [], size
        uses: dict[int, int] = {}
        lengths = have.tolist()
        at = len(lengths)
        while (at := bisect_right(lengths, gap, 0, at)) > 0:
            x = lengths[at - 1]
            take = min(gap // x, int(left[x]) - uses.get(x, 0))
            if take <= 0:
                at -= 1
                continue
            bin_ += [x] * take
            uses[x] = uses.get(x, 0) + take
            gap -= take * x
            at -= 1
        if gap and bin_:
            small = bin_[-1]
            room, best = gap + small, (small, 0, 0)
            free = [(x, int(left[x]) - uses.get(x, 0)) for x in lengths if x < room]
            free = [(x, n) for x, n in free if n > 0]
            lo, hi = 0, len(free) - 1
            while lo <= hi and best[0] < room:
                a, b = free[lo], free[hi]
                total = a[0] + b[0]
                if total <= room and (lo < hi or a[1] > 1) and total > best[0]:
                    best = (total, a[0], b[0])
                if total > room or lo == hi:
                    hi -= 1
                else:
                    lo += 1
            if best[1]:
                bin_.pop()
                uses[small] -= 1
                for x in best[1:]:
                    bin_.append(x)
                    uses[x] = uses.get(x, 0) + 1
        repeats = min(int(left[x]) // n for x, n in uses.items() if n)
        for x, n in uses.items():
            left[x] -= n * repeats
        out.append((bin_, repeats))
    return out


class Slots:
    """Where the r-th document of a length goes: (sequence, offset)."""

    def __init__(self, fillings: list[tuple[list[int], int]]):
        runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        used: dict[int, int] = {}
        first = 0
        for bin_, repeats in fillings:
            places: dict[int, list[int]] = {}
            at = 0
            for x in bin_:
                places.setdefault(x, []).append(at)
                at += x
            for x, offsets in places.items():
                start = used.get(x, 0)
                runs.setdefault(x, []).append((start, first, len(offsets), offsets))
                used[x] = start + repeats * len(offsets)
            first += repeats
        self.sequences = first
        self.runs = {x: ([r[0] for r in rs], rs) for x, rs in runs.items()}

    def __call__(self, length: int, rank: int) -> tuple[int, int]:
        starts, rs = self.runs[length]
        start, first, n, offsets = rs[bisect_right(starts, rank) - 1]
        return first + (rank - start) // n, offsets[(rank - start) % n]


def load_tokenizer(data: bytes):
    """A tokenizer of the tokenizers library; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(data)
    t.encode_special_tokens = True
    return t


class Merger:
    """BPE merges of pieces for a vocabulary whose words end in a suffix.

    The tiktoken library merges by rank: with a byte after each piece that stands for the suffix, its ranks are the
    single bytes, each byte with the suffix, and then the merges in their order. Token numbers are mapped back to ids.
    """

    END = "\x00"

    def __init__(self, model: dict):
        import tiktoken

        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        signs = {c: b for b, c in _byte_signs().items()}
        end = self.END.encode()
        raw = lambda token: b"".join(end if part is None else bytes(signs[c] for c in part) for part in ((token[: -len(suffix)], None) if token.endswith(suffix) else (token,)))
        joined = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        tokens = [*(c for c in signs), *(c + suffix for c in signs), *(a + b for a, b in joined)]
        ranks = {raw(t): i for i, t in enumerate(dict.fromkeys(tokens)) if raw(t) != end}
        self.ids = np.zeros(len(tokens), dtype="<u4")
        self.last = np.zeros(len(tokens), dtype=bool)
        for t, i in ((t, ranks[raw(t)]) for t in tokens if raw(t) in ranks):
            self.ids[i], self.last[i] = vocab[t], t.endswith(suffix)
        self.merge = tiktoken.Encoding("merges", pat_str="[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; no piece may be empty or hold END."""
        found = np.array(self.merge.encode_ordinary(self.END.join(pieces) + self.END), dtype=np.int64)
        flat, cuts = self.ids[found].tobytes(), (4 * (np.nonzero(self.last[found])[0] + 1)).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


def _places(values: list) -> Iterator[int]:
    """Where a list has None."""
    at = -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        yield at


class Encoder:
    """Ids of texts as little-endian 32-bit integers.

    For a tokenizer that lower-cases, drops white space, splits words by a pattern and merges bytes up to a suffix,
    words are encoded each on its own and remembered in a table until it is full; words not in it are encoded again.
    Other tokenizers, or ``by_words`` false, encode whole texts. Words with odd white space, or END, do so too.
    """

    def __init__(self, data: bytes, by_words: bool = True):
        self.tokenizer, spec = load_tokenizer(data), json.loads(data)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        normalizer = spec.get("normalizer") or {}
        plain = plain and "Lowercase" in [normalizer.get("type"), *(x.get("type") for x in normalizer.get("normalizers", []))] and model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges") and not spec.get("post_processor")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"] + "| ") if plain and by_words else None
        self.merger = Merger(model) if self.pattern else None
        # the normalizer leaves lower-case ASCII words alone
        self.lowers = self.pattern is not None and self.tokenizer.normalizer.normalize_str(_ASCII) == _ASCII
        self.words: dict[bytes, bytes] = {}

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [t.decode("utf-8", "replace") for t in texts]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words."""
        out: dict[bytes, bytes] = {}
        plain = [w for w in words if w.isascii()]
        for group, ascii_only in ((plain, True), ([w for w in words if not w.isascii()], False)):
            for at in range(0, len(group), JOINED):
                part = group[at : at + JOINED]
                text = b" ".join(part).decode("utf-8", "replace")
                if _ODD.search(text):
                    odd = [w for w in part if _ODD.search(w.decode("utf-8", "replace"))]
                    out.update(zip(odd, self._encode(odd), strict=True))
                    part = [w for w in part if w not in out]
                    text = b" ".join(part).decode("utf-8", "replace")
                if not part:
                    continue
                found = self.pattern.findall(text if ascii_only and self.lowers else self.tokenizer.normalizer.normalize_str(text))
                ids = iter(self.merger([p for p in found if p != " "]))
                values = [next(ids) if p != " " else b"" for p in found]
                cuts = [i for i, p in enumerate(found) if p == " "]
                for w, a, b in zip(part, [-1, *cuts], [*cuts, len(found)], strict=True):
                    out[w] = values[a + 1] if b == a + 2 else b"".join(values[a + 1 : b])
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.pattern is None:
            return self._encode(texts)
        split = [t.lower().split() for t in texts]  # of ASCII letters only, as the tokenizer does to all
        known = self.words
        values = [list(map(known.get, words)) for words in split]
        gaps = [list(_places(v)) for v in values]
        unseen = {words[j] for words, js in zip(split, gaps, strict=True) for j in js}
        if unseen:
            new = self._learn(list(unseen))
            short = {w: v for w, v in new.items() if len(w) <= LONG}
            if len(known) < CACHE:
                known.update(short)
            elif sum(map(len, gaps)) > STALE * sum(map(len, split)):
                self.words = short
            for words, vs, js in zip(split, values, gaps, strict=True):
                for j in js:
                    vs[j] = new[words[j]]
        return list(map(b"".join, values))


def _encoder(data: bytes, by_words: bool) -> Encoder:
    key = (zlib.crc32(data), by_words)
    if key not in _state:
        _state.clear()
        _state[key] = Encoder(data, by_words)
    return _state[key]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, by_words: bool = True) -> DataFrame:
    """Pieces (id, piece, start, length, ids, at, seq) of all documents: their ids and then ``end``, cut after every ``size`` ids.

    ids is binary: little-endian unsigned 32-bit numbers. at is the task's partition, seq a piece's number among those
    of its length in the task. A null text counts as empty.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tail = np.array([end], dtype="<u4").tobytes()
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("at", pa.int32()), ("seq", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, seen = _encoder(data.value, by_words), TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
            own = batch.column("id").to_pylist()
            for at in range(0, len(texts), 200):
                rows = []
                for i, raw in zip(own[at : at + 200], encoder(texts[at : at + 200]), strict=True):
                    raw += tail
                    for piece, start in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[start : start + 4 * size]
                        n = len(part) // 4
                        seq = seen.get(n, 0)
                        seen[n] = seq + 1
                        rows.append((i, piece, start // 4, n, part, task, seq))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "id long, piece int, start long, length long, ids binary, at int, seq long")


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset. ``pieces`` must be materialised, with columns at (its split) and seq (a number within it, of its own among the pieces of a length)."""
    spark = pieces.sparkSession
    counts = checkpointed(pieces.groupBy("at", "length").agg(F.count("*").alias("n")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(best_two_fit(lengths, size)))
    before = Window.partitionBy("length").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("at", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for batch in batches:
            found = [where(n, f + s) for n, f, s in zip(*(batch.column(c).to_pylist() for c in ("length", "first", "seq")), strict=True)]
            keep = [c for c in batch.schema.names if c not in ("first", "seq", "at")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=[*keep, "sequence_id", "offset"])

    joined = pieces.join(first, ["at", "length"])
    keep = [f for f in joined.schema if f.name not in ("first", "seq", "at")]
    return joined.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "sequence_id long", "offset long"]))


def cut(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, by_words: bool = True) -> DataFrame:
    """The pieces of all documents with their ids, written once to the shared folder: (id, piece, start, length, ids, at, seq)."""
    return written(encode(docs, tokenizer_path, id_col, text_col, size, end, by_words), "pack-pieces")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, by_words: bool = True) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset) of every piece of every document; ids as in ``encode``.

    A null or empty text is one piece of its end id. Repeated rows are packed each. Pieces fill each sequence without
    gaps from offset 0. An empty table gives an empty table. Who needs no ids can give ``place`` the other columns of
    ``cut``, whose shuffle then moves positions only.
    """
    pieces = cut(docs, tokenizer_path, id_col, text_col, size, end, by_words)
    return place(pieces, size).select("id", "piece", "start", "length", "ids", "sequence_id", "offset")
