"""Byte-level BPE encoding and decoding.

Merging a piece: a segment tree over its byte positions holds in each node the smallest (rank, position) of the pairs
below it, so its root is the leftmost pair of minimum rank. A merge unlinks the right neighbour and updates the two
pairs that changed, each along one path to the root. Pieces of up to WIDE bytes are merged side by side, one row of a
NumPy array of trees each; longer ones by one tree, in O(n log n).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship, with_columns

#: Longest piece merged side by side with others.
WIDE = 64
#: Chunks and pieces that a worker remembers, each; a full table is begun anew when more than STALE of a batch isn't in it.
CACHE = 700_000
#: Longer ones, in characters, aren't remembered: so a table holds at most CACHE times some 300 bytes.
LONG = 64
STALE = 0.25
#: Rows merged side by side at once.
ROWS = 8192
NONE = np.int64(1) << 60
_state: dict = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token of a file with a base64 token and its rank a line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


def _places(values: list) -> Iterator[int]:
    """Where a list has None."""
    at = -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        yield at


def _short(table: dict) -> dict:
    return {k: v for k, v in table.items() if len(k) <= LONG}


class ByteBPE:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.base = max(self.tokens, default=0) + 1
        pairs = sorted((ranks[t[:i]] * self.base + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], dtype=np.int64)
        self.chunks: dict[str, dict[str, bytes | bool]] = {"": {}, " ": {}}
        self.pieces: dict[str, bytes] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, or NONE."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, by one segment tree of Python numbers."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        if n < 2:
            return ids
        width = 1 << (n - 1).bit_length()
        shift = width.bit_length()
        none = int(NONE) << shift
        first = self._pair(np.array(ids[:-1]), np.array(ids[1:]))
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [(int(r) << shift | i) if r < NONE else none for i, r in enumerate(first.tolist())]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        def value(i: int) -> int:
            rank = ranks.get(tokens[ids[i]] + tokens[ids[after[i]]])
            return none if rank is None else rank << shift | i

        while (low := tree[1]) != none:
            i = low & ((1 << shift) - 1)
            j = after[i]
            ids[i], after[i] = low >> shift, after[j]
            put(j, none)
            if after[i] < n:
                before[after[i]] = i
                put(i, value(i))
            else:
                put(i, none)
            if before[i] >= 0:
                put(before[i], value(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of pieces of 2 to WIDE bytes, one tree a row, all merged in step."""
        lengths = np.array([len(p) for p in pieces])
        m, width = len(pieces), 1 << int(lengths.max() - 1).bit_length()
        shift = width.bit_length()
        span = np.arange(width)
        cells = np.zeros((m, width), dtype=np.uint8)
        cells[span[None, :] < lengths[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = self.single[cells]
        none = NONE << 0
        tree = np.full((m, 2 * width), none, dtype=np.int64)
        rows, cols = np.nonzero(span[None, : width - 1] < lengths[:, None] - 1)
        ranks = self._pair(ids[rows, cols], ids[rows, cols + 1])
        tree[rows, width + cols] = np.where(ranks < NONE, ranks << shift | cols, none)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after = np.tile(span + 1, (m, 1))
        before = np.tile(span - 1, (m, 1))
        live = np.nonzero(tree[:, 1] < none)[0]

        def put(r: np.ndarray, i: np.ndarray, values: np.ndarray) -> None:
            i = i + width
            tree[r, i] = values
            while i[0] > 1:
                i = i >> 1
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

        while len(live):
            low = tree[live, 1]
            i = low & ((1 << shift) - 1)
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = low >> shift
            after[live, i] = k
            inside = k < lengths[live]
            before[live[inside], k[inside]] = i[inside]
            put(live, j, np.full(len(live), none))
            new = np.full(len(live), none)
            if inside.any():
                r = self._pair(ids[live[inside], i[inside]], ids[live[inside], k[inside]])
                new[inside] = np.where(r < NONE, r << shift | i[inside], none)
            put(live, i, new)
            b = before[live, i]
            has = b >= 0
            if has.any():
                r = self._pair(ids[live[has], b[has]], ids[live[has], i[has]])
                put(live[has], b[has], np.where(r < NONE, r << shift | b[has], none))
            live = live[tree[live, 1] < none]
        start = np.zeros((m, width + 1), dtype=bool)
        start[:, 0] = True
        at = np.zeros(m, dtype=np.int64)
        alive = np.arange(m)
        while len(alive):
            at[alive] = after[alive, at[alive]]
            alive = alive[at[alive] < lengths[alive]]
            start[alive, at[alive]] = True
        start = start[:, :width]
        flat = ids[start].astype("<u4").tobytes()
        ends = (4 * np.cumsum(start.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merged(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces. A piece that is a token is its id, as in the tiktoken library."""
        out: dict[str, bytes] = {}
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for name in pieces:
            p = name.encode()
            rank = self.ranks.get(p)
            if rank is not None:
                out[name] = rank.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[name] = np.array(self.merge_one(p), dtype="<u4").tobytes()
            else:
                names, group = by_width.setdefault((len(p) - 1).bit_length(), ([], []))
                names.append(name)
                group.append(p)
        for names, group in by_width.values():
            for at in range(0, len(group), ROWS):
                out.update(zip(names[at : at + ROWS], self.merge_many(group[at : at + ROWS]), strict=True))
        return out

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the pieces."""
        table = self.pieces
        unseen = set(pieces).difference(table)
        if not unseen:
            return [table[p] for p in pieces]
        new = self._merged(unseen)
        if len(table) < CACHE:
            table.update(_short(new))
        elif len(unseen) > STALE * len(pieces):
            self.pieces = _short(new)
        return [new[p] if p in new else table[p] for p in pieces]

    def _whole(self, text: str) -> bytes:
        return b"".join(self._values(self.pattern.findall(text)))

    def _learn(self, chunks: set[str], space: str) -> dict[str, bytes | bool]:
        """Ids of chunks, each behind ``space``; False if white space at its ends may join that around it."""
        out: dict[str, bytes | bool] = {}
        clean = []
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace():
                out[c] = False
            else:
                clean.append(c)
        if not space:
            split = [self.pattern.findall(c) for c in clean]
            values = iter(self._values([p for ps in split for p in ps]))
            out.update((c, b"".join([next(values) for _ in ps])) for c, ps in zip(clean, split, strict=True))
            return out
        for at in range(0, len(clean), ROWS):
            part = clean[at : at + ROWS]  # matched as one text: each chunk's first piece begins with its space, and no other does
            pieces = self.pattern.findall(" " + " ".join(part))
            values = self._values(pieces)
            starts = [i for i, p in enumerate(pieces) if p[0] == " "]
            for c, a, b in zip(part, starts, [*starts[1:], len(pieces)], strict=True):
                out[c] = values[a] if b == a + 1 else b"".join(values[a:b])
        return out

    def encode_batch(self, texts: list[str], by_space: bool = True) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers.

        With ``by_space``, texts are taken chunk by chunk at single spaces: the pattern starts a new piece at a space
        between two characters that aren't white space. Texts with other spaces are matched whole. Chunks are
        remembered until the table is full; one that no longer fits the texts is begun anew.
        """
        if not by_space:
            return [self._whole(t) for t in texts]
        out = []
        for at in range(0, len(texts), 200):
            part = texts[at : at + 200]
            split = [t.split(" ") for t in part]
            head, tail = self.chunks[""], self.chunks[" "]
            values = [list(map(tail.get, chunks)) for chunks in split]
            for chunks, vs in zip(split, values, strict=True):
                vs[0] = head.get(chunks[0])
            gaps = [list(_places(vs)) for vs in values]
            first = {c[0] for c, js in zip(split, gaps, strict=True) if js and js[0] == 0}
            later = {c[j] for c, js in zip(split, gaps, strict=True) for j in js if j}
            new_head, new_tail = self._learn(first, ""), self._learn(later, " ")
            for space, known, new in (("", head, new_head), (" ", tail, new_tail)):
                if len(known) < CACHE:
                    known.update(_short(new))
                elif sum(map(len, gaps)) > STALE * sum(map(len, split)):
                    self.chunks[space] = _short(new)
            for t, chunks, vs, js in zip(part, split, values, gaps, strict=True):
                for j in js:
                    vs[j] = (new_tail if j else new_head)[chunks[j]]
                out.append(b"" if not t else self._whole(t) if False in vs else b"".join(vs))
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _bpe(data: bytes, pattern: str) -> ByteBPE:
    key = (zlib.crc32(data), pattern)
    if key not in _state:
        _state.clear()
        _state[key] = ByteBPE(read_ranks(data), pattern)
    return _state[key]


def _ranks(df: DataFrame, path: str):
    ship(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: the ids that the tiktoken library's encode_ordinary gives. A null text counts as empty; an empty text has no ids. An empty table gives an empty table."""
    data = _ranks(docs, path)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(data.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = bpe.encode_batch(part.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "ids"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a last binary column ``decoded`` (decoded_2 where it has that name already): the bytes of the ids.

    Null ids give null bytes, no ids no bytes; an unknown id is an error. An empty table gives an empty table.
    """
    data = _ranks(encoded, path)
    at = encoded.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _bpe(data.value, pattern)
        column = batch.column(at)
        return [pa.array([None if x is None else bpe.decode(x) for i in range(0, len(column), 500) for x in column.slice(i, 500).to_pylist()], pa.binary())]

    return with_columns(encoded, run, [("decoded", "binary")])
