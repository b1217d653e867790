"""Byte-level BPE, encoding and decoding.

A text is cut into pieces by the tokenizer's pattern, and each piece starts as a doubly linked
list of its bytes. A priority queue holds the rank of every adjacent pair that has a merge. The
lowest rank, leftmost first, is taken out; an entry whose symbols have changed since it was put
in is stale and skipped; else the two symbols become one and the pairs at its two sides are
queued. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import json
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

#: Fixed value: the byte-level pattern of the tokenizer file's kind. Letters and digits are tried first,
#: as nothing else starts like them.
PIECES = r""" ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
CACHED_PIECES = 1_000_000  # per Python worker, some 200 MB
CACHED_BYTES = 64  # longer pieces are rare and not kept
ROWS_AT_ONCE = 200  # texts whose ids are in memory together


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next one from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    other = (b for b in range(256) if b not in printable)
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + n) for n, b in enumerate(other)}}


class Bpe:
    """A byte-level BPE tokenizer from a ``tokenizers`` JSON file; truncation and padding are not used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, letters = made["model"], byte_letters()
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self._start = [vocabulary.get(letters[b]) for b in range(256)]
        # (left id, right id) as one number -> rank; by rank, the two ids and that of both as one.
        self._shift = max(vocabulary.values()).bit_length()
        self._made = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self._ranks = {left << self._shift | right: rank for rank, (left, right, _) in enumerate(self._made)}
        self._added = {t["content"]: t["id"] for t in made["added_tokens"]}
        found = sorted(self._added, key=len, reverse=True)
        self._split_added = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self._pieces = regex.compile(PIECES)
        back = {letter: b for b, letter in letters.items()}
        self._bytes = [b""] * (max([*vocabulary.values(), *self._added.values()]) + 1)
        for s, i in vocabulary.items():
            self._bytes[i] = bytes(back[c] for c in s)
        for s, i in self._added.items():
            self._bytes[i] = s.encode()
        # By two bytes, the rank of their merge.
        self._byte_ranks = [self._ranks.get(a << self._shift | b) for a in self._start for b in self._start]
        self._known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        start, shift, rank_of, made = self._start, self._shift, self._ranks.get, self._made
        ids = [start[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        # A queue entry is rank * 2**places + place of the left symbol; the rank tells both symbols,
        # so an entry is stale if other symbols are there by now. A symbol merged away is -1.
        places = n.bit_length()
        place = (1 << places) - 1
        first = self._byte_ranks
        ranks = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        queue = [rank << places | at for at, rank in enumerate(ranks) if rank is not None]
        if not queue:
            return ids
        heapify(queue)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            at = entry & place
            left, right, both = made[entry >> places]
            after = following[at]
            if ids[at] != left or after >= n or ids[after] != right:
                continue
            ids[at], ids[after] = both, -1
            after = following[at] = following[after]
            if after < n:
                before[after] = at
                rank = rank_of(both << shift | ids[after])
                if rank is not None:
                    heappush(queue, rank << places | at)
            earlier = before[at]
            if earlier >= 0:
                rank = rank_of(ids[earlier] << shift | both)
                if rank is not None:
                    heappush(queue, rank << places | earlier)
        return [i for i in ids if i >= 0]

    def _new(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = array("i", self.merge(raw)).tobytes()
        if len(raw) <= CACHED_BYTES:
            if len(self._known) >= CACHED_PIECES:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        known, new = self._known.get, self._new
        parts = self._split_added.split(text) if self._split_added else [text]
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(array("i", [self._added[part]]).tobytes())
            else:
                out += [known(p) or new(p) for p in self._pieces.findall(part)]
        return b"".join(out)

    def decode(self, ids) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD; unknown ids are left out."""
        ids = np.asarray(ids, dtype=np.int64)
        known = ids[(ids >= 0) & (ids < len(self._bytes))]
        return b"".join(map(self._bytes.__getitem__, known.tolist())).decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def _int_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` in place of the text: an array of its ids.

    NULL counts as empty, and an empty text has no ids. ``path``: a tokenizer file every executor has.
    """

    def encoded(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                made = _int_lists([bpe.encode(t or "") for t in rows.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), made], [*kept, ids])

    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(encoded, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with the column ``text``: the text of its ids; NULL and empty arrays give an empty one."""
    return _decoded(coded, path, ids, text, None)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one go: ``docs`` with ids and the text decoded from them in place of the text."""
    return _decoded(docs, path, ids, decoded, text)


def _decoded(rows: DataFrame, path: str, ids: str, out: str, text: str | None) -> DataFrame:
    def worked(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                coded = _int_lists([bpe.encode(t or "") for t in part.column(text).to_pylist()]) if text else part.column(ids)
                values, ends = coded.values.to_numpy(), coded.offsets.to_numpy()
                texts = pa.array([bpe.decode(values[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), coded, texts], [*kept, ids, out])

    kept = [c for c in rows.columns if c not in (ids, out, text)]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())]
    return rows.mapInArrow(worked, T.StructType([*(rows.schema[c] for c in kept), *added]))
