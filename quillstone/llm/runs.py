"""Periodic runs of words, found with a grammar made by recompression.

The words of some texts stand in one sequence, with a mark of its own before and after each text.
Recompression makes it shorter in two alternating ways until one symbol is left: every stretch of
one repeated symbol becomes a symbol (block compression), and after a split of all symbols into two
sides, every adjacent pair of a left and a right symbol becomes one (pair compression). Both depend
on neighbours only, so equal stretches of text are cut alike but for a symbol at each end and level.

That gives the common extension of two places at once for many of them: while the symbols at both
places are equal, one symbol or block at most is passed to reach a border of the next level, and both
places go up; where symbols differ, one symbol or block at most is passed on each level on the way down.

A run of period p holds two neighbours of the grid 0, p, 2p, ... So every pair of grid neighbours, for
each p up to half the text, is a candidate, n ln n in all; those with equal words are extended to both
sides. Of all periods found for one stretch the smallest is the run's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_LENGTH = 12
BYTES_AT_ONCE = 1 << 20  # of text whose words share a grammar; a longer text has one of its own
CANDIDATES_AT_ONCE = 1 << 20


class Grammar:
    """The levels of a run-length grammar over a sequence of numbers that no two places repeat to the end.

    ``symbols[h]`` is level h; for h > 0, ``starts[h]`` are the places in level h - 1 where its symbols
    begin, with the end behind them, and ``owner[h]`` tells the symbol that holds each place of level
    h - 1. On one level, equal symbols are equal stretches and the other way round.
    """

    def __init__(self, sequence: np.ndarray):
        self.symbols, self.starts, self.owner, self.blocks = [sequence.astype(np.int32)], [None], [None], [None]
        self._names = int(sequence.max(initial=-1)) + 1
        while len(self.symbols[-1]) > 1:
            self._blocks()
            if len(self.symbols[-1]) > 1:
                self._pairs()

    def _add(self, first: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        below = len(self.symbols[-1])
        owner = (np.cumsum(first) - 1).astype(np.int32)
        self.starts.append(np.append(np.flatnonzero(first), below).astype(np.int32))
        self.symbols.append(symbols.astype(np.int32))
        self.owner.append(owner)
        self.blocks.append(blocks)

    def _name(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New symbols for pairs of numbers."""
        found, names = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        names = names + self._names
        self._names += len(found)
        return names

    def _blocks(self) -> None:
        now = self.symbols[-1]
        first = np.append(True, now[1:] != now[:-1])
        if first.all():
            return
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(now)))
        made = now[starts]
        long = sizes > 1
        made[long] = self._name(made[long], sizes[long])
        self._add(first, made, True)

    def _pairs(self) -> None:
        now = self.symbols[-1]
        while True:  # neighbours differ, so that a split parts some of them is a matter of a few tries
            self._seed = getattr(self, "_seed", 0) + 1
            mixed = (now.astype(np.uint64) + np.uint64(self._seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
            side = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int8)
            step = side[1:] - side[:-1]
            pair = step == (1 if 2 * np.count_nonzero(step == 1) >= np.count_nonzero(step) else -1)
            if pair.any():
                break
        first = np.append(True, ~pair)
        made = now[first]
        paired = np.append(pair, False)[first]
        at = np.flatnonzero(pair)
        made[paired] = self._name(now[at], now[at + 1])
        self._add(first, made, False)

    def mirrored(self) -> Grammar:
        """The grammar of the sequence read backwards."""
        other = object.__new__(Grammar)
        other.symbols = [s[::-1] for s in self.symbols]
        other.starts = [None, *(s[-1] - s[::-1] for s in self.starts[1:])]
        other.owner = [None, *(len(s) - 1 - o[::-1] for s, o in zip(self.symbols[1:], self.owner[1:]))]
        other.blocks = self.blocks
        return other

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the sequence goes on alike from the places x and y, which differ."""
        begun, which = x, np.arange(len(x))
        parted = []  # by level: whose symbols differ, and where
        for level, now in enumerate(self.symbols):
            same = now[x] == now[y]
            parted.append([(which[~same], x[~same], y[~same])])
            which, x, y = which[same], x[same], y[same]
            if not len(which):
                break
            starts, owner = self.starts[level + 1], self.owner[level + 1]
            up_x, up_y = owner[x], owner[y]
            inside = (starts[up_x] != x) | (starts[up_y] != y)
            # Inside a block, what is left of it; inside a pair, its second symbol.
            left_x, left_y = starts[up_x + 1] - x, starts[up_y + 1] - y
            if self.blocks[level + 1]:
                short = inside & (left_x != left_y)
                passed = np.minimum(left_x, left_y)[short]
                parted[-1].append((which[short], x[short] + passed, y[short] + passed))
                inside, stay = inside[~short], ~short
                which, up_x, up_y = which[stay], up_x[stay], up_y[stay]
                x, y = up_x + inside, up_y + inside
            else:
                x = np.where(inside, owner[x + 1], up_x)
                y = np.where(inside, owner[y + 1], up_y)
        which, x, y = (np.empty(0, np.int64) for _ in range(3))
        for level in range(len(parted) - 1, -1, -1):
            which, x, y = (np.concatenate(parts) for parts in zip((which, x, y), *parted[level]))
            if level == 0:
                break
            starts, below = self.starts[level], self.symbols[level - 1]
            down_x, down_y = starts[x], starts[y]
            same = below[down_x] == below[down_y]
            passed = np.where(same, np.minimum(starts[x + 1] - down_x, starts[y + 1] - down_y) if self.blocks[level] else 1, 0)
            x, y = down_x + passed, down_y + passed
        out = np.empty(len(begun), np.int64)
        out[which] = x - begun[which]
        return out


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid neighbours in a text of n words, in slices."""
    low = 1
    while low <= n // 2:
        sizes = (n - 1) // np.arange(low, n // 2 + 1)
        fit = max(1, int(np.searchsorted(np.cumsum(sizes), CANDIDATES_AT_ONCE, "right")))
        sizes = sizes[:fit]
        period = np.repeat(np.arange(low, low + fit), sizes)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * period
        yield place, period
        low += fit


def runs_of(texts: list[np.ndarray], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """For each sequence of numbers from 0 its runs, an array of (start, length, period) by start, then period."""
    marks = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    parts = [np.array([marks])]
    for number, text in enumerate(texts):
        parts += [text, np.array([marks + number + 1])]
    sequence = np.concatenate(parts)
    begin = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])]) if texts else []
    grammar, length = None, len(sequence)
    found = []

    def extend(x: np.ndarray, period: np.ndarray, number: np.ndarray) -> None:
        nonlocal grammar
        if grammar is None:
            made = Grammar(sequence)
            grammar = made, made.mirrored()
        ahead = grammar[0].common(x, x + period)
        back = grammar[1].common(length - x, length - x - period)
        long = ahead + back >= np.maximum(period, least - period)
        x, period, ahead, back, number = x[long], period[long], ahead[long], back[long], number[long]
        found.append(np.stack([number, x - back, x + period + ahead, period]))

    waiting, size = [], 0
    for number, (base, text) in enumerate(zip(begin, texts)):
        for place, period in _grid(len(text)):
            same = text[place] == text[place + period]
            place, period = place[same], period[same]
            waiting.append((place + base, period, np.full(len(place), number)))
            size += len(place)
            if size >= CANDIDATES_AT_ONCE:
                extend(*map(np.concatenate, zip(*waiting)))
                waiting, size = [], 0
    if size:
        extend(*map(np.concatenate, zip(*waiting)))
    if not found:
        return [np.empty((0, 3), np.int64) for _ in texts]
    number, start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start, number))
    number, start, end, period = (v[order] for v in (number, start, end, period))
    smallest = np.ones(len(number), bool)
    smallest[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    number, start, end, period = (v[smallest] for v in (number, start, end, period))
    order = np.lexsort((period, start, number))
    rows = np.stack([start - np.asarray(begin)[number], end - start, period], axis=1)[order]
    return np.split(rows, np.searchsorted(number[order], np.arange(1, len(texts))))


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_LENGTH) -> DataFrame:
    """One row per row of ``docs``: the key, n_words, runs (array of start, length, period, by start, then
    period) and collapsed, the words that no run repeats, joined by one space.

    Words are what ASCII white space separates. A run is a stretch of words with smallest period q, of
    length ``least`` and 2 * q at least, that no neighbouring word extends. NULL and empty texts have
    no words and no runs; repeated rows and rows without a key are rows like any other. Other columns
    are not looked at. A text of any length is worked on whole, in memory linear to its words.
    """

    def result(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers = defaultdict(count().__next__)
        coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]
        runs = runs_of(coded, least)
        left = [b" ".join(w if not len(r) else [x for x, stays in zip(w, _kept(len(w), r).tolist()) if stays]) for w, r in zip(texts, runs)]
        offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        rows = np.concatenate([np.empty((0, 3), np.int64), *runs])
        structs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
        sizes = pa.array([len(w) for w in texts], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(offsets), structs)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), sizes, lists, pa.array(left, pa.binary())], names)

    def worked(batches):
        for batch in batches:
            first, size, texts = 0, 0, []
            column = batch.column("_text")
            for at in range(batch.num_rows):
                raw = column[at].as_py() or b""
                texts.append(raw.split())
                size += len(raw)
                if size >= BYTES_AT_ONCE or at == batch.num_rows - 1:
                    yield result([batch.column("_key").slice(first, at + 1 - first)], texts)
                    first, size, texts = at + 1, 0, []

    names = ["_key", "n_words", "runs", "_left"]
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    kind = chosen.schema["_key"].dataType.simpleString()
    made = chosen.mapInArrow(worked, f"_key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, _left binary")
    return made.select(F.col("_key").alias(key), "n_words", "runs", F.col("_left").cast("string").alias("collapsed"))
