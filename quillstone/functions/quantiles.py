"""Exact order statistics without a sort or a big buffer, in as many passes for one column as for many.

``percentile`` keeps every distinct value of a group in one buffer, which does not fit for a
large column. Here values are read as whole numbers of 64 bits in the same order, and wanted ranks are
followed digit by digit, 12 bits at a time: a pass counts, for all columns and ranks together, the
values of each next digit under the digits found so far, with the smallest and largest of them. A
rank whose digit holds one value only is found; the others go on, until the values left are few
enough to be put in order at once. Six passes tell any value; what reaches the driver is a few
numbers per wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import release, stage_table
from .columns import as_double, quoted

DIRECT_ROWS = 100_000
#: Bits below the digits known after each pass.
LEVELS = (52, 40, 28, 16, 4, 0)
COUNTS_KEPT = 1 << 16  # by a task and column before they are added up


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; -0.0 is 0.0."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ (bits >> 63 & 0x7FFFFFFFFFFFFFFF)


def _value(key: int) -> float:
    return float(np.array([key ^ (key >> 63 & 0x7FFFFFFFFFFFFFFF)], np.int64).view(np.float64)[0])


def _plain(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The wanted columns as doubles called q0, q1, …"""
    return df.select(*[as_double(quoted(n), df.schema[n].dataType).alias(f"q{i}") for i, n in enumerate(names)])


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    direct_rows: int = DIRECT_ROWS,
    sizes: Sequence[int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several numeric columns, as plain numbers.

    ``sizes`` are the columns' non-missing counts where the caller knows them already.
    """
    names = list(wanted)
    if not names:
        return {}
    plain = _plain(df, names)
    search = _Search(plain, direct_rows)
    sizes = search.sizes() if sizes is None else list(sizes)
    places = [[(n - 1) * p for p in wanted[name]] for name, n in zip(names, sizes)]
    ranks = {i: {r for h in places[i] for r in (math.floor(h), math.ceil(h))} for i in range(len(names)) if sizes[i]}
    values = search.values(ranks, sizes)
    result: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        found = []
        for h in places[i] if sizes[i] else []:
            low, high = values[i, math.floor(h)], values[i, math.ceil(h)]
            found.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        result[name] = found or [None] * len(wanted[name])
    return result


def value_at_rank(
    df: DataFrame, name: str, rank: int, direct_rows: int = DIRECT_ROWS, size: int | None = None
) -> float | None:
    """The value at a 0-based position of the sorted column."""
    search = _Search(_plain(df, [name]), direct_rows)
    size = search.sizes()[0] if size is None else size
    return search.values({0: {rank}}, [size])[0, rank] if 0 <= rank < size else None


def _columns(batch: pa.RecordBatch, opened: Mapping[int, np.ndarray | None], level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, digits, keys) of the values under the opened digits, sorted; None opens a whole column."""
    for i, parents in opened.items():
        values = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
        keys = np.sort(ordered_keys(values[~np.isnan(values)]))
        if parents is not None:
            keys = keys[np.isin(keys >> level, parents)]
        if len(keys):
            yield i, keys >> level, keys


def _added(digit: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(digit, kind="stable")
    digit, n, low, high = digit[order], n[order], low[order], high[order]
    first = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
    return digit[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


class _Search:
    def __init__(self, plain: DataFrame, direct_rows: int):
        self.plain, self.direct_rows = plain, direct_rows
        self.first: DataFrame | None = None

    def _counted(self, opened: Mapping[int, np.ndarray | None], above: int, level: int) -> DataFrame:
        """(col, digit, n, low, high) over all tasks of the values under ``opened`` digits of the level above."""

        def counted(batches):
            held: dict[int, list[tuple[np.ndarray, ...]]] = {}

            def batch_of(i: int) -> pa.RecordBatch:
                parts = _added(*map(np.concatenate, zip(*held[i])))
                held[i] = []
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts[0]), i, np.int32)), *map(pa.array, parts)], ["col", "digit", "n", "low", "high"])

            for batch in batches:
                for i, _, keys in _columns(batch, opened, above):
                    held.setdefault(i, []).append(_added(keys >> level, np.ones(len(keys), np.int64), keys, keys))
                    if sum(len(p[0]) for p in held[i]) > COUNTS_KEPT:
                        yield batch_of(i)
            for i in held:
                if held[i]:
                    yield batch_of(i)

        made = self.plain.mapInArrow(counted, "col int, digit long, n long, low long, high long")
        return made.groupBy("col", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def _start(self) -> DataFrame:
        if self.first is None:
            self.first = stage_table(self._counted({i: None for i in range(len(self.plain.columns))}, 0, LEVELS[0]))
        return self.first

    def sizes(self) -> list[int]:
        found = {r["col"]: r["n"] for r in self._start().groupBy("col").agg(F.sum("n").alias("n")).collect()}
        return [found.get(i, 0) for i in range(len(self.plain.columns))]

    def values(self, ranks: Mapping[int, Iterable[int]], sizes: Sequence[int]) -> dict[tuple[int, int], float]:
        """The values at (column, rank) for every wanted rank."""
        found: dict[tuple[int, int], float] = {}
        # (column, rank) -> digits so far, and the rank among the values under them.
        open_ = {(i, r): (0, r) for i, some in ranks.items() for r in some}
        left = sum(sizes[i] for i in ranks)
        above: int | None = None
        for level in LEVELS:
            if not open_ or left <= self.direct_rows:
                break
            opened = self._opened(open_, above)
            counted = self._start() if above is None else self._counted(opened, above, level)
            parent = F.lit(0).cast("long") if above is None else F.shiftright("digit", above - level)
            order = Window.partitionBy("col", "parent").orderBy("digit")
            upto = counted.withColumn("parent", parent).withColumn("upto", F.sum("n").over(order))
            hits = upto.join(F.broadcast(self._wanted(open_)), ["col", "parent"]).filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
            after, left = {}, 0
            counts: dict[tuple[int, int], int] = {}
            for r in hits.collect():  # a row per wanted rank
                if r["low"] == r["high"]:
                    found[r["col"], r["rank"]] = _value(r["low"])
                else:
                    after[r["col"], r["rank"]] = r["digit"], r["place"] - r["upto"] + r["n"]
                    counts[r["col"], r["digit"]] = r["n"]
            open_, left, above = after, sum(counts.values()), level
        if open_:
            found |= self._direct(open_, above)
        if self.first is not None:
            release(self.first)
            self.first = None
        return found

    def _opened(self, open_: Mapping[tuple[int, int], tuple[int, int]], above: int | None) -> dict[int, np.ndarray | None]:
        columns = sorted({i for i, _ in open_})
        if above is None:
            return dict.fromkeys(columns)
        return {i: np.unique([digit for (j, _), (digit, _) in open_.items() if i == j]) for i in columns}

    def _wanted(self, open_: Mapping[tuple[int, int], tuple[int, int]]) -> DataFrame:
        rows = [(i, r, digit, place) for (i, r), (digit, place) in open_.items()]
        return self.plain.sparkSession.createDataFrame(rows, "col int, rank long, parent long, place long")

    def _direct(self, open_: Mapping[tuple[int, int], tuple[int, int]], above: int | None) -> dict[tuple[int, int], float]:
        """All values that are left, ``direct_rows`` at most, in order."""
        opened = self._opened(open_, above)

        def kept(batches):
            for batch in batches:
                for i, digits, keys in _columns(batch, opened, above or 0):
                    parent = digits if above is not None else np.zeros(len(keys), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(parent), pa.array(keys)], ["col", "parent", "key"])

        values = self.plain.mapInArrow(kept, "col int, parent long, key long")
        placed = values.withColumn("place", F.row_number().over(Window.partitionBy("col", "parent").orderBy("key")).cast("long") - 1)
        hits = placed.join(F.broadcast(self._wanted(open_)), ["col", "parent", "place"])
        return {(r["col"], r["rank"]): _value(r["key"]) for r in hits.collect()}
