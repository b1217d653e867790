"""Grouped helpers: per-key values put back on rows, category codes, frequency tables, pair counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import stage_table
from .columns import is_numeric, quoted
from .ordering import row_index

SMALL_CATEGORIES, SMALL_BYTES = 100_000, 16 << 20
SKETCH_BITS, SKETCH_MARGIN = 12, 1.1
PAIR_BLOCK, PAIR_ROWS = 256, 256


def with_group_value(df: DataFrame, key: str, **values: Column) -> DataFrame:
    """Put per-key aggregates on every row; rows without a key get NULL.

    Aggregation combines before the shuffle, and the join has one row per key on the other
    side, so adaptive execution can split a hot key. A window would pull it into one task.
    """
    grouped = df.filter(quoted(key).isNotNull()).groupBy(quoted(key).alias("_key")).agg(
        *[expr.alias(name) for name, expr in values.items()]
    )
    return df.join(grouped, quoted(key) == F.col("_key"), "left").drop("_key")


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null values of several columns as (column, value) rows, values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over several columns in one pass."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_per(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows per group before it shuffles."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def distinct_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values of each column, counted over a long table."""
    return sizes_of(long_values(df, columns).distinct(), columns) if columns else {}


def sizes_of(values: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Rows of each column in a table of distinct (column, value)."""
    sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: sizes.get(c, 0) for c in columns}


def estimated_sizes(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, float]]:
    """Rows, and about how many distinct non-null values each column has: a sketch per column, in one scan.

    The estimate is off by more than ``SKETCH_MARGIN`` once in some ten million columns.
    """
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(quoted(c).cast("string"), F.lit(SKETCH_BITS))) for c in columns]
    rows, *sizes = df.agg(F.count(F.lit(1)), *sketches).first()
    return rows, {c: float(n or 0) for c, n in zip(columns, sizes)}


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct (column, value, number) of all columns, a staged table; numbers order the values of numeric columns."""
    cells = [
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"), (quoted(c) if is_numeric(df.schema[c].dataType) else F.lit(None)).cast("double").alias("number"))
        for c in columns
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, value string, number double")
    return stage_table(df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).distinct())


def with_codes(
    df: DataFrame, values: DataFrame, columns: Sequence[str], suffix: str = "_Encoded", missing: Mapping[str, int] | int | None = -1
) -> DataFrame:
    """Add ``<column>_Encoded`` for each column: 0, 1, … in value order; NULL gets ``missing`` (by default -1).

    ``values`` is a ``dictionary`` that has these columns. It is sorted once for all of them. Columns of few
    values are coded together in one pass over the rows, with a dictionary of at most ``SMALL_CATEGORIES``
    values and ``SMALL_BYTES`` in each task; any other column's codes are joined to it.
    """
    if not columns:
        return df
    wanted = values.filter(F.col("column").isin(list(columns)))
    sizes = {r["column"]: r for r in wanted.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")).collect()}
    small, n, held = [], 0, 0
    for c in sorted(sizes, key=lambda c: (sizes[c]["n"], c)):
        n, held = n + sizes[c]["n"], held + sizes[c]["bytes"]
        if n <= SMALL_CATEGORIES and held <= SMALL_BYTES:
            small.append(c)
    large = [c for c in columns if c in sizes and c not in small]
    rest = dict.fromkeys(columns, missing) if not isinstance(missing, Mapping) else missing
    out = _coded_together(df, wanted.filter(F.col("column").isin(small)), [c for c in columns if c not in large], suffix, rest)
    if large:
        placed = row_index(wanted.filter(F.col("column").isin(large)), ["column", "number", "value"], "place", unique=True)
        first = {r["column"]: r["first"] for r in placed.groupBy("column").agg(F.min("place").alias("first")).collect()}
        for c in large:
            codes = placed.filter(F.col("column") == c).select(F.col("value").alias("_value"), (F.col("place") - first[c]).alias("_code"))
            out = out.join(codes, quoted(c).cast("string") == F.col("_value"), "left").drop("_value")
            code = F.col("_code") if rest[c] is None else F.coalesce(F.col("_code"), F.lit(rest[c]))
            out = out.withColumn(c + suffix, code).drop("_code")
    return out.select(*[quoted(c) for c in df.columns if c not in {x + suffix for x in columns}], *[quoted(c + suffix) for c in columns])


def _coded_together(df: DataFrame, values: DataFrame, columns: Sequence[str], suffix: str, missing: Mapping[str, int | None]) -> DataFrame:
    # SMALL_CATEGORIES rows and SMALL_BYTES at most.
    rows = values.orderBy("column", "number", "value").collect()
    texts = {c: pa.array([r["value"] for r in rows if r["column"] == c], pa.string()) for c in columns}
    kept = [c for c in df.columns if c not in {x + suffix for x in columns}]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, c in enumerate(columns):
                code = pc.index_in(batch.column(len(kept) + i).cast(pa.string()), value_set=texts[c], skip_nulls=True).cast(pa.int64())
                made.append(code if missing[c] is None else pc.fill_null(code, missing[c]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names)

    names = [*kept, *(c + suffix for c in columns)]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c + suffix, T.LongType()) for c in columns)])
    asked = df.select(*[quoted(c) for c in kept], *[quoted(c).cast("string").alias(f"_text{i}") for i, c in enumerate(columns)])
    return asked.mapInArrow(coded, schema) if columns else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of lists of (slot, amount), and their values."""
    flat = column.flatten()
    return np.diff(column.offsets.to_numpy()), flat.field("slot").to_numpy(), flat.field("amount").to_numpy()


def _add_products(total: np.ndarray, left: pa.Array, right: pa.Array) -> None:
    """Add the sum over rows of left amounts times right amounts to ``total``, by slots."""
    (n, a, x), (m, b, y) = _cells(left), _cells(right)
    block = len(total)
    pairs = n.astype(np.int64) * m
    if 16 * pairs.sum() > len(n) * block * block:  # full rows: as matrices
        sides = []
        for sizes, slots, amounts in ((n, a, x), (m, b, y)):
            side = np.zeros((len(sizes), block))
            side[np.repeat(np.arange(len(sizes)), sizes), slots] = amounts
            sides.append(side)
        total += sides[0].T @ sides[1]
        return
    # Each left value meets the right values of its row.
    meets = np.repeat(m, n)
    first = np.repeat(np.cumsum(m) - m, n)
    one = np.repeat(np.arange(len(a)), meets)
    other = np.repeat(first - (np.cumsum(meets) - meets), meets) + np.arange(len(one))
    np.add.at(total, (a[one], b[other]), x[one] * y[other])


def pair_products(df: DataFrame, owner: str, slot: str, amount: str, block: int = PAIR_BLOCK, least: int = 0) -> DataFrame:
    """(a, b, total): for slots a <= b, b at least ``least``, the sum over owners of amount[a] * amount[b].

    ``df`` has a slot of an owner once. Slots are cut into blocks; an owner's slots of a block are one row,
    and such rows meet for each pair of the owner's blocks. A task goes through one pair of blocks after
    another and adds up block by block products, so it holds one of those at a time, however many
    slots there are, and only sums leave it.
    """
    placed = df.select(
        F.col(owner).alias("owner"), F.floor(F.col(slot) / block).alias("block"),
        F.struct((F.col(slot) % block).cast("int").alias("slot"), F.col(amount).cast("double").alias("amount")).alias("cell"),
    )
    # At most ``block`` cells a row; all of an owner's rows meet without another exchange.
    rows = placed.repartition("owner").groupBy("owner", "block").agg(F.collect_list("cell").alias("cells"))
    left = rows.select("owner", F.col("block").alias("i"), F.col("cells").alias("left"))
    right = rows.filter((F.col("block") + 1) * block > least).select("owner", F.col("block").alias("j"), F.col("cells").alias("right"))
    paired = left.join(right, "owner").filter("i <= j").select("i", "j", "left", "right").sortWithinPartitions("i", "j")

    def sums(total: np.ndarray, i: int, j: int) -> pa.RecordBatch:
        a, b = np.nonzero(np.triu(total) if i == j else total)
        part = total[a, b]
        a, b = a + i * block, b + j * block
        kept = b >= least
        return pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (a, b, part)], ["a", "b", "part"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros((block, block)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            edges = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, len(i)]):
                if now != (i[begin], j[begin]):
                    if now is not None:
                        yield sums(total, *now)
                        total[:] = 0
                    now = i[begin], j[begin]
                for at in range(begin, end, PAIR_ROWS):
                    part = batch.slice(at, min(PAIR_ROWS, end - at))
                    _add_products(total, part.column("left"), part.column("right"))
        if now is not None:
            yield sums(total, *now)

    parts = paired.mapInArrow(add_up, "a long, b long, part double")
    return parts.groupBy("a", "b").agg(F.sum("part").alias("total"))
