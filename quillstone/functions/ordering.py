"""Row positions, fills and rolling windows over one global order.

The order is made by one distributed sort whose result is written out. Positions then come from
the row's place inside its file plus the sizes of the files before it, so no window ever runs
over the whole table in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table
from .columns import quoted

COPIES_PER_TASK = 1_000_000
ROLLING_BLOCK = 100_000
FILL_BLOCK = 1_000_000
_PLACE, _PART, _BLOCK = "_place", "_part", "_block"


def number_copies(df: DataFrame, name: str = "_copy") -> DataFrame:
    """Number the exact copies of each row 0, 1, …

    Copies are counted before they are shuffled as rows. A row with very many copies is
    written out again in pieces spread over tasks, so copies never pile up in one of them.
    """
    cols = [quoted(c) for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.filter(F.col("_n") <= COPIES_PER_TASK).select(
        *cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias(name)
    )
    start = F.col("_piece") * COPIES_PER_TASK
    many = (
        counted.filter(F.col("_n") > COPIES_PER_TASK)
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK))))
        .repartition(F.col("_piece"), F.xxhash64(*cols))
        .select(*cols, F.explode(F.sequence(start, F.least(start + COPIES_PER_TASK, F.col("_n")) - 1)).alias(name))
    )
    return few.unionByName(many)


def _in_order(df: DataFrame, order_by: Sequence[str | Column], unique: bool) -> DataFrame:
    """Sorted rows, written out, with the number of their file and the place inside it."""
    return _marked(df, order_by, unique)[0].drop("_file")


def _marked(df: DataFrame, order_by: Sequence[str | Column], unique: bool) -> tuple[DataFrame, DataFrame]:
    """The same with the path of the file too, and the written table itself."""
    first = [quoted(c) if isinstance(c, str) else c for c in order_by]
    if unique:
        ordered = df.orderBy(*first)
    else:
        numbered = number_copies(df)
        ordered = numbered.orderBy(*first, *[quoted(c) for c in df.columns], F.col("_copy")).drop("_copy")
    # File names look like part-00012-…-c000.parquet: the sorted partition, then a counter inside it.
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    part = number(r"^part-(\d+)-") * 1_000_000 + number(r"-c(\d+)\.")
    copy = stage_table(ordered)
    return copy.select("*", part.alias(_PART), F.col("_metadata.row_index").alias(_PLACE), F.col("_metadata.file_path").alias("_file")), copy


@dataclass(frozen=True)
class SortedFile:
    path: str
    first: int  # position of its first row
    rows: int

    @property
    def end(self) -> int:
        return self.first + self.rows


def sorted_files(df: DataFrame, order_by: Sequence[str | Column], unique: bool = False) -> tuple[DataFrame, list[SortedFile]]:
    """A sorted copy in the shared folder, and its files in order with the positions they hold: a sparse
    index, an entry per sort partition. The copy is to be released."""
    marked, copy = _marked(df, order_by, unique)
    sizes = marked.groupBy(_PART, F.col("_file")).agg(F.count(F.lit(1)).alias("rows")).orderBy(_PART).collect()
    files, first = [], 0
    for r in sizes:
        files.append(SortedFile(r["_file"], first, r["rows"]))
        first += r["rows"]
    return copy, files


def row_index(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index", unique: bool = False
) -> DataFrame:
    """Add the 0-based position under ``order_by``; other columns break ties.

    ``unique`` promises that ``order_by`` tells all rows apart, which saves counting copies.
    """
    marked = _in_order(df, order_by, unique)
    sizes = marked.groupBy(_PART).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file of the sort, so the window and the broadcast are small.
    starts = sizes.select(_PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return marked.join(F.broadcast(starts), _PART).withColumn(name, F.col("_start") + F.col(_PLACE)).drop(
        _PART, _PLACE, "_start"
    )


def fill_missing(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str], forward: bool = True, unique: bool = False
) -> DataFrame:
    """Fill NULLs with the last (or next) value in the given order.

    Each block of ``FILL_BLOCK`` places of a file of the sort fills itself; what comes from outside
    it is one carried value per column and block.
    """
    if not columns:
        return df
    marked = _in_order(df, order_by, unique).withColumn(_BLOCK, F.floor(F.col(_PLACE) / FILL_BLOCK))
    pick = F.max_by if forward else F.min_by
    edges = marked.groupBy(_PART, _BLOCK).agg(
        *[pick(quoted(c), F.when(quoted(c).isNotNull(), F.col(_PLACE))).alias(f"_edge{i}") for i, c in enumerate(columns)]
    )
    # One row per block.
    blocks = Window.orderBy(*[F.col(c).asc() if forward else F.col(c).desc() for c in (_PART, _BLOCK)])
    outside = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        _PART, _BLOCK, *[F.last(f"_edge{i}", True).over(outside).alias(f"_carry{i}") for i in range(len(columns))]
    )
    inside = (
        Window.partitionBy(_PART, _BLOCK)
        .orderBy(F.col(_PLACE).asc() if forward else F.col(_PLACE).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = marked.join(carried, [_PART, _BLOCK])
    values = {
        c: F.coalesce(F.last(quoted(c), True).over(inside), F.col(f"_carry{i}")) for i, c in enumerate(columns)
    }
    return filled.select(*[(values[c] if c in values else quoted(c)).alias(c) for c in df.columns])


def rolling_std(
    df: DataFrame, value: str, index: str, keys: Sequence[str] = (), width: int = 12, name: str = "rolling_std"
) -> DataFrame:
    """Sample deviation over the last ``width`` rows by ``index``.

    Rows are cut into blocks by index; each block also gets the ``width - 1`` rows before it,
    which are dropped again afterwards.
    """
    block = F.floor(F.col(index) / ROLLING_BLOCK)
    late = F.col(index) % ROLLING_BLOCK > ROLLING_BLOCK - width
    spread = df.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    window = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(1 - width, 0)
    rolled = spread.withColumn(name, F.stddev_samp(quoted(value)).over(window))
    return rolled.filter(F.col("_block") == block).drop("_block")
