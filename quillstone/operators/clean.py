"""Merging and cleaning jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import as_double, day_first, is_missing, quoted, strip, to_time
from ..functions.grouping import numeric_columns, text_columns, top_per, value_counts
from ..functions.ordering import fill_missing, sorted_files
from ..functions.quantiles import exact_quantiles
from ..session import open_path, release, stage_table
from .profile import _quality_row

UNKNOWN = "Unknown"
MERGED_ROWS = 8_192  # of each frame in memory together


def merge_side_by_side(frames: Sequence[DataFrame], order_by: Sequence[Sequence[str]], unique: bool = False) -> DataFrame:
    """Put frames next to each other by row position.

    A column that is already there becomes ``<column>_file<i>``. Rows beyond the first frame
    are dropped, shorter frames are padded with NULL.

    Each frame is sorted and written out once, which tells the positions every written file holds. A task
    then reads one file of the first frame and the same positions of the others' files beside it, some
    rows of each at a time; no row goes through a join.
    """
    spark = frames[0].sparkSession
    sorted_ = [sorted_files(frame, order, unique) for frame, order in zip(frames, order_by)]
    fields, taken = [], set()
    for i, frame in enumerate(frames, start=1):
        for field in frame.schema:
            name = f"{field.name}_file{i}" if field.name in taken else field.name
            fields.append(T.StructField(name, field.dataType))
        taken = {f.name for f in fields}
    schema = T.StructType(fields)
    kinds = [to_arrow_schema(frame.schema) for frame in frames]
    names = [f.name for f in fields]
    files = [[(f.path, f.first, f.end) for f in files] for _, files in sorted_]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                _, begin, end = files[0][number]
                readers = [_rows_of(held, kind, begin, end) for held, kind in zip(files, kinds)]
                for parts in zip(*readers):
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() for part in parts for c in part.columns], names)

    ranges = spark.range(0, len(files[0]), 1, max(1, len(files[0])))
    merged = stage_table(ranges.mapInArrow(beside, schema))
    release(*(copy for copy, _ in sorted_))
    return merged


def _rows_of(files: Sequence[tuple[str, int, int]], kind: pa.Schema, begin: int, end: int) -> Iterator[pa.Table]:
    """The rows at positions from ``begin`` to ``end``, ``MERGED_ROWS`` at a time; rows of NULL beyond the last file."""
    held, at = [], begin

    def blocks() -> Iterator[pa.Table]:
        for path, first, last in files:
            if first >= end or last <= begin:
                continue
            system, name = open_path(path)
            with system.open_input_file(name) as source:
                file, place, groups = pq.ParquetFile(source), first, []
                for group in range(file.num_row_groups):
                    after = place + file.metadata.row_group(group).num_rows
                    if place < end and after > begin:
                        groups.append((group, place))
                    place = after
                if not groups:
                    continue
                place = groups[0][1]
                for batch in file.iter_batches(MERGED_ROWS, row_groups=[g for g, _ in groups]):
                    low, high = max(begin - place, 0), min(end - place, batch.num_rows)
                    place += batch.num_rows
                    if low < high:
                        yield pa.Table.from_batches([batch.slice(low, high - low)]).cast(kind)

    source = blocks()
    while at < end:
        want, have = min(MERGED_ROWS, end - at), sum(t.num_rows for t in held)
        while have < want:
            more = next(source, None)
            if more is None:
                more = pa.Table.from_arrays([pa.nulls(want - have, f.type) for f in kind], schema=kind)
            held.append(more)
            have += more.num_rows
        every = pa.concat_tables(held)
        yield every.slice(0, want)
        held = [every.slice(want)] if have > want else []
        at += want


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all floating columns."""
    return df.select(
        *[F.when(~is_missing(quoted(f.name), f.dataType), quoted(f.name)).alias(f.name) for f in df.schema]
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def fill_means(df: DataFrame) -> DataFrame:
    """Missing numbers become the column mean; all means come from one aggregate."""
    names = numeric_columns(df)
    if not names:
        return df
    values = {n: as_double(quoted(n), df.schema[n].dataType) for n in names}
    means = df.agg(*[F.avg(v) for v in values.values()]).first()
    filled = {n: F.coalesce(values[n], F.lit(m).cast("double")) for n, m in zip(names, means)}
    return df.select(*[filled.get(c, quoted(c)).alias(c) for c in df.columns])


def dates_where_whole(df: DataFrame) -> DataFrame:
    """Text columns in which every value reads as a date become timestamps; others stay."""
    names = text_columns(df)
    if not names:
        return df
    late = day_first(df, names)
    times = {n: to_time(quoted(n), n in late) for n in names}
    failures = [F.count(F.when(quoted(n).isNotNull() & times[n].isNull(), 1)) for n in names]
    row = df.agg(*failures, *[F.count(quoted(n)) for n in names]).first()
    whole = {n for i, n in enumerate(names) if row[i] == 0 and row[len(names) + i] > 0}
    return df.select(*[(times[c] if c in whole else quoted(c)).alias(c) for c in df.columns])


def clean_business(
    df: DataFrame,
    remove_duplicates: bool = False,
    handle_missing: str | None = None,
    fill_method: str = "forward",
    standardize_formats: bool = False,
    order_by: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Duplicates out, then missing values dropped or filled, then date texts converted.

    Forward and backward fill need ``order_by``, because a distributed table has no row order.
    """
    out = nan_to_null(df)
    if remove_duplicates:
        out = drop_duplicates(out)
    if handle_missing == "drop":
        out = out.na.drop("any")
    elif handle_missing == "fill" and fill_method == "mean":
        out = fill_means(out)
    elif handle_missing == "fill":
        if not order_by:
            raise ValueError("forward and backward fill need order_by")
        filled = [c for c in out.columns if c not in order_by]
        out = fill_missing(out, order_by, filled, forward=fill_method == "forward", unique=unique)
    return dates_where_whole(out) if standardize_formats else out


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent text of each column, the smallest one among ties."""
    if not columns:
        return {}
    top = top_per(value_counts(df, columns), ["column"], [F.desc("n"), F.asc("value")], 1)
    return {r["column"]: r["value"] for r in top.select("column", "value").collect()}


def clean_healthcare(
    df: DataFrame, handle_missing: str | None = "fill", remove_duplicates: bool = True, standardize_text: bool = True
) -> DataFrame:
    """Numbers filled with the median, texts with the most frequent one, duplicates out, texts trimmed."""
    out = nan_to_null(df)
    texts = text_columns(out)
    if handle_missing == "fill":
        row = out.agg(*[F.count(F.when(quoted(c).isNull(), 1)) for c in out.columns]).first()
        gapped = [c for c, n in zip(out.columns, row) if n]
        medians = exact_quantiles(out, {c: [0.5] for c in gapped if c in numeric_columns(out)})
        modes = most_frequent(out, [c for c in gapped if c in texts])
        filled = {
            c: F.coalesce(as_double(quoted(c), out.schema[c].dataType), F.lit(m[0]).cast("double")) for c, m in medians.items()
        }
        filled |= {c: F.coalesce(quoted(c), F.lit(modes.get(c, UNKNOWN))) for c in gapped if c in texts}
        out = out.select(*[filled.get(c, quoted(c)).alias(c) for c in out.columns])
    if remove_duplicates:
        out = drop_duplicates(out)
    if standardize_text:
        out = out.select(*[(strip(quoted(c)) if c in texts else quoted(c)).alias(c) for c in out.columns])
    return out


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after, rows removed, missing cells and duplicates found."""
    none = F.lit(None).cast("long")
    found = _quality_row(before).select("rows", "missing", "duplicates", none.alias("kept"))
    kept = after.agg(F.count(F.lit(1)).alias("kept")).select(
        none.alias("rows"), none.alias("missing"), none.alias("duplicates"), "kept"
    )
    row = found.unionByName(kept).agg(*[F.max(c).alias(c) for c in ("rows", "missing", "duplicates", "kept")])
    return row.select(
        F.col("rows").alias("original_rows"),
        F.col("kept").alias("cleaned_rows"),
        (F.col("rows") - F.col("kept")).alias("rows_removed"),
        F.col("missing").alias("missing_values_found"),
        F.col("duplicates").alias("duplicate_rows_found"),
    )
