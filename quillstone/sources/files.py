"""Readers, writers, previews and the dataset catalogue."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import NUMBER_PATTERN, chance, quoted
from ..functions.ordering import sorted_files
from ..session import release, stage_lines
from . import ranges

PREVIEW_ROWS = 50
# CSV fields that mean "missing".
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
ML_SAMPLE_ROWS = 100_000
# Words in a file name that decide its category, tried in order.
CATEGORY_WORDS = (("healthcare", ("healthcare", "health", "medical")), ("finance", ("finance", "financial")))
DEFAULT_CATEGORY = "business"


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; quotes are doubled inside quoted fields, usual words for "missing" are NULL.

    Without a schema each column becomes the narrowest of whole number, number, truth value and
    text that fits all its values, which takes one more pass. A schema's fields are found by name and
    put in its order; it must name every column of the header. Quoted fields may hold line breaks; tasks
    share a file all the same, see ``ranges``, at the price of one more scan. ``multi_line=False`` saves
    that for files known to have none. Lines end with a line feed, with or without a carriage return.
    """
    some = paths if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    raw = reader.csv(some)
    if multi_line:  # what Spark has read so far is the header
        raw = _parsed(ranges.records(spark, some, ranges.CSV), raw.columns)
    held = raw.select(*[F.when(~quoted(c).isin(*MISSING_WORDS), quoted(c)).alias(c) for c in raw.columns])
    if schema is not None:
        fields = schema.fields if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fields
        if sorted(f.name for f in fields) != sorted(held.columns):
            raise ValueError(f"the header has {held.columns}, the schema {[f.name for f in fields]}")
        return held.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
    kinds = _narrowest(held)
    return held.select(*[(F.trim(quoted(c)).try_cast(k) if k != "string" else quoted(c)).alias(c) for c, k in kinds.items()])


def _parsed(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of text from CSV records, without each file's header; empty lines are no records."""
    record = F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n")
    rows = found.filter("NOT first").select(record.alias("record")).filter("record <> ''")
    fields = ", ".join(f"_c{i} string" for i in range(len(names)))
    cells = rows.select(F.from_csv("record", fields, {"escape": '"'}).alias("cells"))
    return cells.select(*[F.col("cells")[f"_c{i}"].alias(name) for i, name in enumerate(names)])


def _narrowest(held: DataFrame) -> dict[str, str]:
    """The type that fits all texts of each column, from one aggregate."""
    tests = []
    for c in held.columns:
        for pattern in (r"^\s*[+-]?\d{1,18}\s*$", NUMBER_PATTERN, "^(True|False|true|false|TRUE|FALSE)$"):
            tests.append(F.count(F.when(~quoted(c).rlike(pattern), 1)))
    misfits = list(held.agg(*tests).first()) if tests else []
    out = {}
    for i, c in enumerate(held.columns):
        fits = [kind for kind, bad in zip(("long", "double", "boolean"), misfits[3 * i : 3 * i + 3]) if not bad]
        # A column without values fits everything; like an empty column of numbers it is a double.
        out[c] = "double" if len(fits) == 3 else (fits or ["string"])[0]
    return out


def holds_lines(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether JSON files hold a record per line, by the first character of each file that is not white space.

    Raises where some files hold an array and others do not.
    """
    first = spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    filled = first.select("file", "at", F.substring(F.ltrim("value"), 1, 1).alias("mark")).filter("mark <> ''")
    marks = filled.groupBy("file").agg(F.min_by("mark", "at").alias("mark")).select((F.col("mark") != "[").alias("lines")).distinct()
    found = [r["lines"] for r in marks.collect()]  # two at most
    if len(found) > 1:
        raise ValueError("some files hold an array of records, others a record per line")
    return found != [False]


def read_json(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, lines: bool | None = None) -> DataFrame:
    """A JSON array of objects per file, or one record per line; without ``lines`` the files tell.

    Tasks share a file of either kind. The objects of arrays are found by ``ranges``; without a schema they are
    written once more, a line each, as Spark reads them twice to infer one.
    """
    some = paths if isinstance(paths, str) else list(paths)
    lines = holds_lines(spark, some) if lines is None else lines
    if not lines:
        objects = ranges.records(spark, some, ranges.JSON).select(F.regexp_replace("record", r"^[\s,\[]+", "").alias("value"))
        if schema is not None:
            return objects.select(F.from_json("value", schema).alias("row")).select("row.*")
        # A line break between an object's members is white space; inside of a text JSON has none.
        some = stage_lines(objects.select(F.regexp_replace("value", r"[\r\n]", " ").alias("value")))
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(some)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By name: CSV, JSON, or Parquet otherwise."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, schema)
    if name.endswith(".json"):
        return read_json(spark, path, schema)
    return spark.read.parquet(path)


def ingest(spark: SparkSession, paths: Sequence[str], limit: int | None = None) -> list[DataFrame]:
    """One frame per file; more than ``limit`` files raise, if it is given."""
    if limit is not None and len(paths) > limit:
        raise ValueError(f"at most {limit} files, got {len(paths)}")
    return [read_any(spark, p) for p in paths]


def file_counts(frames: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Rows and columns of each file."""
    result = None
    for frame, name in zip(frames, names):
        part = frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("file"), "rows", F.lit(len(frame.columns)).cast("long").alias("columns")
        )
        result = part if result is None else result.unionByName(part)
    return result


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header, one file per partition."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """JSON, an array of objects per partition and file; NULL fields are left out."""

    def arrays(batches):
        mark = "["
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = pa.array([mark] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column("value"), "")], ["value"])
            mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    objects = df.select(F.to_json(F.struct(*[quoted(c) for c in df.columns])).alias("value"))
    objects.mapInArrow(arrays, "value string").write.mode("overwrite").text(path)


def write_stage(df: DataFrame, path: str) -> None:
    """The default between jobs: Parquet keeps types and can be pruned."""
    df.write.mode("overwrite").parquet(path)


def latest_dataset(spark: SparkSession, folder: str, prefixes: Sequence[str] = ("transformed_", "merged_")) -> str | None:
    """Newest dataset whose name starts with the first prefix that occurs.

    Only file names and times are read, not contents. A dataset is a file or a folder of parts.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "modificationTime")
        .withColumn("name", F.regexp_extract("path", r"/((?:" + "|".join(map(re.escape, prefixes)) + r")[^/]*)", 1))
        .filter(F.col("name") != "")
    )
    rank = F.lit(0)
    for i, prefix in enumerate(prefixes):
        rank = F.when(F.col("name").startswith(prefix), F.lit(len(prefixes) - i)).otherwise(rank)
    best = listed.agg(F.max_by("name", F.struct(rank, "modificationTime", "name"))).first()[0]
    return f"{folder.rstrip('/')}/{best}" if best else None


def first_rows(df: DataFrame, rows: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows, in a given order if there is one."""
    return (df.orderBy(*[quoted(c) for c in order_by]) if order_by else df).limit(rows)


def page(df: DataFrame, order_by: Sequence[str], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of an ordered table. Deep pages put all rows before them in order; see ``Pages`` and ``page_after``."""
    return df.orderBy(*[quoted(c) for c in order_by]).offset(size * number).limit(size)


class Pages:
    """A table's pages in one order, each read from the one or few files that hold it, however deep it is.

    The table is sorted and written once; the index has the positions of each written file.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str], unique: bool = False):
        self.copy, self.files = sorted_files(df, order_by, unique)
        self.order_by, self.rows = list(order_by), self.files[-1].end if self.files else 0

    def page(self, size: int, number: int) -> DataFrame:
        """Page ``number`` (from 0) with ``size`` rows, fewer on the last one, none beyond it."""
        begin, end = size * number, size * (number + 1)
        held = [f for f in self.files if f.first < end and f.end > begin]
        if not held:
            return self.copy.limit(0)
        place = F.col("_metadata.row_index")
        parts = [
            self.copy.sparkSession.read.schema(self.copy.schema).parquet(f.path).filter((place >= begin - f.first) & (place < end - f.first)) for f in held
        ]
        return reduce(DataFrame.unionByName, parts).orderBy(*[quoted(c) for c in self.order_by])

    def release(self) -> None:
        release(self.copy)


def page_after(df: DataFrame, order_by: Sequence[str], size: int, last: Sequence | None = None) -> DataFrame:
    """The page after the row whose ``order_by`` values are ``last``, or the first page.

    However deep the page is, only ``size`` rows of each task are put in order. The columns must hold
    no NULL, and name each row once.
    """
    columns = [quoted(c) for c in order_by]
    later = df if last is None else df.filter(F.struct(*columns) > F.struct(*[F.lit(v).alias(c) for v, c in zip(last, order_by)]))
    return later.orderBy(*columns).limit(size)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows with every value as text; NULL stays NULL."""
    head = first_rows(df, rows, order_by)
    return head.select(*[quoted(c).cast("string").alias(c) for c in df.columns])


def export_text(df: DataFrame, blank: str = "N/A") -> DataFrame:
    """Every value as text, NULL as ``blank``."""
    return df.select(*[F.coalesce(quoted(c).cast("string"), F.lit(blank)).alias(c) for c in df.columns])


def stable_sample(df: DataFrame, keys: Sequence[str], rows: int = ML_SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """A fixed number of rows with the lowest draws by their keys: the same rows on every run.

    In a large table only rows with a low draw are put in order, about twice as many as wanted.
    """
    columns = [quoted(k) for k in keys]
    draw = chance(columns, seed, "sample")
    pool = df
    total = df.count()
    if total > 4 * rows:
        near = df.filter(draw < 2.0 * rows / total)
        # Keys that repeat a lot may leave too few rows below the bound.
        pool = near if near.count() >= rows else df
    return pool.orderBy(draw, *columns).limit(rows)


def catalogue_search(df: DataFrame, query: str, texts: Sequence[str], keywords: str | None = None) -> DataFrame:
    """Entries whose joined text fields hold the query, in any letter case; two letters at least."""
    needle = query.strip().lower()
    if len(needle) < 2:
        return df.limit(0)
    fields = [F.coalesce(quoted(t), F.lit("")) for t in texts]
    if keywords:
        fields.append(F.array_join(quoted(keywords), " "))
    return df.filter(F.lower(F.concat_ws(" ", *fields)).contains(needle))


def catalogue_entry(df: DataFrame, filename: str) -> DataFrame:
    """Id, display name, category and keywords derived from a file name."""
    name = quoted(filename)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "[_-]", " ")
    pieces = F.split(stem, r"(?<=\W)")
    titled = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    lowered = F.lower(name)
    category: Column = F.lit(DEFAULT_CATEGORY)
    for label, tokens in reversed(CATEGORY_WORDS):
        held = F.lit(False)
        for token in tokens:
            held = held | lowered.contains(token)
        category = F.when(held, label).otherwise(category)
    parts = F.filter(F.split(name, r"[_\s.-]+"), lambda w: F.length(w) > 2)
    return df.select(
        name.alias("filename"),
        F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", "_")).alias("id"),
        titled.alias("name"),
        category.alias("category"),
        F.concat(F.array(category), F.transform(parts, F.lower)).alias("keywords"),
    )
