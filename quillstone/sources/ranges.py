"""Records of large CSV and JSON array files, found by many tasks at once.

Spark deals a file out in byte ranges, cut at a separator: line breaks for CSV, closing braces for JSON.
Whether such a piece starts a record depends on all before it, on an open quote or on the brackets
still open. So a first scan finds for each range, for either start inside and outside of a quoted
text, how it would end; prefixes over the ranges of a file then tell how each really starts,
and a second scan cuts every range into records. What lies across the border of ranges comes out in
parts, two a range at most, which are put together by range order. Parsing stays with Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import stage_table

#: Where a record is complete: outside of quotes, with so many brackets open.
State = tuple[int, int]  # 1 inside of a quoted text, open brackets


@dataclass(frozen=True)
class Form:
    separator: str
    #: (piece, 1 if it starts inside of quotes) -> (the same of its end, change of open brackets)
    step: Callable[[bytes, int], State]
    depth: int  # of brackets open between records
    closing: bytes  # what the separator adds to a piece


def csv_step(line: bytes, inside: int) -> State:
    """Fields in quotes start right after a comma or the line's start; a doubled quote is a quote."""
    if b'"' not in line:
        return inside, 0
    at = 0
    while True:
        if inside:
            end = _QUOTED.match(line, at).end()
            if end == len(line):
                return 1, 0
            at = line.find(b",", end + 1) + 1
        elif line.startswith(b'"', at):
            at, inside = at + 1, 1
            continue
        else:
            at = line.find(b",", at) + 1
        inside = 0
        if not at:
            return 0, 0


_QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+')
_ESCAPED = re.compile(rb"\\.", re.S)


def json_step(piece: bytes, inside: int) -> State:
    """A piece that ends with a closing brace; brackets inside of quotes do not count."""
    if b"\\" in piece:
        piece = _ESCAPED.sub(b"", piece)
    parts = piece.split(b'"')
    outside = parts[inside::2]
    change = sum(p.count(b"{") + p.count(b"[") - p.count(b"}") - p.count(b"]") for p in outside)
    return inside ^ (len(parts) - 1) & 1, change


CSV = Form("\n", csv_step, 0, b"")
JSON = Form("}", json_step, 1, b"}")


def _pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(file, range, piece) in the order of each file's range; ``range`` is its first byte."""
    text = spark.read.option("lineSep", separator).text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("piece")
    )


def _ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of each range, in parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("range").to_numpy()
        code = batch.column("file").dictionary_encode()
        file = code.indices.to_numpy()
        edges = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(start)]):
            yield code.dictionary[int(file[a])].as_py(), int(start[a]), batch.slice(a, b - a)


def _starts(pieces: DataFrame, form: Form) -> DataFrame:
    """(file, range, inside, open): how each range starts; a row per range."""

    def ends(batches):
        now, ways = None, []

        def row():
            (e0, d0), (e1, d1) = ways
            return pa.RecordBatch.from_pylist([{"file": now[0], "range": now[1], "e0": e0, "d0": d0, "e1": e1, "d1": d1}], _ENDS)

        for file, start, rows in _ranges_of(batches):
            if now != (file, start):
                if now is not None:
                    yield row()
                now, ways = (file, start), [(0, 0), (1, 0)]
            for piece in rows.column("piece").to_pylist():
                piece += form.closing
                for way in (0, 1):
                    inside, depth = ways[way]
                    inside, change = form.step(piece, inside)
                    ways[way] = inside, depth + change
        if now is not None:
            yield row()

    found = stage_table(pieces.mapInArrow(ends, "file string, range long, e0 int, d0 long, e1 int, d1 long"))
    order = Window.partitionBy("file").orderBy("range")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # A range may end as it began, the other way round, or in one way however it began.
    turns = F.sum(((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")).over(upto)
    sure = F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("end"), "turns"))
    known = found.withColumn("turns", turns).withColumn("sure", F.last(sure, True).over(before))
    turned = F.coalesce(F.lag("turns").over(order), F.lit(0)) - F.coalesce(F.col("sure.turns"), F.lit(0))
    inside = F.pmod(F.coalesce(F.col("sure.end"), F.lit(0)) + turned, F.lit(2)).cast("int")
    placed = known.withColumn("inside", inside).withColumn("change", F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0")))
    return stage_table(placed.select("file", "range", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("open")))


_ENDS = pa.schema([("file", pa.string()), ("range", pa.int64()), ("e0", pa.int32()), ("d0", pa.int64()), ("e1", pa.int32()), ("d1", pa.int64())])
_RECORDS = pa.schema([("file", pa.string()), ("range", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("record", pa.binary())])


def records(spark: SparkSession, paths: str | list[str], form: Form) -> DataFrame:
    """(record, first, file) as text; ``first`` marks a file's first record. No order is kept.

    What follows the last complete record of a file is a record too for CSV, as with a quote that is never
    closed. For JSON it is dropped; an object at a file's end that lacks just its closing brace gets it.
    A record is held whole by one task.
    """
    pieces = _pieces(spark, paths, form.separator)
    # A row per byte range, of 128 MB by default.
    starts = F.broadcast(_starts(pieces, form))
    joined = pieces.join(starts, ["file", "range"])

    separator = form.separator.encode()

    def cut(batches):
        now, held, inside, depth, part, whole = None, [], 0, 0, 0, 0
        out: list[bytes] = []
        kinds: list[int] = []  # of parts: 0 a whole record, 1 the end of one, 2 the start of one, 3 a middle

        def rest() -> list[pa.RecordBatch]:
            """What has been cut of the range, with the record that goes on if there is one, where the range ends."""
            if not out:
                return []
            n = len(out)
            first = np.zeros(n, bool)
            first[0] = now[1] == 0 and whole == len([k for k in kinds if k < 2])
            columns = [pa.repeat(now[0], n), pa.repeat(now[1], n), pa.array(kinds, pa.int32()), pa.array(first), pa.array(out, pa.binary())]
            out.clear(), kinds.clear()
            return [pa.RecordBatch.from_arrays(columns, schema=_RECORDS)]

        def leave() -> list[pa.RecordBatch]:
            if held:
                out.append(separator.join(held))
                kinds.append(3 if part == 1 else 2)
                held.clear()
            return rest()

        for file, start, rows in _ranges_of(batches):
            if now != (file, start):
                yield from leave()
                now, whole = (file, start), 0
                inside, depth = rows.column("inside")[0].as_py(), rows.column("open")[0].as_py()
                part = int(start > 0 and (inside, depth) != (0, form.depth))
            for piece in rows.column("piece").to_pylist():
                held.append(piece)
                inside, change = form.step(piece + form.closing, inside)
                depth += change
                if not inside and depth == form.depth:
                    out.append(separator.join(held) + form.closing)
                    kinds.append(part)
                    held.clear()
                    part, whole = 0, whole + 1
            yield from rest()
        yield from leave()

    found = joined.mapInArrow(cut, "file string, range long, part int, first boolean, record binary")
    single = found.filter("part = 0").select("record", "first", "file")
    # A start and what follows up to the next start are one record.
    order = Window.partitionBy("file").orderBy("range", F.col("part") == 2)
    torn = found.filter("part > 0").withColumn("number", F.sum((F.col("part") == 2).cast("int")).over(order))
    held = F.sort_array(F.collect_list(F.struct("range", F.col("part") == 2, "record"))).alias("parts")
    joint = torn.groupBy("file", "number").agg(held, F.max("first").alias("first"), F.max((F.col("part") == 1).cast("int")).alias("closed"))
    if form.closing:
        joint = joint.filter("closed = 1")
    mark = F.lit(form.separator).cast("binary")
    whole = F.aggregate("parts", F.lit(None).cast("binary"), lambda made, p: F.when(made.isNull(), p["record"]).otherwise(F.concat(made, mark, p["record"])))
    every = single.unionByName(joint.select(whole.alias("record"), "first", "file"))
    return every.select(F.col("record").cast("string").alias("record"), "first", "file")
