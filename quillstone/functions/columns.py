"""Scalar expressions. All of them are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Separators of a medicine list, in the order they are tried.
MEDICINE_SEPARATORS = (",", ";", "|", "\n", " and ", " & ")
# Texts that mean "no medicine".
BLANK_WORDS = ("nan", "none", "null", "")
# Date formats tried in turn, after year-month-day with any time, fraction and zone.
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"
MONTH_FIRST, DAY_FIRST = "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"
DATE_FORMATS = ("yyyy/M/d[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]")


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_missing(column: Column, data_type: T.DataType) -> Column:
    """NULL, or NaN in a floating column."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()



def as_double(column: Column, data_type: T.DataType) -> Column:
    """Numeric column as DOUBLE, NaN as NULL."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    return column.cast("double")


def to_number(column: Column) -> Column:
    """Text to DOUBLE; what is not a number becomes NULL."""
    text = column.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def to_time(column: Column, day_first: bool = False) -> Column:
    """Text to timestamp with the first format that fits; otherwise NULL. A zone is left out of account.

    Dates with slashes that end with the year are read month first or day first, never both ways.
    """
    text = F.trim(column.cast("string"))
    formats = (DAY_FIRST if day_first else MONTH_FIRST, *DATE_FORMATS)
    iso = F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def day_first(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Text columns of which more values read day first than month first, from one aggregate over all rows."""
    if not names:
        return set()
    counts = df.agg(*[F.count(to_time(quoted(n), order)) for n in names for order in (False, True)]).first()
    return {n for i, n in enumerate(names) if counts[2 * i + 1] > counts[2 * i]}


def time_of(df: DataFrame, name: str) -> Column:
    """Timestamp and date columns as they are, text read in the order that fits the column."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return quoted(name).cast("timestamp_ntz")
    return to_time(quoted(name), name in day_first(df, [name]))


def epoch_to_time(column: Column) -> Column:
    """Seconds since 1970-01-01 (UTC) to a timestamp without time zone."""
    micros = (column.cast("double") * 1000000).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def time_literal(moment) -> Column:
    """A collected timestamp without time zone, written so that no time zone moves it."""
    return F.lit(None if moment is None else moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_micros(column: Column) -> Column:
    """Microseconds since 1970-01-01 on the calendar, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour spans between two timestamps, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400000000)).cast("long")


def strip(column: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(column, F.lit(" \t\n\r\x0b\x0c"))


def first_word(column: Column) -> Column:
    return F.try_element_at(F.split(strip(column), r"\s+"), F.lit(1))


def short_label(column: Column, length: int) -> Column:
    return F.substring(column.cast("string"), 1, length)


def age_years(column: Column) -> Column:
    """Age text to years: ``71-80`` is its middle, ``65+`` is 65, a number is itself."""
    text = F.trim(column.cast("string"))
    number = r"(\d+\.?\d*)"
    span = rf"^{number}\s*-\s*{number}$"
    low = F.regexp_extract(text, span, 1).try_cast("double")
    high = F.regexp_extract(text, span, 2).try_cast("double")
    return (
        F.when(text.rlike(span), (low + high) / 2)
        .when(text.contains("+"), to_number(F.replace(text, F.lit("+"), F.lit(""))))
        .otherwise(to_number(text))
    )


def split_medicines(column: Column) -> Column:
    """Medicine text to an array, cut at the first separator kind that occurs."""
    text = strip(column.cast("string"))
    parts = reduce(
        lambda rest, mark: F.when(text.contains(mark), F.split(text, _literal_pattern(mark))).otherwise(rest),
        reversed(MEDICINE_SEPARATORS),
        F.array(text),
    )
    trimmed = F.transform(parts, strip)
    named = F.filter(trimmed, lambda part: ~F.lower(part).isin(*BLANK_WORDS))
    none = F.array().cast("array<string>")
    return F.when(column.isNull() | F.lower(text).isin(*BLANK_WORDS), none).otherwise(named)


def _literal_pattern(text: str) -> str:
    return "".join(f"[{c}]" if c in "|&,;" else c for c in text)


def unique_ignoring_case(array: Column) -> Column:
    """Array without repeats in other letter case; the first spelling stays."""
    folded = F.transform(array, lambda x: F.lower(strip(x)))
    first = F.filter(array, lambda x, i: F.array_position(folded, F.lower(strip(x))) == i + 1)
    return F.when(F.size(array) < 2, array).otherwise(first)


def clip(column: Column, low, high) -> Column:
    """Within bounds; NULL stays NULL, although ``least`` and ``greatest`` skip it."""
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column)))


def scaled(column: Column, low, span) -> Column:
    """(x - low) / span with 0 for missing values and for a zero span."""
    if low is None or not span:
        return F.lit(0.0)
    return F.coalesce((column - F.lit(low)) / F.lit(span), F.lit(0.0))


def row_mean(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / F.lit(float(len(columns)))


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum across columns; NULL in any of them makes the sum NULL."""
    return reduce(lambda a, b: a + b, columns)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole as a percentage, NULL when the whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def chance(keys: Sequence[Column], seed: int, purpose: str) -> Column:
    """A number in [0, 1) that depends only on purpose, seed and keys, so reruns agree.

    Draws for different purposes are independent. It is made of the first 52 bits of the md5 of all
    parts joined with colons, which other engines compute too.
    """
    parts = [F.lit(purpose), F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def flipped(label: Column, keys: Sequence[Column], seed: int, rate: float) -> Column:
    """A 0/1 label with ``rate`` of the rows inverted."""
    if rate <= 0:
        return label
    noise = F.when(chance(keys, seed, "noise") < rate, 1).otherwise(0)
    return label.cast("int").bitwiseXOR(noise)


def shifted(level: Column, keys: Sequence[Column], seed: int, rate: float, low: int, high: int) -> Column:
    """A level moved one down or one up in ``rate`` of the rows each, kept within its range."""
    if rate <= 0:
        return level
    draw = chance(keys, seed, "noise")
    step = F.when(draw < rate, -1).when(draw < 2 * rate, 1).otherwise(0)
    return clip(level + step, low, high)


def bucket_number(column: Column, edges: Sequence[float]) -> Column:
    """1 + how many edges the value exceeds: right-closed bins, equal values share a bin."""
    steps = [F.when(column > F.lit(e), 1).otherwise(0) for e in edges]
    return F.when(column.isNotNull(), F.lit(1) + reduce(lambda a, b: a + b, steps))


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(default))


def date_parts(column: Column) -> dict[str, Column]:
    """Calendar fields; weekday counts from Monday = 0."""
    return {
        "year": F.year(column),
        "quarter": F.quarter(column),
        "month": F.month(column),
        "day": F.dayofmonth(column),
        "weekday": F.weekday(column),
        "week": F.weekofyear(column),
    }
