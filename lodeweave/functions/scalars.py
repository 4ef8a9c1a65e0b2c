"""Column functions that several operators share. All are built-in expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
INTEGER = r"^[+-]?[0-9]+$"
HEX = "^[0-9a-fA-F]{1,16}$"


def to_int(text: Column) -> Column:
    """Trimmed text as int, else null."""
    t = F.trim(text)
    return F.when(t.rlike(INTEGER), t.try_cast("int"))


def to_double(text: Column) -> Column:
    """Trimmed text as double, else null. Suffixes such as 5d, which a plain cast takes, are refused."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def or_default(array: Column, value: Column) -> Column:
    """The array, or one with the value where it is null or empty."""
    return F.when(F.coalesce(F.size(array), F.lit(0)) > 0, array).otherwise(F.array(value))


def hour(ts: Column) -> Column:
    """The hour's start, as a timestamp without time zone like its input."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def next_hour(ts: Column) -> Column:
    """ts itself if it is on the hour, else the next hour's start."""
    return F.when(hour(ts) == ts, ts).otherwise(hour(ts) + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """Text as timestamp; null if it is none."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def parse_time_strict(text: Column) -> Column:
    """Text as timestamp; an error if it is none."""
    return F.to_timestamp(text).cast("timestamp_ntz")


def hours_between(earlier: Column, later: Column) -> Column:
    """Whole hours, cut towards zero."""
    return F.timestamp_diff("HOUR", earlier, later)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def at_least(c: Column, low: float) -> Column:
    """c or low if c is less; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def hex_to_long(text: Column) -> Column:
    """Up to 16 hex digits as the long with these bits, else null."""
    return F.when(text.rlike(HEX), F.conv(text, 16, -10).cast("decimal(20,0)").cast("long"))


def spread_bits(c: Column) -> Column:
    """The low 16 bits of c, at the even places of 32: its binary digits, read as digits of base 4."""
    return F.conv(F.bin(c.bitwiseAND(F.lit(0xFFFF))), 4, 10).cast("long")


def morton(x: Column, y: Column) -> Column:
    """The low 16 bits of x at even places and those of y at odd ones."""
    return spread_bits(x.cast("long")).bitwiseOR(F.shiftleft(spread_bits(y.cast("long")), 1))


def path_pairs(path: Column) -> Column:
    """key=value folders of a path as a map; backslashes count as slashes."""
    folders = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    pairs = F.filter(folders, lambda f: f.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda f: F.struct(F.regexp_extract(f, "^([^=]*)=", 1), F.regexp_extract(f, "=(.*)$", 1))))


def line(*columns: str) -> Column:
    """The columns as one line of text, `name=value` with nulls as None, for display."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns])
