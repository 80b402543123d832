"""Scalar functions as column expressions: masking, coercion, tolerant comparison, tokens, identities, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_sample(value: Column, shown: int = 4, most: int = 64) -> Column:
    """First and last characters with stars between; short values are stars alone. Only the first 64 characters are looked at."""
    cut = F.substring(value, 1, most)
    n = F.length(cut)
    long = F.concat(F.substring(cut, 1, shown), F.repeat(F.lit("*"), n - 2 * shown), F.right(cut, F.lit(shown)))
    return F.when(n <= 2 * shown, F.repeat(F.lit("*"), n)).otherwise(long)


def number(text: Column) -> Column:
    """A number with thousands separators as a double; null for anything else."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), plain.try_cast("double"))


def cell_equal(a: Column, b: Column, relative: float = 1e-2, absolute: float = 0.5) -> Column:
    """Whether two numbers pass as equal: whole ones exactly, others within either bound; a missing one counts as zero."""
    x, y = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    whole = (F.floor(x) == x) & (F.floor(y) == y)
    return F.when(whole, x == y).otherwise(F.abs(x - y) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(x), F.abs(y))))


def words(text: Column) -> Column:
    """Different words of two or more ASCII letters, digits and underscores in lower case, and pairs of neighbouring CJK characters."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(plain, F.lit("([a-z0-9_]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(plain, F.lit("([\\u4e00-\\u9fff]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(latin, pairs))


def identity(*parts: Column, length: int = 64) -> Column:
    """A stable name made of the parts, case and outer white space aside; nulls count as empty."""
    plain = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *plain), 256), 1, length)


def excel_date(serial: Column) -> Column:
    """The day that a spreadsheet's serial number stands for, from 1900 on."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def split_name(name: Column) -> Column:
    """The words of an identifier in camel case or with underscores, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda w: w != "")


def due(created: Column, days: Column, now: Column) -> Column:
    """Whether something has outlived its days; none or zero days never end."""
    return F.when((days > 0), created.cast("timestamp") + F.make_interval(days=days.cast("int")) <= now.cast("timestamp")).otherwise(F.lit(False))


def norm_number(text: Column) -> Column:
    """A value as scalars are compared: null is empty, numbers in one form (10, 10.0 and 1e1 are equal), anything else trimmed as it is."""
    bare = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    whole = F.regexp_replace(F.regexp_replace(bare.cast("string"), r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    plain = F.when(F.contains(whole, F.lit(".")), F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"^(-?)\.", "$10."), r"0+$", ""), r"\.$", "")).otherwise(whole)
    plain = F.when(plain == "-0", "0").otherwise(plain)
    power = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]{1,2}$")
    as_decimal = bare.try_cast("decimal(38,18)").cast("string")
    tidy = F.regexp_replace(F.regexp_replace(as_decimal, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain).when(power, F.coalesce(F.when(tidy == "-0", "0").otherwise(tidy), bare)).otherwise(bare)
