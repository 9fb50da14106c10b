"""Value transforms, applied in chains.

``apply(value, ["lowercase", ("replace", "a", "b")])``: each step is a name or a
tuple of name and arguments. A closing ``^^datatype`` is cut first; other carets stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitylink.functions.common import once


def nolang(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)@[^@]*$", "")


def cleaniri(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def _numeric_text(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9,.-]", "")


def number(x: Column) -> Column:
    v = _numeric_text(x)
    return F.when(v.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), v).otherwise(F.lit("0"))


def celsius(x: Column) -> Column:
    """Celsius to Fahrenheit."""
    return 32 + number(x).cast("double") * 9 / 5


def fahrenheit(x: Column) -> Column:
    """Fahrenheit to Celsius."""
    return (number(x).cast("double") - 32) * 5 / 9


def removebraces(x: Column) -> Column:
    """Cut the first (...) with the character before it, else drop lone braces."""
    opened = F.instr(x, "(")
    closed = F.when(opened > 0, F.call_function("locate", F.lit(")"), x, opened)).otherwise(F.lit(0))
    before = F.substring(x, F.lit(1), F.greatest(opened - 2, F.lit(0)))
    cut = F.concat(before, F.substring(x, closed + 1, F.char_length(x)))
    return F.when((opened > 0) & (closed > 0), cut).otherwise(F.regexp_replace(x, "[()]", ""))


def regularalphabet(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[^A-Za-z0-9 ]", ""))


def uriasstring(x: Column) -> Column:
    """The part after the last ``:`` or else the last ``/``; ``_`` becomes a blank."""

    def after(mark: str):
        tail = F.substring_index(x, mark, -1)
        return tail, (F.char_length(tail) > 0) & (F.char_length(x) - F.char_length(tail) - 1 > 0)

    (colon, has_colon), (slash, has_slash) = after(":"), after("/")
    return F.replace(F.when(has_colon, colon).when(has_slash, slash).otherwise(x), F.lit("_"), F.lit(" "))


# A datatype at the end of a literal: an IRI or one word.
DATATYPE = r"\^\^(<[^>]*>|[^\s^\"<>]+)$"

STEPS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "replace": lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)),
    "regexreplace": lambda x, pattern, b: F.trim(F.regexp_replace(x, pattern, b)),
    "nolang": nolang,
    "cleaniri": cleaniri,
    "number": number,
    "celsius": lambda x: celsius(x).cast("string"),
    "fahrenheit": lambda x: fahrenheit(x).cast("string"),
    "date": _numeric_text,
    "removebraces": removebraces,
    "regularalphabet": regularalphabet,
    "uriasstring": uriasstring,
}


def apply(value: Column, chain: Sequence[str | tuple]) -> Column:
    out = F.regexp_replace(value, DATATYPE, "")
    for step in chain:
        name, *args = (step,) if isinstance(step, str) else step
        out = STEPS[name](out, *args)
    return out


# Month names, and DOI shape.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DOI = r"10\.\d{4,9}/\S.*"


def normalize_doi(x: Column) -> Column:
    """URL-decode, take the DOI, blanks become ``-``; null where there is none."""
    found = F.regexp_extract(F.coalesce(F.try_url_decode(x), x), DOI, 0)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit("-")))


def parse_date(x: Column) -> Column:
    """Year, y-m-d, y/m/d, d/m/y, d.m.y and day-month-name-year texts as a date.

    The text is split at its one kind of separator. Three fields: a letter field in the
    middle is a month name; else a field of three or four digits at the front makes it
    year first (``-`` and ``/``), otherwise day first (``/`` and ``.``). A day past the
    month's end rolls over.
    """
    return once(x, _date_of)


def _date_of(x: Column) -> Column:
    by = F.substring(F.regexp_replace(x, "[0-9A-Za-z]", ""), 1, 1)
    fields = F.when(F.char_length(by) == 1, F.split(F.replace(x, by, F.lit("|")), "[|]")).otherwise(F.array(x))
    return once(F.struct(by.alias("by"), fields.alias("fields")), lambda s: _date_of_fields(s.by, s.fields))


def _date_of_fields(by: Column, fields: Column) -> Column:
    one, two, three = (F.get(fields, F.lit(i)) for i in range(3))
    wide = lambda c: F.char_length(c)

    def whole(c: Column, most: int) -> Column:
        """The number of a field of 1 to ``most`` digits, else null."""
        return F.when(c.rlike("^[0-9]+$") & (wide(c) <= most), c.try_cast("int"))

    def make(y: Column, m: Column, d: Column) -> Column:
        good = m.between(1, 12) & d.between(1, 31) & y.isNotNull()
        return F.when(good, F.date_add(F.try_make_timestamp_ntz(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).cast("date"), d - 1))

    name = F.lower(two)
    full, short = F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(m[:3]) for m in MONTHS])
    month = F.nullif(F.greatest(F.array_position(full, name), F.array_position(short, name)), F.lit(0)).cast("int")
    alone = F.when(wide(one) >= 2, make(whole(one, 4), F.lit(1), F.lit(1)))
    front = F.when((wide(one) >= 3) & by.isin("-", "/"), make(whole(one, 4), whole(two, 2), whole(three, 2)))
    back = F.when((wide(three) >= 2) & by.isin("/", "."), make(whole(three, 4), whole(two, 2), whole(one, 2)))
    named = F.when((wide(three) >= 3) & by.isin("-", "/", "."), make(whole(three, 4), month, whole(one, 2)))
    return F.when(F.size(fields) == 1, alone).when(F.size(fields) == 3, F.coalesce(F.when(month.isNotNull(), named), front, back))


def parse_points(x: Column, order: str = "latlon") -> Column:
    """``KIND((a b, c d, ...))`` to ARRAY<STRUCT<lat,lon>>; ``order`` says what comes first."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^(]*\(+|\)+[^)]*$", ""), r" {2,}", " "))
    first, second = ("lat", "lon") if order == "latlon" else ("lon", "lat")

    def point(p: Column) -> Column:
        n = F.split(F.trim(p), " ")
        v = {first: F.get(n, F.lit(0)).cast("double"), second: F.get(n, F.lit(1)).cast("double")}
        return F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))

    return F.transform(F.split(inner, ","), point)


def parse_point_line(x: Column) -> tuple[Column, Column]:
    """``uri long lat long lat ...`` to (uri, points)."""
    n = F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")
    pairs = F.sequence(F.lit(1), F.size(n) - 2, F.lit(2))
    return F.get(n, F.lit(0)), F.transform(
        pairs, lambda i: F.struct(F.get(n, i + 1).cast("double").alias("lat"), F.get(n, i).cast("double").alias("lon"))
    )
