"""SPARQL scalar functions on decoded values (strings, numbers, timestamps), as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strlen(x: Column) -> Column:
    return F.length(x)


def substr(x: Column, start: int, length: int | None = None) -> Column:
    return F.substring(x, F.lit(start), F.lit(length)) if length is not None else F.substring(x, F.lit(start), F.length(x))


def strbefore(x: Column, sep: str) -> Column:
    at = F.locate(sep, x)
    return F.when(at > 0, F.substring(x, F.lit(1), at - 1)).when(x.isNotNull(), "")


def strafter(x: Column, sep: str) -> Column:
    at = F.locate(sep, x)
    return F.when(at > 0, F.substring(x, at + len(sep), F.length(x))).when(x.isNotNull(), "")


def encode_for_uri(x: Column) -> Column:
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def regex(x: Column, pattern: str, flags: str = "") -> Column:
    return x.rlike((f"(?{flags})" if flags else "") + pattern)


def replace(x: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(x, (f"(?{flags})" if flags else "") + pattern, by)


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def divide(a: Column, b: Column) -> Column:
    """Null for a zero divisor; whole numbers divide to a fraction."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def if_(condition: Column, a: Column, b: Column) -> Column:
    """Null when the condition is an error."""
    return F.when(condition, a).when(~condition, b)


def in_(x: Column, *values: Column) -> Column:
    """True if one of the values equals x; else null if one of them, or x, is an error; else false."""
    return reduce(lambda a, b: a | b, [x == v for v in values], F.lit(False))


def not_in(x: Column, *values: Column) -> Column:
    return ~in_(x, *values)


def seconds(x: Column) -> Column:
    return F.extract(F.lit("SECOND"), x)


def wall(lexical: Column) -> Column:
    """The date and time that a dateTime text states, whatever its zone."""
    return F.to_timestamp_ntz(F.replace(F.substring(lexical, 1, 19), F.lit("T"), F.lit(" ")))


def timezone(lexical: Column) -> Column:
    """The zone of a dateTime text as a dayTimeDuration: PT0S, PT2H, -PT8H30M; null without one."""
    tz = tz_of(lexical)
    sign = F.when(tz.startswith("-"), "-").otherwise("")
    hours, minutes = F.substring(tz, 2, 2).try_cast("int"), F.substring(tz, 5, 2).try_cast("int")
    parts = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(tz == "Z", "PT0S").when((hours == 0) & (minutes == 0), "PT0S").when(tz != "", parts)


def tz_of(lexical: Column) -> Column:
    return F.regexp_extract(lexical, r"T.*(Z|[+-][0-9]{2}:[0-9]{2})$", 1)


REGISTRY: dict[str, object] = {}


def register(name: str, builder) -> None:
    """Names a function of our own, (Column, ...) -> Column, for `call`."""
    REGISTRY[name] = builder


def call(name: str, *args: Column) -> Column:
    return REGISTRY[name](*args)
