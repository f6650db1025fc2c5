"""Scalar functions; the `compat` ones keep the reference semantics where they differ from ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is infinite (NaN for 0 / 0) where ANSI mode raises."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x == 0, F.lit(float("nan")))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def char_length_compat(s: Column) -> Column:
    """Code points; 0 for null."""
    return F.coalesce(F.char_length(s), F.lit(0))


def octet_length_compat(s: Column) -> Column:
    return F.coalesce(F.octet_length(s), F.lit(0))


def position_compat(needle: Column, s: Column) -> Column:
    """1-based place in bytes, 0 if absent; null counts as empty."""
    n, h = F.coalesce(needle, F.lit("")), F.coalesce(s, F.lit(""))
    at = F.position(n, h)
    return F.when(at == 0, 0).otherwise(F.octet_length(F.substring(h, F.lit(1), at - 1)) + 1)


def substring_compat(s: Column, start: Column, length: Column | None = None) -> Column:
    """1-based, in bytes; a start below 1 wraps modulo the length plus one; null past
    the end. A negative length takes the rest. What is left of a character that
    is cut becomes U+FFFD."""
    data = s.cast("binary")
    n, first = F.octet_length(s), start.cast("long") - 1
    at = F.when(first < 0, F.pmod(first, n + 1)).otherwise(first)
    size = n if length is None else F.when(length.isNull(), None).when(length.between(0, n), length.cast("int")).otherwise(n)
    return F.when(at <= n, F.make_valid_utf8(F.substring(data, at.cast("int") + 1, size).cast("string")))


def trim_compat(s: Column, what: str = " ", where: str = "both") -> Column:
    """Strip repeats of the whole string `what`, not of its characters."""
    import re

    unit, out = f"(?:{re.escape(what)})", s
    if where in ("both", "leading"):
        out = F.regexp_replace(out, f"^{unit}++", "")
    if where in ("both", "trailing"):
        out = F.regexp_replace(out, rf"{unit}+\z", "")
    return out


def like(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without a default escape character."""
    if escape is None:
        pattern = pattern.replace("\\", "\\\\")
        return F.like(s, F.lit(pattern))
    return F.like(s, F.lit(pattern), F.lit(escape))


def current_timestamp() -> Column:
    """To the second."""
    return F.date_trunc("second", F.current_timestamp())
