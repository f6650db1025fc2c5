"""SQL type names, the Spark types that carry them, and what the carriers must check."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark has no unsigned integers: the next wider type with a range check.
UNSIGNED = {"tinyint": ("smallint", 2**8 - 1), "smallint": ("int", 2**16 - 1), "int": ("bigint", 2**32 - 1), "bigint": ("decimal(20,0)", 2**64 - 1)}
PLAIN = {
    "boolean": "boolean", "bool": "boolean", "tinyint": "tinyint", "smallint": "smallint", "int2": "smallint", "int": "int", "integer": "int", "int4": "int", "bigint": "bigint", "int8": "bigint",
    "float": "float", "float4": "float", "real": "float", "double": "double", "double precision": "double", "float8": "double", "date": "date", "datetime": "timestamp_ntz",
    "string": "string", "text": "string",
}
ORDER = ["tinyint", "smallint", "int", "bigint", "float", "double"]


@dataclass(frozen=True)
class LogicalType:
    sql: str
    spark: str
    most: int | None = None  # the largest value of an unsigned type
    length: int | None = None
    octets: bool = False

    def violation(self, c: Column) -> Column | None:
        """True where a value doesn't fit; None if the carrier's own cast sees to it."""
        if self.most is not None:
            return (c < 0) | (c > F.lit(self.most))
        if self.length is not None:
            return (F.octet_length(c) if self.octets else F.char_length(c)) > self.length
        return None


def parse_type(text: str) -> LogicalType:
    t = re.sub(r"\s+", " ", text.strip().lower())
    if m := re.fullmatch(r"u(tinyint|smallint|int|integer|bigint)|(tinyint|smallint|int|integer|bigint) unsigned", t):
        base = (m[1] or m[2]).replace("integer", "int")
        return LogicalType(t, *UNSIGNED[base])
    if t in PLAIN:
        return LogicalType(t, PLAIN[t])
    if m := re.fullmatch(r"(?:char|character)(?: ?\( ?(\d+)(?: (characters|octets))? ?\))?", t):
        return LogicalType(t, "string", None, int(m[1] or 1), m[2] == "octets")
    if m := re.fullmatch(r"(?:varchar|character varying|char varying)(?: ?\( ?(\d+)(?: (characters|octets))? ?\))?", t):
        return LogicalType(t, "string", None, int(m[1]) if m[1] else None, m[2] == "octets")
    if m := re.fullmatch(r"(?:decimal|numeric|dec)(?: ?\( ?(\d+)(?: ?, ?(\d+))? ?\))?", t):
        return LogicalType(t, f"decimal({m[1]},{m[2] or 0})" if m[1] else "decimal(28,10)")
    if m := re.fullmatch(r"time(?: ?\( ?([0-4]) ?\))?(?: without time zone)?", t):
        return LogicalType(t, f"time({m[1] or 0})")
    if m := re.fullmatch(r"timestamp(?: ?\( ?[0369] ?\))?( with time zone)?(?: without time zone)?", t):
        return LogicalType(t, "timestamp" if m[1] else "timestamp_ntz")
    raise ValueError(f"unsupported data type: {text}")


def common_type(a: str, b: str) -> str:
    """The type that values of both numeric types are compared and united in."""
    ua, ub = a.startswith("u"), b.startswith("u")
    x, y = a.removeprefix("u"), b.removeprefix("u")
    if x not in ORDER or y not in ORDER:
        raise ValueError(f"{a} and {b} can't be compared")
    wide = max(ORDER.index(x), ORDER.index(y))
    if wide >= ORDER.index("float"):
        return "float" if x == y == "float" else "double"
    if ua == ub:
        return ("u" if ua else "") + ORDER[wide]
    unsigned = ORDER.index(x if ua else y)
    signed = ORDER.index(y if ua else x)
    wide = max(signed, unsigned + 1)
    return ORDER[wide] if wide <= ORDER.index("bigint") else "double"
