"""Arithmetic and comparison of terms as Spark columns.

What is undefined (overflow, division by zero, infinity minus infinity) is null, and rows with a null never fire a rule.
A value's kind is int, float, string, id (identity of a fact) or ext (an int or an infinity, stored as
struct<inf, v>, whose natural order is the extended order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ProgramError

MIN = -(1 << 63)
EXT = "struct<inf:tinyint,v:bigint>"


def literal(value) -> tuple[Column, str]:
    if isinstance(value, str):
        return F.lit(value), "string"
    if isinstance(value, float):
        return F.lit(value), "float"
    return F.lit(value).cast("long"), "int"


def ext(v: Column, inf: Column | None = None) -> Column:
    """An extended int; null if v is."""
    made = F.struct((F.lit(0) if inf is None else inf).cast("tinyint").alias("inf"), v.cast("long").alias("v"))
    return F.when(v.isNotNull(), made)


def coerce(c: Column, kind: str, to: str) -> Column:
    if kind == to:
        return c
    if (kind, to) == ("int", "ext"):
        return ext(c)
    if (kind, to) == ("ext", "int"):  # infinities have no int
        return F.when(c["inf"] == 0, c["v"])
    raise ProgramError("E0402", f"a value of kind {kind} stands where {to} is expected")


def _int(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return F.try_add(a, b)
    if op == "-":
        return F.try_subtract(a, b)
    if op == "*":
        return F.try_multiply(a, b)
    bad = (b == 0) | ((a == F.lit(MIN)) & (b == -1))
    return F.call_function("div", a, F.when(~bad, b))


def _float(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        out = a / F.when(b != 0.0, b)
    else:
        out = {"+": a + b, "-": a - b, "*": a * b}[op]
    return F.when(~F.isnan(out), out)


def _ext(op: str, a: Column, b: Column) -> Column:
    """Infinity minus itself, zero times infinity and infinity over infinity are undefined."""
    finite = (a["inf"] == 0) & (b["inf"] == 0)
    plain = F.when(finite, _int(op, F.when(a["inf"] == 0, a["v"]), F.when(b["inf"] == 0, b["v"])))
    sign = lambda x: F.when(x["inf"] != 0, x["inf"].cast("int")).otherwise(F.signum(x["v"]).cast("int"))
    if op in "+-":
        other = b["inf"].cast("int") * (1 if op == "+" else -1)
        inf = F.when(a["inf"] == 0, other).when((b["inf"] == 0) | (a["inf"] == other), a["inf"].cast("int"))
    elif op == "*":
        inf = F.when(sign(a) * sign(b) != 0, sign(a) * sign(b))
    else:
        inf = F.when((b["inf"] == 0) & (b["v"] != 0), sign(a) * sign(b))
        plain = F.when((a["inf"] == 0) & (b["inf"] != 0), F.lit(0).cast("long")).otherwise(plain)
    infinite = (a["inf"] != 0) if op == "/" else ~finite
    return F.when(infinite, F.when(inf.isNotNull(), ext(F.lit(0), inf))).otherwise(ext(plain))


def arith(op: str, a: tuple[Column, str], b: tuple[Column, str]) -> tuple[Column, str]:
    kinds = {a[1], b[1]}
    if op == "^":
        if kinds != {"string"}:
            raise ProgramError("E0402", "^ joins two strings")
        return F.concat(a[0], b[0]), "string"
    if kinds == {"int"}:
        return _int(op, a[0], b[0]), "int"
    if kinds == {"float"}:
        return _float(op, a[0], b[0]), "float"
    if kinds <= {"int", "ext"}:
        return _ext(op, coerce(*a, "ext"), coerce(*b, "ext")), "ext"
    raise ProgramError("E0402", f"{op} of {a[1]} and {b[1]}")


def negate(a: tuple[Column, str]) -> tuple[Column, str]:
    c, kind = a
    if kind == "int":
        return F.try_subtract(F.lit(0).cast("long"), c), kind
    if kind == "float":
        return -c, kind
    if kind == "ext":
        return F.when(c["inf"] != 0, ext(F.lit(0), -c["inf"].cast("int"))).otherwise(ext(F.try_subtract(F.lit(0).cast("long"), c["v"]))), kind
    raise ProgramError("E0402", f"- of a {kind}")


def compare(op: str, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
    """Typed comparison; strings go by code point, identities are only equal or not."""
    if a[1] != b[1]:
        if {a[1], b[1]} != {"int", "ext"}:
            raise ProgramError("E0402", f"{op} of {a[1]} and {b[1]}")
        a, b = (coerce(*a, "ext"), "ext"), (coerce(*b, "ext"), "ext")
    if a[1] == "id" and op not in ("=", "<>"):
        raise ProgramError("E0402", f"{op} of facts")
    x, y = a[0], b[0]
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def identity(rel: str, args: list[tuple[Column, str]]) -> Column:
    """Content-addressed identity of a fact: its relation and a digest of its length-prefixed arguments. Equal
    facts have equal identities whoever makes them; a relation without columns has just its name."""
    if not args:
        return F.lit(f"{rel}#")
    parts = []
    for c, kind in args:
        said = F.concat(c["inf"].cast("string"), F.lit("/"), c["v"].cast("string")) if kind == "ext" else c.cast("string")
        said = F.concat(F.lit(kind[0]), said)
        parts += [F.length(said).cast("string"), F.lit(":"), said]
    return F.concat(F.lit(f"{rel}#"), F.sha2(F.concat(*parts), 256))


def tag(c: Column) -> Column:
    return F.substring_index(c, "#", 1)
