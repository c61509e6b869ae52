"""List library: lists as constructor terms (a family of relations for each element type) and as Spark arrays.

family() declares nil and cons for an element type with the relations len and member; lift() makes the term of a Python
value. The functions below work on array columns, as the compile-time ones do on Python lists.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ast import Con, Lit, Term
from ..errors import ProgramError


def family(p, element: str) -> SimpleNamespace:
    """list of element: type, constructors nil and cons, and len and member over every list that is a fact."""
    t, nil, cons, ln, mem = (f"{x}__{element}" for x in ("list", "nil", "cons", "len", "member"))
    p.open_type(t)
    p.constructor(nil, of=t)
    p.constructor(cons, ("head", element), ("tail", t), of=t)
    p.relation(ln, ("l", t), ("n", "int"))
    p.relation(mem, ("l", t), ("x", element))
    p.types.rels[ln].terminates = True
    p.read(f"""
        {ln} {nil} 0 :- {nil}.
        {ln} L (N + 1) :- ({cons} X T as L), {ln} T N.
        {mem} L X :- ({cons} X T as L).
        {mem} L Y :- ({cons} X T as L), {mem} T Y.""")
    return SimpleNamespace(type=t, nil=nil, cons=cons, len=ln, member=mem)


def lift(value, element: str = "int") -> Term:
    """The term of a Python value: a literal, a boolean constant or a list."""
    if isinstance(value, bool):
        return Con("true" if value else "false")
    if isinstance(value, (int, float, str)):
        if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
            raise ProgramError("E0930", f"{value} does not fit 64 bits")
        return Lit(value)
    out: Term = Con(f"nil__{element}")
    for x in reversed(value):
        out = Con(f"cons__{element}", (lift(x, element), out))
    return out


def length(a: Column) -> Column:
    return F.size(a).cast("long")


def zip_shorter(a: Column, b: Column) -> Column:
    """Pairs up to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def diff(a: Column, b: Column) -> Column:
    """Elements of a that b has not, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def lookup(keys: Column, values: Column, key: Column) -> Column:
    """The value at the first place of key; null if there is none."""
    at = F.array_position(keys, key)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def concat(lists: Column) -> Column:
    """The elements of a list of lists, in order."""
    return F.flatten(lists)


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def map_(a: Column, f) -> Column:
    return F.transform(a, f)


def filter_(a: Column, f) -> Column:
    return F.filter(a, f)


def any_(a: Column, f) -> Column:
    """Whether f holds of some element; false for the empty list."""
    return F.exists(a, f)


def all_(a: Column, f) -> Column:
    return F.forall(a, f)


def elem(a: Column, x) -> Column:
    return F.array_contains(a, x)


def if_(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def iterate(n: int, f, x):
    """f applied n times, to columns or to any other values."""
    for _ in range(n):
        x = f(x)
    return x


def fold_left(a: Column, start: Column, f) -> Column:
    return F.aggregate(a, start, f)


def fold_right(a: Column, start: Column, f) -> Column:
    return F.aggregate(F.reverse(a), start, lambda acc, x: f(x, acc))
