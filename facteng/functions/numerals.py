"""Natural numbers and integers as programs compute with them before evaluation: Python ints, with the results that differ from
Python's own. minus stops at 0, quotients are cut towards 0, and what is divided by 0 is 0."""

from __future__ import annotations


def nat_minus(a: int, b: int) -> int:
    return max(a - b, 0)


def nat_div(a: int, b: int) -> int:
    return a // b if b else 0


def nat_mod(a: int, b: int) -> int:
    return a % b if b else a


def nat_equal(a: int, b: int) -> bool:
    return a == b


def nat_less(a: int, b: int) -> bool:
    return a < b


def neg_of_nat(a: int) -> int:
    return -a


def sub_nat_nat(a: int, b: int) -> int:
    """The integer difference of two natural numbers."""
    return a - b


def nat_abs(a: int) -> int:
    return abs(a)


def int_div(a: int, b: int) -> int:
    if not b:
        return 0
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def int_less(a: int, b: int) -> bool:
    return a < b


def int_leq(a: int, b: int) -> bool:
    return a <= b


def fits64(a: int) -> bool:
    """Whether a literal of this value can stand in a program."""
    return -(1 << 63) <= a < 1 << 63
