"""Built-in expressions over words that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased words of a text; null as no words."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for c in "\t\n\x0b\x0c\r":  # splitting at one plain character needs no regular expression
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def shingles(hashed: Column, width: int) -> Column:
    """Hashes of all runs of width words, in order, repeats included; none if there are fewer words."""
    n = F.size(hashed) - width + 1
    one = lambda x, i: F.xxhash64(x, *[F.get(hashed, i + k) for k in range(1, width)])
    return F.when(n > 0, F.transform(F.slice(hashed, 1, F.greatest(n, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def repeats(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def numbered(a: Column) -> Column:
    """The array with each later occurrence of an element replaced by a hash of it and its number, so none repeats and
    the common elements of two such arrays are those of a and b, repeats counted."""
    before = lambda x, i: F.size(F.filter(F.slice(a, 1, i), lambda y: y == x))
    return F.transform(a, lambda x, i: F.when(before(x, i) == 0, x).otherwise(F.xxhash64(x, before(x, i))))


def simhash(shingle: Column, planes: int) -> Column:
    """64-bit fingerprint of an array of hashes: a bit is set if it is set in over half of them.

    Counts of all 64 bits are kept together, one long for each binary digit of a count (planes of them), and
    compared with half the number of hashes digit by digit. planes must hold the number of hashes."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in range(planes)])

    def add(acc: Column, h: Column) -> Column:
        carry, out = h, []
        for k in range(planes):
            digit = acc[f"p{k}"]
            out.append(digit.bitwiseXOR(carry).alias(f"p{k}"))
            carry = carry.bitwiseAND(digit)
        return F.struct(*out)

    half = F.floor(F.size(shingle) / 2).cast("long")

    def compare(acc: Column, k: Column) -> Column:
        mine = F.element_at(acc["digits"], k + 1)
        theirs = -(F.floor(half / F.pow(F.lit(2.0), k)).cast("long") % 2)
        more = acc["more"].bitwiseOR(acc["same"].bitwiseAND(mine).bitwiseAND(F.bitwise_not(theirs)))
        same = acc["same"].bitwiseAND(F.bitwise_not(mine.bitwiseXOR(theirs)))
        return F.struct(more.alias("more"), same.alias("same"), acc["digits"].alias("digits"))

    counted = F.aggregate(shingle, zero, add, lambda acc: F.array(*[acc[f"p{k}"] for k in range(planes)]))
    start = F.struct(F.lit(0).cast("long").alias("more"), F.lit(-1).cast("long").alias("same"), counted.alias("digits"))
    return F.aggregate(F.sequence(F.lit(planes - 1), F.lit(0), F.lit(-1)), start, compare, lambda acc: acc["more"])


def overlap(a: Column, b: Column) -> Column:
    """Common elements of two arrays, repeats counted (the sum of the lesser counts)."""
    simple = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    general = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return F.when(simple, F.size(F.array_intersect(a, b))).otherwise(general)
