"""Line dedup: a pair whose later set is already known to go is no candidate."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from facteng.llm import linededup

SCHEMA = "k long, n int, s0 long, s1 long, prefix array<int>, late boolean, doc_id long"


def _pairs(spark, rows):
    ranked = linededup._ranked(spark.createDataFrame(rows, SCHEMA))
    settled = sum(r[5] for r in rows)
    return [tuple(sorted((r.k, r.k_))) for turn in range(linededup.TURNS) for r in linededup._partners(ranked, Fraction(4, 5), settled, turn).collect()]


def test_ranks_keep_the_order_of_places(spark):
    ids = [None, -(2**63), -5, 0, 1, 2, 2**62, 2**63 - 1]
    for some in (ids, ids[2:6], ids[:1], ids[3:4], []):
        df = spark.createDataFrame([(i,) for i in some], "doc_id long")
        got = [r.rank for r in linededup._ranked(df).orderBy(F.asc_nulls_first("doc_id")).collect()]
        assert got == sorted(got) and all(0 <= x < linededup.RANKS for x in got)
    assert len(set(got for got in [r.rank for r in linededup._ranked(spark.createDataFrame([(i,) for i in ids[2:6]], "doc_id long")).collect()])) == 4


def test_pairs_with_a_later_late_set_are_left_out(spark):
    one = lambda k, late, doc_id: (k, 10, 0, 0, [4], late, doc_id)
    assert set(_pairs(spark, [one(1, False, 0), one(2, True, 5), one(3, False, 9)])) == {(1, 3), (2, 3)}
    assert set(_pairs(spark, [one(1, True, None), one(2, False, 0), one(3, True, 0)])) == {(1, 2), (2, 3)}  # of one doc_id either may be later


def test_late_sets_after_one_make_no_pairs(spark):
    rows = [(k, 10, 0, 0, [4, 5, 8], k > 0, k) for k in range(50)]
    assert _pairs(spark, rows) == []


def test_sets_of_sixty_words_have_both_parities(spark):
    row = spark.range(1).select(F.expr("sequence(64L, 123L)").alias("a")).select(*linededup._parities(F.col("a"), 2)).first()
    assert row.s0 != 0 and row.s1 != 0
