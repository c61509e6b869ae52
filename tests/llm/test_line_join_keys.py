"""Line dedup: what its prefix join shuffles and compares."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from facteng.llm import linededup

SCHEMA = "k long, n int, s0 long, s1 long, prefix array<int>, late boolean"


def test_codes_are_sorted_as_plain_longs(spark):
    df = spark.createDataFrame([("b  a b c",)], "line string").select(linededup.codes(F.col("line"), bytes(linededup.BUCKETS)).alias("codes"))
    assert not df.schema["codes"].dataType.containsNull
    found = df.first().codes
    assert len(found) == 3 and found == sorted(found)


def test_similar_sizes_are_of_adjacent_classes(spark):
    for t in (Fraction(4, 5), Fraction(1, 2)):
        pairs = spark.range(1, 3000).select(F.col("id").alias("n")).withColumn("m", F.explode(F.expr(f"sequence(n, n * {t.denominator} div {t.numerator})")))
        apart = linededup._class(F.col("m"), t) - linededup._class(F.col("n"), t)
        assert pairs.select(F.min(apart), F.max(apart)).first() == (0, 1)


def test_one_join_of_one_shuffle_for_late_sets_and_others(spark):
    rows = [(1, 10, 0, 0, [4, 8], True), (2, 10, 0, 0, [8, 12], False), (3, 10, 0, 0, [8, 9], True), (4, 12, 0, 0, [8, 13], False), (5, 200, 0, 0, [8, 14], False)]
    marked = spark.createDataFrame(rows, SCHEMA)
    plan = linededup._partners(marked, Fraction(4, 5), 2, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "Broadcast" not in plan
    every = {tuple(sorted((r.k, r.k_))) for turn in range(linededup.TURNS) for r in linededup._partners(marked, Fraction(4, 5), 2, turn).collect()}
    assert every == {(1, 2), (2, 3), (2, 4), (3, 4)}  # not (1, 3), both late; (1, 4) by places
