"""The prefix join of line dedup hashes one side; no side is sorted for it."""

from __future__ import annotations

from fractions import Fraction

from facteng.llm import linededup


def test_partners_are_found_by_hash_joins(spark):
    schema = "k long, n int, s0 long, s1 long, prefix array<int>, late boolean"
    marked = spark.createDataFrame([(1, 10, 0, 0, [4, 8], False), (2, 10, 0, 0, [8, 12], False), (3, 10, 0, 0, [5, 9], False)], schema)
    found = linededup._partners(marked, Fraction(4, 5), 0, 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    every = {(r.k, r.k_) for turn in range(linededup.TURNS) for r in linededup._partners(marked, Fraction(4, 5), 0, turn).collect()}
    assert {tuple(sorted(x)) for x in every} == {(1, 2)}
