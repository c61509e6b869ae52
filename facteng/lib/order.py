"""Ranking and successor library on DataFrames of facts: native windows over sets, in ranges of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.store import Tables


def _scores(scores: DataFrame) -> DataFrame:
    k, i, s = scores.columns
    return scores.select(F.col(k).alias("key"), F.col(i).alias("item"), F.col(s).alias("score")).dropna().distinct()


def _extreme(scores: DataFrame, pick) -> DataFrame:
    s = _scores(scores)
    best = s.groupBy("key").agg(pick("score").alias("best"))
    return s.join(best, "key").where("score = best").select("key", "item")


def argmin(scores: DataFrame) -> DataFrame:
    """(key, item) of the least score of each key, ties kept; a partial aggregation and a join, so a large key is no
    burden to one task."""
    return _extreme(scores, F.min)


def argmax(scores: DataFrame) -> DataFrame:
    return _extreme(scores, F.max)


def _ranged(rows: DataFrame, *by: str | Column) -> DataFrame:
    """rows with the number of their range in the given order; rows equal in it share a range. Ranges are
    written down, as Spark samples their bounds anew for every shuffle and all readers must see the same ones."""
    return Tables(rows.sparkSession).save(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))[0]


def rank(scores: DataFrame) -> DataFrame:
    """(key, item, rank): one more than the number of greater scores of the key (items with equal scores share it). Counted
    within ranges of scores; only one row for each range of a key is handled together."""
    placed = _ranged(_scores(scores), "key", F.desc("score"))
    sizes = placed.groupBy("key", "part").count()
    ahead = sizes.select("key", "part", (F.sum("count").over(Window.partitionBy("key").orderBy("part")) - F.col("count")).alias("ahead"))
    own = F.rank().over(Window.partitionBy("part", "key").orderBy(F.desc("score")))
    return placed.withColumn("own", own).join(ahead, ["key", "part"]).select("key", "item", (F.col("own") + F.col("ahead")).cast("long").alias("rank"))


def top(scores: DataFrame, n: int) -> DataFrame:
    """(key, item) of rank n or better, ties kept; Spark limits the groups before the shuffle."""
    w = Window.partitionBy("key").orderBy(F.desc("score"))
    return _scores(scores).withColumn("r", F.rank().over(w)).where(F.col("r") <= n).select("key", "item")


def _elements(elements: DataFrame) -> DataFrame:
    return _ranged(elements.select(F.col(elements.columns[0]).alias("x")).dropna().distinct(), "x")


def next_(elements: DataFrame) -> DataFrame:
    """(x, next): every element and the least greater one; the last has none."""
    placed = _elements(elements)
    heads = placed.groupBy("part").agg(F.min("x").alias("head"))
    after = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))
    inner = F.lead("x").over(Window.partitionBy("part").orderBy("x"))
    return placed.withColumn("n", inner).join(after, "part").select("x", F.coalesce("n", "after").alias("next")).dropna()


def first(elements: DataFrame) -> DataFrame:
    """The least element; no row for the empty set."""
    return elements.agg(F.min(elements.columns[0]).alias("x")).dropna()


def position(elements: DataFrame) -> DataFrame:
    """(x, position): the number of smaller elements, from 0."""
    placed = _elements(elements)
    sizes = placed.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1
    return placed.withColumn("p", own).join(before, "part").select("x", (F.col("p") + F.col("before")).cast("long").alias("position"))
