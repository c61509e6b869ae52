"""Connected components of a distributed edge table by alternating stars.

Every round replaces edges by edges towards smaller labels (large-star, then small-star), so the
number of rounds is logarithmic in practice and no node's neighbourhood is ever collected: a round is
two partial aggregations and two joins, which adaptive execution may split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of edges(u, v) the least node of its component.

    Labels may be of any ordered type; nulls aren't nodes. An empty edge table gives an empty result.
    Raises if max_rounds rounds don't reach the fixpoint (more than enough for 2**max_rounds nodes)."""
    cur = scratch.save(_small_star(edges.where("u is not null and v is not null and u <> v")), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        nxt = scratch.save(_small_star(_large_star(cur)), "edges")
        scratch.drop(cur)
        cur = nxt
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
