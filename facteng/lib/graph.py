"""Graph library: functors that add relations to a program, and closures by repeated squaring for large graphs.

A functor takes the program and relation names and returns the names of the relations it adds. The same instance is made
once (Program.use). Closures with few nodes per path are also offered on DataFrames, with a logarithmic number of rounds.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Tables


def _node(p, edge: str, *more: str, complete: bool = False) -> str:
    """The type of nodes; edge must have two columns of it, and the further ones given."""
    node = p.types.rels[edge].columns[0].type if edge in p.types.rels and p.types.rels[edge].columns else None
    p.require(edge, node, node, *more, complete=complete)
    return node


def reverse(p, edge: str) -> SimpleNamespace:
    t, name = _node(p, edge), f"reverse_{edge}"
    p.read(f"{name} : {t} -> {t} -> rel. {name} Y X :- {edge} X Y.")
    return SimpleNamespace(edge=name)


def undirected(p, edge: str) -> SimpleNamespace:
    t, name = _node(p, edge), f"undirected_{edge}"
    p.read(f"{name} : {t} -> {t} -> rel. {name} X Y :- {edge} X Y. {name} Y X :- {edge} X Y.")
    return SimpleNamespace(edge=name)


def vertices(p, edge: str) -> SimpleNamespace:
    t, name = _node(p, edge), f"vertex_{edge}"
    p.read(f"{name} : {t} -> rel. {name} X :- {edge} X _. {name} Y :- {edge} _ Y.")
    return SimpleNamespace(vertex=name)


def tc(p, edge: str) -> SimpleNamespace:
    """Walks of one edge or more. The recursion is non-linear, so a path of n edges is found in about log n rounds."""
    t, name = _node(p, edge), f"tc_{edge}"
    p.read(f"{name} : {t} -> {t} -> rel. {name} X Y :- {edge} X Y. {name} X Z :- {name} X Y, {name} Y Z.")
    return SimpleNamespace(path=name)


def rtc(p, edge: str) -> SimpleNamespace:
    v, c = p.use(vertices, edge).vertex, p.use(tc, edge).path
    t, name = _node(p, edge), f"rtc_{edge}"
    p.read(f"{name} : {t} -> {t} -> rel. {name} X X :- {v} X. {name} X Y :- {c} X Y.")
    return SimpleNamespace(v=v, t=c, path=name)


def reach(p, edge: str, seed: str) -> SimpleNamespace:
    t, name = _node(p, edge), f"reach_{edge}_{seed}"
    p.require(seed, t)
    p.read(f"{name} : {t} -> rel. {name} X :- {seed} X. {name} Y :- {name} X, {edge} X Y.")
    return SimpleNamespace(reached=name)


def scc(p, edge: str) -> SimpleNamespace:
    r = p.use(rtc, edge).path
    t, name = _node(p, edge), f"scc_{edge}"
    p.read(f"{name} : {t} -> {t} -> rel. {name} X Y :- {r} X Y, {r} Y X.")
    return SimpleNamespace(r=r, same=name)


def degrees(p, edge: str) -> SimpleNamespace:
    """Sources, sinks and degrees, zeros included. The edges must be complete."""
    t = _node(p, edge, complete=True)
    v = p.use(vertices, edge).vertex
    p.read(f"""
        source_{edge}, sink_{edge} : {t} -> rel. outdeg_{edge}, indeg_{edge} : {t} -> int -> rel.
        source_{edge} X :- {v} X, not {edge} _ X. sink_{edge} X :- {v} X, not {edge} X _.
        outdeg_{edge} X N :- {v} X, N = count {{ Y | {edge} X Y }}. indeg_{edge} X N :- {v} X, N = count {{ Y | {edge} Y X }}.""")
    return SimpleNamespace(v=v, source=f"source_{edge}", sink=f"sink_{edge}", out_degree=f"outdeg_{edge}", in_degree=f"indeg_{edge}")


def shortest(p, edge: str) -> SimpleNamespace:
    """Least weight of a walk; minus infinity where a negative cycle lies on the way."""
    t, name = _node(p, edge, "int"), f"shortest_{edge}"
    p.read(f"{name} : {t} -> {t} -> (d : min int) -> rel. {name} X Y W :- {edge} X Y W. {name} X Z (D + W) :- {name} X Y D, {edge} Y Z W.")
    return SimpleNamespace(dist=name)


def hops(p, edge: str) -> SimpleNamespace:
    t, name = _node(p, edge), f"hops_{edge}"
    p.read(f"{name} : {t} -> {t} -> (d : min int) -> rel. {name} X Y 1 :- {edge} X Y. {name} X Z (D + 1) :- {name} X Y D, {edge} Y Z.")
    return SimpleNamespace(dist=name)


def bounded(p, edge: str, limit: int) -> SimpleNamespace:
    """Walks of at most limit edges, by length."""
    t, name = _node(p, edge), f"bounded{limit}_{edge}"
    p.read(f"{name} : {t} -> {t} -> int -> rel. {name} X Y 1 :- {edge} X Y, 1 <= {limit}. {name} X Z (N + 1) :- {name} X Y N, N < {limit}, {edge} Y Z.")
    return SimpleNamespace(hop=name)


def closure(spark: SparkSession, edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Transitive closure of edges(src, dst) in as many rounds as the logarithm of the longest distance.

    After k rounds all pairs at distance 2**k or less are known, those at exactly 2**k apart. A round sets the latter behind
    all known pairs: every pair at a greater distance up to twice as far is made from a shortest path's last 2**k edges only,
    so a pair on a chain is derived once. Where no pair is exactly so far apart none is farther."""
    tables = tables or Tables(spark)
    named = edges.select(F.col(edges.columns[0]).alias("src"), F.col(edges.columns[1]).alias("dst")).dropna().distinct()
    exact, n = tables.save(named.withColumn("far", F.lit(1)))
    near, pieces = None, [exact]
    while n:
        step = exact.where("far = 1").select(F.col("src").alias("m"), F.col("dst").alias("end"))
        known = exact.where("far = 1") if near is None else near.union(exact.where("far = 1"))
        # far: whether the pair is exactly twice as far apart; the least over all ways decides.
        made = known.join(step, F.col("dst") == F.col("m")).groupBy("src", F.col("end").alias("dst")).agg(F.min("far").alias("far"))
        fresh, n = tables.save(made.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        pieces.append(fresh)
        near = reduce(DataFrame.union, [pieces[0].withColumn("far", F.lit(0)), *[p.withColumn("far", F.lit(0)) for p in pieces[1:-1]], fresh.where("far = 0")])
        exact, n = fresh, n and (0 if fresh.where("far = 1").isEmpty() else n)
    return reduce(DataFrame.union, pieces).select("src", "dst")
