"""Values of bound columns that would improve for ever.

The graph of value propagation has the keys of a component's bound relations as nodes. Every way a rule derives a bound value
from another gives an edge, weighted by how much the derived value improves on the one it is made from. A key on a cycle of
positive weight has an infinite value, and so has all that follows from it.

Cycles are found by relaxing longest paths from all nodes at once, as tables: every node remembers the edge that improved
it last, and once these edges close a cycle its weight is positive. Whether they do is seen by following
them 2, 4, 8, .. steps: after as many steps as there were rounds only what hangs on a cycle still has somewhere to go. Rounds double
between looks; a graph without positive edges needs none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ast import Atom, Cmp, Rule, Var, fresh, variables
from ..functions import scalars as S

WIDE = "decimal(38,0)"


def _flowing(rule: Rule, head: Atom) -> set[str]:
    """Variables whose values flow into the head's bound column."""
    out = set(variables(head.args[-1]))
    while True:
        more = set(out)
        for f in rule.body:
            if isinstance(f, Cmp) and f.op == "=":
                for a, b in ((f.left, f.right), (f.right, f.left)):
                    if isinstance(a, Var) and a.name in more:
                        more |= set(variables(b))
        if more == out:
            return out
        out = more


def _edges(engine, rels: set[str], rules: list[Rule]) -> DataFrame | None:
    """(a, b, w): edges between nodes, each with its largest weight."""
    types, comp, frames = engine.types, engine.compiler, []
    for rule in rules:
        named = tuple(Atom(f.rel, tuple(fresh("flow") if isinstance(t, Var) and t.wild else t for t in f.args), f.name) if isinstance(f, Atom) and f.rel in rels else f for f in rule.body)
        for head in rule.heads:
            to = types.rels[head.rel]
            if head.rel not in rels or not to.bound:
                continue
            flow = _flowing(Rule(rule.heads, named), head)
            made_from = [f for f in named if isinstance(f, Atom) and f.rel in rels and types.rels[f.rel].bound and set(variables(f.args[-1])) & flow]
            if not made_from:
                continue
            env = comp.body(named, live=None)
            frame = comp._frame(env)

            def node(a: Atom, env=env):
                kinds = comp.kinds(types.rels[a.rel])
                return S.identity(a.rel, [(S.coerce(*comp.value(t, env), k), k) for t, k in zip(a.args[:-1], kinds[:-1], strict=True)])

            def number(a: Atom, env=env):
                return S.coerce(*comp.value(a.args[-1], env), "ext")

            v = number(head)
            for f in made_from:
                source, x = types.rels[f.rel], number(f)
                up = lambda c, sym: c["v"].cast(WIDE) * (1 if sym.bound == "max" else -1)
                w = (up(v, to) - up(x, source)).cast(WIDE)
                frames.append(frame.where((v["inf"] == 0) & (x["inf"] == 0)).select(node(f).alias("a"), node(head).alias("b"), w.alias("w")))
    if not frames:
        return None
    return reduce(DataFrame.union, frames).groupBy("a", "b").agg(F.max("w").alias("w"))


def diverging(engine, rels: list[str], rules: list[Rule]) -> dict[str, DataFrame]:
    """For each bound relation its facts that a positive cycle improves for ever, with the infinite value."""
    bound = {r for r in rels if engine.types.rels[r].bound}
    edges = _edges(engine, bound, rules)
    if edges is None:
        return {}
    edges, _ = engine.tables.save(edges)
    if edges.where("w > 0").isEmpty():
        return {}
    known, n = engine.tables.save(edges.select(F.col("b").alias("node"), F.lit(0).cast(WIDE).alias("far"), F.lit(None).cast("string").alias("by")).distinct())
    for rounds in range(1, n + 2):
        at = F.coalesce(F.col("far"), F.lit(0).cast(WIDE))
        tried = edges.join(known.withColumnRenamed("node", "a"), "a", "left").select(F.col("b").alias("node"), (F.col("w") + at).cast(WIDE).alias("far"), F.col("a").alias("by"))
        best = tried.groupBy("node").agg(F.max(F.struct("far", "by")).alias("best"))
        better = F.col("best.far") > F.col("far")
        step = known.join(best, "node").select("node", F.when(better, F.col("best.far")).otherwise(F.col("far")).alias("far"), F.when(better, F.col("best.by")).otherwise(F.col("by")).alias("by"), better.alias("new"))
        step, _ = engine.tables.save(step)
        if step.where("new").isEmpty():
            return {}
        known = step.drop("new")
        if rounds & (rounds - 1) == 0 or rounds > n:
            marks = _on_cycles(engine, known, rounds)
            if not marks.isEmpty():
                return {rel: _infinite(engine, rel, marks) for rel in bound}
    return {}


def _on_cycles(engine, known: DataFrame, rounds: int) -> DataFrame:
    """Nodes from which following the last improvements back never ends."""
    back, _ = engine.tables.save(known.where("by is not null").select("node", "by"))
    for _ in range(rounds.bit_length() + 1):
        back, n = engine.tables.save(back.join(back.select(F.col("node").alias("by"), F.col("by").alias("next")), "by").select("node", F.col("next").alias("by")))
        if not n:
            break
    return back.select("node")


def _infinite(engine, rel: str, marks: DataFrame) -> DataFrame:
    sym = engine.types.rels[rel]
    kinds, keys, last = engine.compiler.kinds(sym), [f"c{i}" for i in range(sym.arity - 1)], f"c{sym.arity - 1}"
    worst = S.ext(F.lit(0).cast("long"), F.lit(-1 if sym.bound == "min" else 1))
    full = engine.scan(rel).where(F.col(f"{last}.inf") == 0)
    node = S.identity(rel, [(F.col(c), k) for c, k in zip(keys, kinds[:-1], strict=True)])
    return full.withColumn("node", node).join(marks, "node", "left_semi").select(*keys, worst.alias(last))
