"""Proofs of least depth for derived facts, and their export as JSON."""

from __future__ import annotations

import json
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ast import Agg, Cmp, Con, Disj, Lit, Neg, Not, Term, Var
from ..errors import ProgramError
from ..operators.store import Tables
from ..program import Result


def all_derivations(result: Result) -> DataFrame:
    """fact, rule, premises, negated over all relations that rules derive."""
    out = None
    for name in dict.fromkeys(h.rel for r in result.program.rules if r.body for h in r.heads):
        sym = result.program.types.rels[name]
        marked, sym.derivations = sym.derivations, True
        df = result.derivations(name)
        sym.derivations = marked
        out = df if out is None else out.union(df)
    return out


def least_depths(derivations: DataFrame, tables: Tables) -> DataFrame:
    """(fact, depth): 0 for premises that nothing derives, else one more than the deepest premise of the best derivation.
    Every round is a join and two aggregations; a fact's depth is final when it first appears."""
    d = derivations.select("fact", "premises", F.xxhash64("fact", "rule", "premises").alias("k"))
    d, n = tables.save(d)
    premises = d.select(F.explode("premises").alias("fact")).distinct()
    known, n = tables.save(premises.join(d, "fact", "left_anti").select("fact", F.lit(0).alias("depth")))
    free = d.where(F.size("premises") == 0).select("fact", F.lit(1).alias("depth")).distinct()
    known, _ = tables.save(known.union(free))
    for depth in count(1):  # ends, as every round but the last adds facts
        open_ = d.join(known, "fact", "left_anti")
        met = open_.select("k", "fact", F.explode("premises").alias("p")).join(known.select(F.col("fact").alias("p"), F.lit(1).alias("ok")), "p", "left")
        new = met.groupBy("k", "fact").agg(F.min(F.coalesce("ok", F.lit(0))).alias("all")).where("all = 1").select("fact", F.lit(depth).alias("depth")).distinct()
        new, n = tables.save(new)
        if not n:
            return known
        known, _ = tables.save(known.union(new))


def _simple(t: Term) -> bool:
    return isinstance(t, (Var, Lit)) or (isinstance(t, Con) and not t.args) or (isinstance(t, Neg) and isinstance(t.inner, Lit))


def outside_fragment(result: Result) -> list[tuple[str, str]]:
    """(rule, reason) of the rules whose derivations cannot be exported: exported rules have atoms, negated atoms and
    comparisons of variables and constants, nothing else."""
    out = []
    for k, r in enumerate(result.rules):
        why = None
        for h in r.heads if r.body else ():
            if result.program.types.rels[h.rel].bound:
                why = f"{h.rel} has a bound column"
            elif not all(map(_simple, h.args)):
                why = "its head has an argument that is a constructor term or an expression"
        for f in r.body:
            if isinstance(f, Agg):
                why = why or "it has an aggregate"
            elif isinstance(f, Disj):
                why = why or "it has a disjunction"
            elif isinstance(f, Cmp):
                if not (_simple(f.left) and _simple(f.right)):
                    why = why or "a comparison has an argument that is a constructor term or an expression"
            else:
                a = f.atom if isinstance(f, Not) else f
                if a.name:
                    why = why or "it binds the identity of a fact"
                elif not all(map(_simple, a.args)):
                    why = why or "an atom of its body has an argument that is a pattern or an expression"
        if why:
            out.append((r.label or f"rule{k}", why))
    return out


def export(result: Result, facts: list[str] | None = None, form: str = "trees") -> str:
    """JSON of least-depth proofs. form trees: nested premises; ordered-graph: a list in which premises come before what
    they prove. facts: the texts of the facts to prove, all derived ones by default; what is printed comes to the driver.
    Rules outside the exported fragment are refused."""
    for rule, why in outside_fragment(result):
        raise ProgramError("E0956", f"{rule} cannot be exported: {why}")
    d = all_derivations(result)
    depth = {r.fact: r.depth for r in least_depths(d, result.engine.tables).collect()}
    best: dict[str, tuple] = {}
    for r in sorted(d.collect(), key=lambda r: (r.fact, r.rule, r.premises)):
        if all(p in depth for p in r.premises):
            cost = max((depth[p] for p in r.premises), default=0)
            if r.fact not in best or cost < best[r.fact][0]:
                best[r.fact] = (cost, r.rule, list(r.premises), list(r.negated))
    wanted = sorted(best) if facts is None else facts

    def tree(fact: str) -> dict:
        if fact not in best or depth.get(fact) == 0:
            return {"fact": fact}
        _, rule, premises, negated = best[fact]
        return {"fact": fact, "rule": rule, "premises": [tree(p) for p in premises]} | ({"absent": negated} if negated else {})

    if form == "trees":
        return json.dumps([tree(f) for f in wanted], sort_keys=True)
    order: dict[str, int] = {}

    def place(fact: str) -> None:
        if fact in order:
            return
        for p in best[fact][2] if fact in best and depth.get(fact) else []:
            place(p)
        order[fact] = len(order)

    for f in wanted:
        place(f)
    nodes = [{"id": k, "fact": f} | ({"rule": best[f][1], "premises": [order[p] for p in best[f][2]]} if f in best and depth.get(f) else {}) for f, k in order.items()]
    return json.dumps(nodes, sort_keys=True)
