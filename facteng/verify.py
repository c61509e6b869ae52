"""Re-checking an evaluation: the relations are closed under the rules, every fact has a rule that supports it, and facts of
recursive relations follow from others in some order, so none support only each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .ast import Rule
from .checks.stratify import asserted, reads, stratify
from .operators.fixpoint import State
from .program import Result


def verify(result: Result) -> list[str]:
    """Problems found, none if the result holds: facts that a rule derives and the relation lacks, facts that are neither
    given nor derived by any rule from the result, and facts without a derivation in rounds. One pass of every rule and two
    anti-joins for each relation; for recursive ones naive rounds over what is claimed. Values of bound columns, which improve
    step by step, are checked by the first two only."""
    engine, types, out = result.engine, result.program.types, []
    made: dict[str, list] = {}
    for r in result.rules:
        for rel, df in engine.compiler.heads(r):
            made.setdefault(rel, []).append(engine.typed(df, types.rels[rel]))
    for a in result.program.input_facts:
        for rel, df in engine.compiler.heads(Rule((a,))):
            made.setdefault(rel, []).append(engine.typed(df, types.rels[rel]))
    for rel, sym in types.rels.items():
        frames = made.get(rel, []) + ([engine.typed(result.program.inputs[rel], sym)] if rel in result.program.inputs else [])
        full = engine.scan(rel)
        if not frames:
            if not full.isEmpty():
                out.append(f"{rel} has facts without support")
            continue
        df = frames[0]
        for more in frames[1:]:
            df = df.union(more)
        df = engine.best(df, sym)
        cols = df.columns
        if sym.bound:  # infinite values stand for values that no single rule application reaches
            last = cols[-1]
            full, df = full.where(F.col(f"{last}.inf") == 0), df.where(F.col(f"{last}.inf") == 0)
        if not df.join(full, cols, "left_anti").isEmpty():
            out.append(f"{rel} lacks facts that its rules derive")
        if not full.join(df, cols, "left_anti").isEmpty():
            out.append(f"{rel} has facts without support")
    for rels in stratify(list(types.rels), result.rules):
        rules = [r for r in result.rules if set(rels) & set(asserted(r))]
        if any(rel in rels for r in rules for rel, _ in reads(r.body)) and not any(types.rels[rel].bound for rel in rels):
            out += [f"{rel} has facts that don't follow from the given ones" for rel in _unfounded(result, rels, rules)]
    return out


def _unfounded(result: Result, rels: list[str], rules: list[Rule]) -> list[str]:
    """Relations of a recursive component with claimed facts that rounds from nothing don't reach."""
    engine, types = result.engine, result.program.types
    claimed = {rel: engine.tables.save(engine.scan(rel)) for rel in rels}
    kept, facts = {rel: engine.states[rel] for rel in rels}, [Rule((a,)) for a in result.program.input_facts]
    reached = dict.fromkeys(rels, 0)
    try:
        for rel in rels:
            engine.states[rel] = State()
        while True:
            made: dict[str, list] = {rel: [] for rel in rels}
            for r in [*rules, *facts]:
                for rel, df in engine.compiler.heads(r):
                    if rel in made:
                        made[rel].append(engine.typed(df, types.rels[rel]))
            new = {}
            for rel in rels:
                frames = made[rel] + ([engine.typed(result.program.inputs[rel], types.rels[rel])] if rel in result.program.inputs else [])
                if frames:
                    df = reduce(lambda a, b: a.union(b), frames).distinct()
                    new[rel] = engine.tables.save(claimed[rel][0].join(df, df.columns, "left_semi"))
            if {rel: n for rel, (_, n) in new.items()} == {rel: reached[rel] for rel in new}:
                return [rel for rel in rels if reached[rel] < claimed[rel][1]]
            for rel, table in new.items():
                engine.states[rel].pieces, reached[rel] = [table], table[1]
    finally:
        engine.states.update(kept)
