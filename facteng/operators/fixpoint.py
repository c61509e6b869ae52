"""Bottom-up evaluation, component by component, semi-naive within a component.

A round joins each recursive premise's last additions (delta) with the older and newer state of the others, takes away what is
known, and writes what is left to the shared folder. Premises before the delta read the old state, later ones the full
full one, so no combination is made twice; variants whose delta is empty are skipped. Bound relations keep the best value of each
key; after 4, 8, 16, .. rounds the values that improve for ever are looked for and become infinite.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ast import Atom, Cmp, Con, Rule, Var
from ..checks.stratify import asserted, reads
from ..errors import ProgramError
from ..functions.scalars import EXT
from ..plans.body import Compiler
from ..types import RelSym, Types
from .divergence import diverging
from .store import Tables

_KIND = {"int": "bigint", "float": "double", "string": "string", "id": "string", "ext": EXT}


@dataclass
class State:
    """A relation: the full table as pieces, the newest of which is the delta."""

    pieces: list[tuple[DataFrame, int | None]] = field(default_factory=list)  # rows None: a plan, not written
    old: DataFrame | None = None  # of bound relations, whose tables are replaced

    @property
    def rows(self) -> int:
        return sum(1 if n is None else n for _, n in self.pieces)


class Engine:
    def __init__(self, spark: SparkSession, types: Types, max_rounds: int = 10_000):
        self.spark, self.types, self.max_rounds = spark, types, max_rounds
        self.tables = Tables(spark)
        self.states: dict[str, State] = {}
        self.stats: Counter[str] = Counter()
        self.compiler = Compiler(spark, types, self.scan)
        self.cancelled: Callable[[], bool] = lambda: False  # asked before every round
        self.unique: set[str] = set()  # inputs whose rows are known to be distinct

    def schema(self, sym: RelSym) -> str:
        kinds = self.compiler.kinds(sym)
        return ", ".join(f"c{i} {_KIND[k]}" for i, k in enumerate(kinds)) or "unit int"

    def empty(self, sym: RelSym) -> DataFrame:
        return self.spark.createDataFrame([], T._parse_datatype_string(self.schema(sym)))

    def scan(self, rel: str, version: object = None) -> DataFrame:
        state, sym = self.states.get(rel), self.types.rels[rel]
        if state is None or not state.pieces:
            return self.empty(sym)
        if version == "delta":
            return state.pieces[-1][0]
        if version == "old":
            if sym.bound:
                return state.old if state.old is not None else self.empty(sym)
            use = state.pieces[:-1]
        else:
            use = state.pieces
        use = [d for d, n in use if n is None or n] or [self.empty(sym)]
        out = use[0]
        for more in use[1:]:
            out = out.union(more)
        return out

    def typed(self, df: DataFrame, sym: RelSym) -> DataFrame:
        kinds = self.compiler.kinds(sym)
        return df.select(*[F.col(f"c{i}").cast(_KIND[k]).alias(f"c{i}") for i, k in enumerate(kinds)]) if kinds else df.select(F.lit(1).alias("unit"))

    def best(self, df: DataFrame, sym: RelSym) -> DataFrame:
        """Set semantics: distinct facts, or the best value of each key."""
        if not sym.bound:
            return df.distinct()
        keys, last = [f"c{i}" for i in range(sym.arity - 1)], f"c{sym.arity - 1}"
        agg = (F.min if sym.bound == "min" else F.max)(last).alias(last)
        return df.groupBy(*keys).agg(agg) if keys else df.agg(agg).where(F.col(last).isNotNull())

    def fresh_rows(self, df: DataFrame, sym: RelSym) -> DataFrame:
        """Rows of df that add something to the relation."""
        state = self.states[sym.name]
        df = self.best(df, sym)
        if not state.rows:
            return df
        full = self.scan(sym.name)
        cols = [f"c{i}" for i in range(sym.arity)] or ["unit"]
        if not sym.bound:
            return df.join(full, cols, "left_anti")
        keys, last = cols[:-1], cols[-1]
        held = full.select(*keys, F.col(last).alias("held")) if keys else full.select(F.col(last).alias("held"))
        both = df.join(held, keys, "left") if keys else df.join(held, F.lit(True), "left")
        better = F.col(last) < F.col("held") if sym.bound == "min" else F.col(last) > F.col("held")
        return both.where(F.col("held").isNull() | better).select(*cols)

    def add(self, sym: RelSym, df: DataFrame) -> int:
        """Writes the new rows of df as the relation's delta; how many there are."""
        state = self.states[sym.name]
        new, n = self.tables.save(self.fresh_rows(self.typed(df, sym), sym))
        if not sym.bound:
            state.pieces.append((new, n))
            if len(state.pieces) > 24:  # many small tables make slow plans
                merged = self.tables.save(self._union(state.pieces[:-1], sym))
                state.pieces = [merged, state.pieces[-1]]
            return n
        full = self.scan(sym.name)
        state.old = full
        keys = [f"c{i}" for i in range(sym.arity - 1)]
        if n:
            rest = full.join(new, keys, "left_anti") if keys else full.limit(0)
            whole = self.tables.save(rest.union(new))
            state.pieces = [whole, (new, 0)]  # the delta is part of the first piece
        else:
            state.pieces = [(full, state.rows), (new, 0)] if state.pieces else [(new, 0)]
        return n

    def _union(self, pieces, sym: RelSym) -> DataFrame:
        use = [d for d, n in pieces if n is None or n] or [self.empty(sym)]
        out = use[0]
        for more in use[1:]:
            out = out.union(more)
        return out

    def component(self, rels: list[str], rules: list[Rule], given: dict[str, DataFrame]) -> None:
        comp = set(rels)
        mine = [r for r in rules if comp & set(asserted(r))]
        for rel in rels:
            self.states[rel] = State()
        recursive = lambda r: any(rel in comp for rel, _ in reads(r.body))
        start: dict[str, list[DataFrame]] = {rel: [] for rel in rels}
        for rel in rels:
            if rel in given:
                start[rel].append(self.typed(given[rel], self.types.rels[rel]))
        for r in mine:
            if not recursive(r):
                for rel, df in self.compiler.heads(r):
                    if rel in comp:
                        start[rel].append(self.typed(df, self.types.rels[rel]))
        left = {}
        again = [r for r in mine if recursive(r)]
        for rel in {rel for r in again for rel, _ in reads(r.body)} - comp:
            self.ensure(rel)
        for rel in rels:
            sym = self.types.rels[rel]
            frames = start[rel]
            df = frames[0] if frames else self.empty(sym)
            for more in frames[1:]:
                df = df.union(more)
            if again:
                left[rel] = self.add(sym, df) if frames else 0
            elif frames:  # a plan that Catalyst may combine with what reads it
                known = len(frames) == 1 and rel in given and rel in self.unique
                self.states[rel].pieces = [(df if known else self.best(df, sym), None)]
        self._rounds(rels, again, left)
        self.stats["components"] += 1

    def extend(self, rules: list[Rule], new: dict[str, DataFrame]) -> dict[str, int]:
        """Adds facts to an evaluated program without negation or aggregates and derives what follows, from the additions
        only; how many facts each given relation gained."""
        for r in rules:
            if any(strict for _, strict in reads(r.body)):
                raise ProgramError("E0602", "only a program without negation and aggregates can grow")
        rels = list(self.types.rels)
        for rel in rels:
            self.states.setdefault(rel, State())
            self.ensure(rel)
        left = dict.fromkeys(rels, 0)
        for rel, df in new.items():
            sym = self.types.rels[rel]
            rows = self.tables.save(self.fresh_rows(self.typed(df, sym), sym))
            if rows[1]:
                left[rel] = self.add_saved(sym, *rows)
        gained = {rel: left[rel] for rel in new}
        for rel in rels:
            if not left[rel] and not self.types.rels[rel].bound:
                self.states[rel].pieces.append((self.empty(self.types.rels[rel]), 0))
        self._rounds(rels, [r for r in rules if r.body], left)
        return gained

    def _rounds(self, rels: list[str], again: list[Rule], left: dict[str, int]) -> None:
        comp = set(rels)
        rounds = 0
        while again and any(left.values()):
            rounds += 1
            if self.cancelled():
                raise ProgramError("E0999", "evaluation was cancelled")
            if rounds > self.max_rounds:
                raise ProgramError("E0603", f"no fixpoint after {self.max_rounds} rounds")
            made: dict[str, list[DataFrame]] = {rel: [] for rel in rels}
            for r in again:
                reading = [(f, self._read(f)) for f in r.body if self._read(f) in comp]
                for k, (f, rel) in enumerate(reading):
                    if not left[rel]:
                        self.stats["skipped variants"] += 1
                        continue
                    versions = {id(g): "old" for g, _ in reading[:k]} | {id(f): "delta"}
                    for head, df in self.compiler.heads(r, versions):
                        if head in comp:
                            made[head].append(self.typed(df, self.types.rels[head]))
            frames = {}
            for rel, dfs in made.items():
                df = dfs[0] if dfs else None
                for more in dfs[1:]:
                    df = df.union(more)
                frames[rel] = df
            if rounds >= 4 and rounds & (rounds - 1) == 0 and any(self.types.rels[rel].bound for rel in rels):
                for rel, df in diverging(self, rels, again).items():
                    frames[rel] = df if frames[rel] is None else frames[rel].union(self.typed(df, self.types.rels[rel]))
            # All rules of a round read the same state, so deltas are replaced only after all are written.
            new = {}
            for rel, df in frames.items():
                sym = self.types.rels[rel]
                if df is not None:
                    new[rel] = self.tables.save(self.fresh_rows(df, sym))
            for rel in rels:
                sym, state = self.types.rels[rel], self.states[rel]
                if rel in new and new[rel][1]:
                    left[rel] = self.add_saved(sym, *new[rel])
                else:
                    left[rel] = 0
                    if sym.bound:
                        state.old = self.scan(rel)
                        state.pieces = [*state.pieces[:1], (self.empty(sym), 0)]
                    else:
                        state.pieces.append((self.empty(sym), 0))
        self.stats["rounds"] += rounds

    def add_saved(self, sym: RelSym, new: DataFrame, n: int) -> int:
        state = self.states[sym.name]
        if not sym.bound:
            state.pieces = [p for p in state.pieces if p[1]] + [(new, n)]
            if len(state.pieces) > 24:
                merged = self.tables.save(self._union(state.pieces[:-1], sym))
                state.pieces = [merged, state.pieces[-1]]
            return n
        full = self.scan(sym.name)
        state.old = full
        keys = [f"c{i}" for i in range(sym.arity - 1)]
        rest = full.join(new, keys, "left_anti") if keys else full.limit(0)
        state.pieces = [self.tables.save(rest.union(new)), (new, 0)]
        return n

    def _read(self, f) -> str | None:
        if isinstance(f, Atom):
            return f.rel
        if isinstance(f, Cmp) and f.op == "=":
            for a, b in ((f.left, f.right), (f.right, f.left)):
                if isinstance(a, Var) and isinstance(b, Con):
                    return b.rel
        return None

    def ensure(self, rel: str) -> None:
        """Writes a relation that is only a plan so far, before rounds read it again and again."""
        state = self.states.get(rel)
        if state is not None and any(n is None for _, n in state.pieces):
            state.pieces = [self.tables.save(self.scan(rel))]

    def run(self, order: list[list[str]], rules: list[Rule], given: dict[str, DataFrame]) -> None:
        for rels in order:
            self.component(rels, rules, given)
