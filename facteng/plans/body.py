"""Bodies of rules as DataFrames.

A body in canonical order becomes a chain of joins on shared variables, filters and projections; nothing is collected
and nothing runs until the rule's result is written. Negation is an anti-join of the projected right side, an
aggregate is computed once for the distinct outer bindings it depends on and joined back, so there is no correlated
execution. Join order and strategy, pushdown and pruning are left to Catalyst.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ast import Agg, Arith, As, Asc, Atom, Cmp, Con, Disj, Lit, Named, Neg, Not, Rule, Term, Var, bound_by, fresh, variables
from ..checks.moding import order
from ..errors import ProgramError
from ..functions import scalars as S
from ..types import RelSym, Types

_count = itertools.count()


@dataclass(frozen=True)
class Env:
    """A DataFrame of bindings; vars: variable -> (column name, kind). df None: the one empty binding."""

    df: DataFrame | None
    vars: dict[str, tuple[str, str]]


class Compiler:
    def __init__(self, spark: SparkSession, types: Types, scan: Callable[[str, object], DataFrame]):
        self.spark, self.types, self.scan = spark, types, scan

    # Terms

    def kinds(self, sym: RelSym) -> list[str]:
        return ["ext" if c.bound else self.types.base(c.type) for c in sym.columns]

    def value(self, t: Term, env: Env) -> tuple[Column, str]:
        """A term over bound variables. Facts are computed, not looked up."""
        if isinstance(t, Lit):
            return S.literal(t.value)
        if isinstance(t, Var):
            if t.name not in env.vars:
                raise ProgramError("E0501", f"variable {t.name} is not bound")
            name, kind = env.vars[t.name]
            return F.col(name), kind
        if isinstance(t, Arith):
            return S.arith(t.op, self.value(t.left, env), self.value(t.right, env))
        if isinstance(t, Neg):
            return S.negate(self.value(t.inner, env))
        if isinstance(t, Con):
            sym = self.types.rels[t.rel]
            args = [(S.coerce(*self.value(a, env), k), k) for a, k in zip(t.args, self.kinds(sym), strict=True)]
            return S.identity(t.rel, args), "id"
        if isinstance(t, As):
            return self.value(t.inner, env)
        if isinstance(t, Asc):
            c, kind = self.value(t.inner, env)
            return (F.when(S.tag(c).isin(sorted(self.types.members(t.type))), c), kind) if kind == "id" else (c, kind)
        raise ProgramError("E0405", f"{t} has no value here")

    # Matching

    def _table(self, rel: str, version: object = None) -> tuple[DataFrame, RelSym, list[str]]:
        """A scan with column names that occur nowhere else."""
        sym, k = self.types.rels[rel], next(_count)
        names = [f"t{k}_{i}" for i in range(sym.arity)]
        scanned = self.scan(rel, version)
        return scanned.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]) if names else scanned.select(F.lit(1).alias(f"t{k}_unit")), sym, names

    def atom(self, env: Env, a: Atom, version: object = None, live: set[str] | None = None) -> Env:
        s, sym, names = self._table(a.rel, version)
        if len(a.args) != sym.arity:
            raise ProgramError("E0402", f"{a.rel} has {sym.arity} columns, not {len(a.args)}")
        kinds = self.kinds(sym)
        binds: dict[str, tuple[str, str]] = {}
        joins: list[tuple[tuple[Column, str], tuple[str, str]]] = []
        after: list[tuple[Term, tuple[str, str]]] = []
        work = [(n, k, t) for n, k, t in zip(names, kinds, a.args, strict=True)]
        if a.name:
            own = f"t{next(_count)}_id"
            s = s.withColumn(own, S.identity(a.rel, [(F.col(n), k) for n, k in zip(names, kinds, strict=True)]))
            work.append((own, "id", Var(a.name)))
        while work:
            col, kind, t = work.pop(0)
            if isinstance(t, Var):
                if t.name in env.vars:
                    joins.append((self.value(t, env), (col, kind)))
                elif t.name in binds:
                    s = s.where(S.compare("=", (F.col(binds[t.name][0]), binds[t.name][1]), (F.col(col), kind)))
                else:
                    binds[t.name] = (col, kind)
            elif isinstance(t, Lit):
                s = s.where(S.compare("=", (F.col(col), kind), S.literal(t.value)))
            elif isinstance(t, As):
                work = [(col, kind, Var(t.name)), (col, kind, t.inner), *work]
            elif isinstance(t, Asc):
                if kind == "id":
                    s = s.where(S.tag(F.col(col)).isin(sorted(self.types.members(t.type))))
                work.insert(0, (col, kind, t.inner))
            elif isinstance(t, Named):
                work.insert(0, (col, kind, self.positional(t)))
            elif isinstance(t, Con):
                if not t.args:
                    s = s.where(F.col(col) == S.identity(t.rel, []))
                    continue
                inner, isym, inames = self._table(t.rel)
                ikinds = self.kinds(isym)
                own = f"t{next(_count)}_id"
                inner = inner.withColumn(own, S.identity(t.rel, [(F.col(n), k) for n, k in zip(inames, ikinds, strict=True)]))
                s = s.join(inner, F.col(col) == F.col(own))
                work = [*zip(inames, ikinds, t.args, strict=True), *work]
            elif set(variables(t)) <= set(env.vars):
                joins.append((self.value(t, env), (col, kind)))
            else:
                after.append((t, (col, kind)))
        if env.df is None:
            df = s
        elif joins:
            on = [S.compare("=", left, (F.col(c), k)) for left, (c, k) in joins]
            cond = on[0]
            for more in on[1:]:
                cond = cond & more
            if live is not None and not after and not set(binds) & live:
                return Env(env.df.join(s, cond, "left_semi"), env.vars)  # nothing of the atom is needed later
            df = env.df.join(s, cond)
        else:
            if live is not None and not after and not set(binds) & live:
                s = s.limit(1)  # only whether there is a fact matters
            df = env.df.crossJoin(s)
        out = Env(df, env.vars | binds)
        for t, (c, k) in after:
            out = Env(out.df.where(S.compare("=", self.value(t, out), (F.col(c), k))), out.vars)
        return Env(out.df.select(*[F.col(c) for c, _ in out.vars.values()]) if out.vars else out.df.select(F.lit(1).alias("unit")), out.vars)

    def positional(self, t: Named) -> Con:
        sym = self.types.rels[t.rel]
        args: list[Term] = [fresh() for _ in sym.columns]
        for label, x in t.fields:
            args[sym.index_of(label)] = x
        return Con(t.rel, tuple(args))

    def bind(self, env: Env, var: str, value: tuple[Column, str]) -> Env:
        """The variable gets the value; rows where it is undefined go."""
        name = f"v{next(_count)}"
        df = self._frame(env).withColumn(name, value[0]).where(F.col(name).isNotNull())
        return Env(df, env.vars | {var: (name, value[1])})

    def _frame(self, env: Env) -> DataFrame:
        return env.df if env.df is not None else self.spark.range(1).select(F.lit(1).alias("unit"))

    def comparison(self, env: Env, f: Cmp) -> Env:
        bound = set(env.vars)
        for a, b in ((f.left, f.right), (f.right, f.left)):
            if f.op == "=" and set(variables(b)) <= bound and not set(variables(a)) <= bound:
                if isinstance(a, Var):
                    return self.bind(env, a.name, self.value(b, env))
                tmp = fresh()
                env = self.bind(env, tmp.name, self.value(b, env))
                return self.destructure(env, tmp.name, a)
        return Env(self._frame(env).where(S.compare(f.op, self.value(f.left, env), self.value(f.right, env))), env.vars)

    def destructure(self, env: Env, var: str, t: Term) -> Env:
        if isinstance(t, Con):
            return self.atom(env, Atom(t.rel, t.args, var))
        if isinstance(t, Named):
            return self.destructure(env, var, self.positional(t))
        if isinstance(t, As):
            return self.destructure(self.bind(env, t.name, self.value(Var(var), env)), var, t.inner)
        if isinstance(t, Asc):
            c = self.value(Asc(Var(var), t.type), env)
            return self.destructure(Env(self._frame(env).where(c[0].isNotNull()), env.vars), var, t.inner)
        if isinstance(t, Var) and t.name not in env.vars:
            return self.bind(env, t.name, self.value(Var(var), env))
        return self.comparison(env, Cmp("=", Var(var), t))

    def negation(self, env: Env, f: Not) -> Env:
        """Local variables are existential: the right side is projected to the shared ones first."""
        shared = [x for x in variables(f.atom) if x in env.vars]
        if any(isinstance(a, (Arith, Neg)) for a in f.atom.args):  # computed arguments become comparisons with the outer bindings
            args = []
            for a in f.atom.args:
                if isinstance(a, (Arith, Neg)):
                    v = fresh("N")
                    env = self.bind(env, v.name, self.value(a, env))
                    a = v
                args.append(a)
            return self.negation(env, Not(Atom(f.atom.rel, tuple(args), f.atom.name)))
        inner = self.atom(Env(None, {}), f.atom)
        if not shared:
            right = inner.df.select(F.lit(1).alias("one_r")).limit(1)
            left = self._frame(env).withColumn("one_l", F.lit(1))
            return Env(left.join(right, F.col("one_l") == F.col("one_r"), "left_anti").drop("one_l"), env.vars)
        names = {x: f"n{next(_count)}" for x in shared}
        right = inner.df.select(*[F.col(inner.vars[x][0]).alias(names[x]) for x in shared]).distinct()
        cond = None
        for x in shared:
            one = S.compare("=", self.value(Var(x), env), (F.col(names[x]), inner.vars[x][1]))
            cond = one if cond is None else cond & one
        return Env(env.df.join(right, cond, "left_anti"), env.vars)

    def aggregate(self, env: Env, f: Agg) -> Env:
        inside = variables(*f.body, f.value)
        group = [x for x in inside if x in env.vars]
        try:  # a body that binds the grouping variables by itself runs once, without the outer bindings
            order(f.body)
            free = {x for g in f.body for x in bound_by(g)}
            alone = set(group) <= free and not any(isinstance(g, (Not, Agg)) and set(variables(g)) & set(group) - free for g in f.body)
        except ProgramError:
            alone = False
        if alone or not group:
            start = Env(None, {})
        else:
            seeds = env.df.select(*[F.col(env.vars[x][0]) for x in group]).distinct()
            start = Env(seeds, {x: env.vars[x] for x in group})
        body = self.body(f.body, start, live=None)
        value, kind = self.value(f.value, body) if f.kind != "count" else (F.lit(1), "int")
        keys = {x: f"g{next(_count)}" for x in group}
        local = [x for x in body.vars if x not in keys]
        rows = body.df.select(*[F.col(body.vars[x][0]).alias(keys[x]) for x in group], *[F.col(body.vars[x][0]) for x in local], value.alias("agg_value"))
        rows = rows.select(*keys.values(), *[body.vars[x][0] for x in local], "agg_value").distinct()
        undefined = F.max(F.col("agg_value").isNull()).alias("agg_undefined")
        made = f"a{next(_count)}"
        if f.kind == "count":
            agg = F.count(F.lit(1)).cast("long")
        elif f.kind == "sum" and kind == "int":
            agg = F.expr("try_cast(sum(cast(agg_value as decimal(38,0))) as bigint)")
        elif f.kind == "sum" and kind == "float":
            agg = F.sum("agg_value")
        elif f.kind in ("min", "max"):
            agg = getattr(F, f.kind)("agg_value")
        else:
            raise ProgramError("E0402", f"{f.kind} of a {kind}")
        total = f.kind in ("count", "sum")
        zero = F.lit(0.0) if kind == "float" and f.kind == "sum" else F.lit(0).cast("long")
        if keys:
            sums = rows.groupBy(*keys.values()).agg(agg.alias(made), undefined)
            cond = None
            for x, k in keys.items():
                one = S.compare("=", self.value(Var(x), env), (F.col(k), body.vars[x][1]))
                cond = one if cond is None else cond & one
            df = env.df.join(sums, cond, "left" if total else "inner").where(~F.coalesce("agg_undefined", F.lit(False)))
            if total:  # no valuation: zero; an overflow stays undefined
                df = df.withColumn(made, F.when(F.col("agg_undefined").isNull(), zero).otherwise(F.col(made)))
        else:
            sums = rows.agg(agg.alias(made), undefined).where(~F.coalesce("agg_undefined", F.lit(False)))
            if total:
                sums = sums.withColumn(made, F.when(F.col("agg_undefined").isNull(), zero).otherwise(F.col(made)))
            df = self._frame(env).crossJoin(F.broadcast(sums))  # one row at most
        df = df.where(F.col(made).isNotNull())
        kind = "int" if f.kind == "count" else kind
        out = Env(df.select(*[c for c, _ in env.vars.values()], made), env.vars)
        if isinstance(f.target, Var) and f.target.name not in env.vars:
            return Env(out.df, env.vars | {f.target.name: (made, kind)})
        test = S.compare("=", self.value(f.target, env), (F.col(made), kind))
        return Env(out.df.where(test).drop(made), env.vars)

    def disjunction(self, env: Env, f: Disj) -> Env:
        common = bound_by(f)
        parts = []
        for o in f.options:
            got = self.body(o, env, live=None)
            keep = [x for x in got.vars if x in env.vars or x in common]
            parts.append((got, keep))
        names = {x: f"d{next(_count)}" for x in parts[0][1]}
        frames = [g.df.select(*[F.col(g.vars[x][0]).alias(names[x]) for x in names]) for g, _ in parts]
        df = frames[0]
        for more in frames[1:]:
            df = df.unionByName(more)
        return Env(df.distinct(), {x: (names[x], parts[0][0].vars[x][1]) for x in names})

    def body(self, formulas, env: Env | None = None, versions: dict[int, object] | None = None, live: set[str] | None = frozenset()) -> Env:
        """Bindings of all variables that satisfy the formulas. versions: by identity of an atom, the version it reads.
        live: variables needed afterwards, None for all."""
        env = env or Env(None, {})
        done = order(formulas, set(env.vars))
        for i, f in enumerate(done):
            if isinstance(f, Cmp) and f.op == "=":  # X = c t: c t must be a fact
                for a, b in ((f.left, f.right), (f.right, f.left)):
                    if isinstance(a, Var) and isinstance(b, Con):
                        f = Atom(b.rel, b.args, a.name)
                        break
            if isinstance(f, Atom):
                after = None if live is None else set(live) | set(variables(*done[i + 1 :]))
                env = self.atom(env, f, (versions or {}).get(id(done[i])), after)
            elif isinstance(f, Cmp):
                env = self.comparison(env, f)
            elif isinstance(f, Not):
                env = self.negation(env, f)
            elif isinstance(f, Agg):
                env = self.aggregate(env, f)
            else:
                env = self.disjunction(env, f)
        return env

    # Heads

    def heads(self, rule: Rule, versions: dict[int, object] | None = None, more: Callable[[Env], list[Column]] | None = None) -> list[tuple[str, DataFrame]]:
        """(relation, rows c0..) for every head and every fact nested in it. A rule fires only if all head terms are
        defined."""
        env = self.body(rule.body, Env(None, {}), versions, set(variables(*rule.heads)))
        frame = self._frame(env)
        tuples: list[tuple[str, list[Column]]] = []
        checks: list[Column] = []

        def build(rel: str, args) -> list[tuple[Column, str]]:
            sym = self.types.rels[rel]
            if len(args) != sym.arity:
                raise ProgramError("E0402", f"{rel} has {sym.arity} columns, not {len(args)}")
            out = []
            for a, k in zip(args, self.kinds(sym), strict=True):
                inner = a
                while isinstance(inner, (As, Asc)):
                    inner = inner.inner
                if isinstance(inner, Con):
                    nested = build(inner.rel, inner.args)
                    c = S.identity(inner.rel, nested)
                else:
                    c = S.coerce(*self.value(inner, env), k)
                if isinstance(inner, (Arith, Neg)) or k == "ext":
                    checks.append(c.isNotNull())
                elif k == "int" and isinstance(inner, Var) and env.vars[inner.name][1] == "ext":
                    checks.append(c.isNotNull())
                out.append((c, k))
            tuples.append((rel, [c for c, _ in out]))
            return out

        for h in rule.heads:
            build(h.rel, h.args)
        for c in checks:
            frame = frame.where(c)
        return [(rel, frame.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]) if cols else frame.select(F.lit(1).alias("unit")).limit(1)) for rel, cols in tuples]
