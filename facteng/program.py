"""Programs: declarations, rules, directives and queries, built in Python or read from text, and their evaluation."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as _text
from .ast import Agg, Atom, Cmp, Con, Disj, Lit, Not, Query, Rule, Term, Var, show, term, variables, walk
from .checks import semantics
from .checks.moding import check as check_modes
from .checks.stratify import completeness, stratify
from .errors import ProgramError, Warning_
from .functions.scalars import identity
from .operators.fixpoint import Engine
from .plans.body import Env
from .rewrite.demand import demand
from .rewrite.formulas import Formulas
from .rewrite.simplify import prepare
from .types import BASES, Column, RelSym, Types

DIRECTIVES = ("input", "output", "open", "derivations", "terminates", "demand")


class Program:
    def __init__(self, source: str | None = None, folder: str | None = None):
        """folder: where texts that the source imports are looked for; the working folder by default."""
        self.folder, self.imported = folder or ".", set()
        self.types = Types()
        self.rules: list[Rule] = []
        self.queries: list[Query] = []
        self.inputs: dict[str, DataFrame] = {}
        self.input_facts: list[Atom] = []
        self.demands: list[tuple[str, str]] = []
        self.user_directives: dict[str, Callable] = {}
        self.modules: dict[str, object] = {}
        self.unique: set[str] = set()
        self.formulas = Formulas()
        if source:
            self.read(source)

    # Declarations

    def read(self, source: str) -> Program:
        _text.Reader(source).items(self)
        return self

    def _declare(self, name: str, cols: Iterable, result: str | None = None) -> str:
        if name in self.types.rels or name in BASES or name in self.formulas.arity:
            raise ProgramError("E0404", f"{name} is declared twice")
        made = []
        for i, c in enumerate(cols):
            c = c if isinstance(c, tuple) else (f"c{i}", c)
            label, t, bound = (*c, None)[:3]
            made.append(Column(t, label, bound))
        self.types.rels[name] = RelSym(name, tuple(made), result)
        return name

    def relation(self, name: str, *cols) -> str:
        """Columns as types or (label, type[, "min" or "max"])."""
        return self._declare(name, cols)

    def open_type(self, name: str) -> str:
        self.types.opens.add(name)
        return name

    def constructor(self, name: str, *cols, of: str) -> str:
        return self._declare(name, cols, of)

    def struct(self, name: str, *cols) -> str:
        """A relation that is also the type of its facts, its columns are fields."""
        return self._declare(name, cols)

    def union(self, name: str, *members: str) -> str:
        self.types.unions[name] = members
        return name

    def alias(self, name: str, of: str) -> str:
        self.types.aliases[name] = of
        return name

    def subtype(self, sub: str, sup: str) -> None:
        """sub <: sup. A new name below a base type is a refinement."""
        if self.types.base(sup) != "id" and sub not in self.types.rels:
            self.types.refinements[sub] = sup
        else:
            self.types.edges.setdefault(sub, set()).add(sup)

    # Rules

    def formula(self, name: str, arity: int) -> str:
        """A formula function; rules with its name as head are its clauses, in which every call is replaced."""
        if name in self.types.rels or name in self.formulas.arity:
            raise ProgramError("E0404", f"{name} is declared twice")
        self.formulas.declare(name, arity)
        return name

    def add_rule(self, rule: Rule) -> None:
        if any(h.rel in self.formulas.arity for h in rule.heads):
            self.formulas.add(rule)
        else:
            self.rules.append(rule)

    def rule(self, heads, *body, label: str | None = None) -> None:
        self.add_rule(Rule(tuple(heads) if isinstance(heads, (list, tuple)) else (heads,), tuple(body), label))

    def fact(self, rel: str, *args) -> None:
        self.add_rule(Rule((Atom(rel, tuple(map(term, args))),)))

    def query_formulas(self, q: Query) -> None:
        shown = tuple(v for v in variables(*q.body) if not v.startswith("_"))
        self.queries.append(Query(q.body, shown))

    def query(self, source: str) -> int:
        self.read(f"?- {source}.")
        return len(self.queries) - 1

    # Directives

    def import_text(self, path: str) -> Program:
        """Reads another program text, relative to the text that imports it, once however often it is imported."""
        full = os.path.realpath(os.path.join(self.folder, path if os.path.splitext(path)[1] else f"{path}.dl"))
        if full in self.imported:
            return self
        self.imported.add(full)
        try:
            with open(full) as f:
                source = f.read()
        except OSError as e:
            raise ProgramError("E0201", f"{path} cannot be imported: {e.strerror}") from e
        outer, self.folder = self.folder, os.path.dirname(full)
        try:
            return self.read(source)
        finally:
            self.folder = outer

    def directive(self, name: str, args: list[str]) -> None:
        if name == "import":
            for path in args:
                self.import_text(path.strip('"'))
            return
        if name in self.user_directives:
            self.user_directives[name](self, args)
            return
        if name not in DIRECTIVES or not args or args[0] not in self.types.rels:
            raise ProgramError("E0701", f"%{name} {' '.join(args)}")
        sym = self.types.rels[args[0]]
        if name == "input":
            sym.is_input = True
        elif name == "output":
            sym.is_output = True
        elif name == "open":
            sym.is_input, sym.complete = True, False
        elif name == "derivations":
            sym.derivations = True
        elif name == "terminates":
            sym.terminates = True
        else:
            self.demands.append((args[0], "".join(a for a in args[1:] if a in "+-")))

    def define_directive(self, name: str, transform: Callable[[Program, list[str]], None]) -> None:
        """A directive of the user's: a function that may read and rewrite the program."""
        self.user_directives[name] = transform

    # Inputs

    def load(self, rel: str, df: DataFrame, unique: bool = False) -> Program:
        """Gives a relation its facts, by position. Ints become 64 bits, timestamps microseconds, rows with nulls are
        left out. unique: the caller vouches that rows are distinct, which saves a shuffle."""
        if unique and rel not in self.inputs:
            self.unique.add(rel)
        else:
            self.unique.discard(rel)
        sym = self.types.rels[rel]
        if len(df.columns) != sym.arity:
            raise ProgramError("E0801", f"{rel} has {sym.arity} columns, the input {len(df.columns)}")
        cols = []
        for i, (f, c) in enumerate(zip(df.schema.fields, sym.columns, strict=True)):
            want, x = self.types.base(c.type), F.col(f"`{f.name}`")
            fits = {
                "int": (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.TimestampType, T.DateType),
                "float": (T.DoubleType, T.FloatType),
                "string": (T.StringType,),
                "id": (T.StringType,),
            }[want]
            if not isinstance(f.dataType, fits):
                raise ProgramError("E0801", f"column {i} of {rel} is {want}, not {f.dataType.simpleString()}")
            if isinstance(f.dataType, T.TimestampType):
                x = F.unix_micros(x)
            elif isinstance(f.dataType, T.DateType):
                x = F.unix_micros(x.cast("timestamp"))
            x = x.cast({"int": "long", "float": "double"}.get(want, "string"))
            cols.append((F.struct(F.lit(0).cast("tinyint").alias("inf"), x.alias("v")) if c.bound else x).alias(f"c{i}"))
        plain = df.dropna().select(*cols) if cols else df.select(F.lit(1).alias("unit")).limit(1)
        self.inputs[rel] = self.inputs[rel].union(plain) if rel in self.inputs else plain
        sym.is_input = True
        return self

    def load_facts(self, source: str) -> Program:
        """Reads ground facts; terms nested in them are facts too."""
        for a in _text.read_facts(source):
            sym = self.types.rels.get(a.rel)
            if sym is None:
                raise ProgramError("E0801", f"{a.rel} is not declared")
            if len(a.args) != sym.arity:
                raise ProgramError("E0801", f"{show(a)}: {a.rel} has {sym.arity} columns")
            if variables(a):
                raise ProgramError("E0801", f"{show(a)} is not ground")
            try:
                semantics.typing([Rule((a,))], self.types)
            except ProgramError as e:
                raise ProgramError("E0801", e.message) from e
            self.input_facts.append(a)
        return self

    # Evaluation

    def checked(self) -> tuple[list[Rule], list[list[str]], list[Warning_]]:
        """Rules ready to run, components in order, and what is probably not meant."""
        for r in self.types.rels.values():
            for c in r.columns:
                if not self.types.known(c.type):
                    raise ProgramError("E0404", f"type {c.type} of {r.name} is not declared")
        rules = written = [replace(r, body=self.formulas.inline(r.body)) for r in self.rules]
        queries = [replace(q, body=self.formulas.inline(q.body)) for q in self.queries]
        for rel, modes in self.demands:
            sym, rules = demand(self.types.rels[rel], modes, rules, queries)
            self.types.rels.setdefault(sym.name, sym)
            self.types.rels[rel].terminates = True
        rules = prepare(rules, self.types)
        semantics.bound_columns(self.types.rels, self.types)
        semantics.typing(rules, self.types)
        for r in rules:
            check_modes(r)
        found = semantics.lints(written, self.types)
        parts = stratify(list(self.types.rels), rules)
        completeness({r.name for r in self.types.rels.values() if not r.complete}, rules)
        semantics.consistent(rules, self.types.rels)
        for c in parts:
            semantics.termination(c, rules, self.types.rels)
        return rules, parts, found

    def fingerprint(self, rules: list[Rule]) -> str:
        return hashlib.sha256("\n".join(map(show, rules)).encode()).hexdigest()

    def evaluate(self, spark: SparkSession, max_rounds: int = 10_000, reuse: Result | None = None, cancelled: Callable[[], bool] | None = None) -> Result:
        """All relations at their least fixpoint. reuse: an earlier result of the same inputs, from which components whose
        rules (and whose premises' rules) haven't changed are taken over. cancelled is asked before every round; once it says
        so, evaluation ends with E0999."""
        rules, parts, found = self.checked()
        engine = Engine(spark, self.types, max_rounds)
        engine.unique = set(self.unique)
        engine.cancelled = cancelled or engine.cancelled
        facts = prepare([Rule((a,)) for a in self.input_facts], self.types)
        keys: dict[str, str] = {}
        for rels in parts:
            mine = [r for r in rules if any(t.rel in rels for h in r.heads for t in walk(h) if isinstance(t, (Atom, Con)))]
            below = sorted({keys[t.rel] for r in mine for f in r.body for t in walk(f) if isinstance(t, (Atom, Con)) and t.rel in keys})
            key = hashlib.sha256("\n".join([*sorted(map(show, [*mine, *facts])), *below, *(f"{x}@{id(self.inputs[x])}" for x in rels if x in self.inputs)]).encode()).hexdigest()
            for rel in rels:
                keys[rel] = key
            if reuse is not None and all(reuse.keys.get(rel) == key for rel in rels):
                for rel in rels:
                    engine.states[rel] = reuse.engine.states[rel]
                engine.stats["reused components"] += 1
                continue
            engine.component(rels, rules + facts, self.inputs)
        return Result(self, engine, rules, found, keys)

    # Convenience

    def require(self, rel: str, *columns: str | None, complete: bool = False) -> RelSym:
        """What a functor asks of a parameter: a relation with columns of these types (None: any), E0204 otherwise; and, if it
        negates or aggregates over it, a complete one, E0208 otherwise."""
        sym = self.types.rels.get(rel)
        if sym is None:
            raise ProgramError("E0204", f"{rel} is no relation")
        if len(sym.columns) != len(columns):
            raise ProgramError("E0204", f"{rel} has {len(sym.columns)} columns, not {len(columns)}")
        for c, want in zip(sym.columns, columns, strict=True):
            if want is not None and c.type != want:
                raise ProgramError("E0204", f"column {c.label} of {rel} is {c.type}, not {want}")
        if complete and not sym.complete:
            raise ProgramError("E0208", f"{rel} must be complete")
        return sym

    def use(self, functor: Callable, *args, name: str | None = None):
        """An instance of a functor (a function that adds relations to the program), made once for the same arguments."""
        key = name or f"{functor.__name__}({', '.join(map(str, args))})"
        if key not in self.modules:
            self.modules[key] = functor(self, *args)
        return self.modules[key]


@dataclass
class Result:
    program: Program
    engine: Engine
    rules: list[Rule]
    warnings: list[Warning_]
    keys: dict[str, str]

    def relation(self, name: str, labels: bool = True) -> DataFrame:
        """The facts of a relation; a bound column of infinite value is null here, see extended()."""
        sym = self.program.types.rels[name]
        df = self.engine.scan(name)
        out = []
        for i, c in enumerate(sym.columns):
            x = F.when(F.col(f"c{i}.inf") == 0, F.col(f"c{i}.v")) if c.bound else F.col(f"c{i}")
            out.append(x.alias(c.label if labels and c.label else f"c{i}"))
        return df.select(*out) if out else df

    def extended(self, name: str) -> DataFrame:
        """As relation(), with the bound column as text: a number, -inf or inf."""
        sym = self.program.types.rels[name]
        k = sym.arity - 1
        said = F.when(F.col(f"c{k}.inf") < 0, "-inf").when(F.col(f"c{k}.inf") > 0, "inf").otherwise(F.col(f"c{k}.v").cast("string"))
        return self.engine.scan(name).select(*[F.col(f"c{i}").alias(c.label or f"c{i}") for i, c in enumerate(sym.columns[:-1])], said.alias(sym.columns[-1].label or f"c{k}"))

    def outputs(self, all_relations: bool = False) -> dict[str, DataFrame]:
        """Marked outputs; without any: nothing if there are queries, else every relation that is no input."""
        rels = [r for r in self.program.types.rels.values() if not r.internal]
        marked = [r for r in rels if r.is_output]
        if not all_relations:
            rels = marked or ([] if self.program.queries else [r for r in rels if not r.is_input])
        return {r.name: self.relation(r.name) for r in rels}

    def query(self, k: int = 0) -> DataFrame:
        """Answers of query k: a row for each, columns named like its variables. A query without variables has one row
        if it holds."""
        q = self.program.queries[k]
        body = prepare([Rule((), self.program.formulas.inline(q.body))], self.program.types)
        names, frames = [v for v in q.shown], []
        for r in body:
            env = self.engine.compiler.body(r.body, live=set(names))
            frame = env.df if env.df is not None else self.engine.compiler._frame(env)
            cols = []
            for v in names:
                name, kind = env.vars[v]
                cols.append((F.when(F.col(f"{name}.inf") == 0, F.col(f"{name}.v")) if kind == "ext" else F.col(name)).alias(v))
            frames.append(frame.select(*cols).distinct() if cols else frame.select(F.lit(True).alias("yes")).limit(1))
        out = frames[0]
        for more in frames[1:]:
            out = out.union(more)
        return out.distinct()

    def answers(self, k: int = 0) -> list[str]:
        """The answers as lines, sorted: X = 1, Y = 2. or yes. / no."""
        names, rows = self.program.queries[k].shown, self.query(k).collect()
        if not names:
            return ["yes." if rows else "no."]
        show_id = self._printer()
        return sorted(", ".join(f"{n} = {show_id(r[n])}" for n in names) + "." for r in rows) or ["no."]

    def _printer(self) -> Callable:
        """Prints values; identities are looked up in the relations whose facts are values."""
        known: dict[str, str] = {}
        engine = self.engine
        def load(rel: str) -> None:
            sym = self.program.types.rels[rel]
            kinds = engine.compiler.kinds(sym)
            df = engine.scan(rel)
            rows = df.select(identity(rel, [(F.col(f"c{i}"), k) for i, k in enumerate(kinds)]).alias("id"), *df.columns).collect()
            for r in rows:
                known[r["id"]] = (rel, [r[f"c{i}"] for i in range(sym.arity)])

        def one(v, nested: bool = False) -> str:
            if isinstance(v, str) and "#" in v and v.split("#", 1)[0] in self.program.types.rels:
                rel = v.split("#", 1)[0]
                if v == f"{rel}#":
                    return rel
                if v not in known:
                    load(rel)
                if v in known:
                    name, args = known[v]
                    said = " ".join([name, *(one(a, True) for a in args)])
                    return f"({said})" if nested and args else said
            if isinstance(v, (int, float)) and nested and v < 0:
                return f"({v})"
            if isinstance(v, str):
                return show(Lit(v))
            if hasattr(v, "inf"):
                return str(v.v) if v.inf == 0 else ("-inf" if v.inf < 0 else "inf")
            return str(v)

        return one

    def render(self, name: str) -> list[str]:
        """The facts of a relation as sorted text, terms written out."""
        one, sym = self._printer(), self.program.types.rels[name]
        return sorted(" ".join([name, *(one(r[f"c{i}"], True) for i in range(sym.arity))]) + "." for r in self.engine.scan(name).collect())

    def derivations(self, name: str) -> DataFrame:
        """fact, rule, premises, negated: one row for each way a rule derives a fact from facts, as text. Variables that only
        negated premises have are wildcards there."""
        sym = self.program.types.rels[name]
        if not sym.derivations:
            raise ProgramError("E0701", f"%derivations {name} is missing")
        comp, out = self.engine.compiler, None
        for k, r in enumerate(self.rules):
            for h in r.heads:
                if h.rel != name:
                    continue
                env = comp.body(r.body, live=None)
                frame = comp._frame(env)

                def said(a: Atom, env: Env = env) -> object:
                    parts = [F.lit(a.rel)]
                    for t in a.args:
                        if set(variables(t)) <= set(env.vars) and not (isinstance(t, Var) and t.wild and t.name not in env.vars):
                            c, kind = comp.value(t, env)
                            if kind == "ext":
                                c = F.when(c["inf"] == 0, c["v"].cast("string")).when(c["inf"] < 0, "-inf").otherwise("inf")
                            text = c.cast("string") if kind in ("int", "float", "ext") else F.concat(F.lit('"'), c, F.lit('"')) if kind == "string" else c
                            if kind in ("int", "float"):
                                text = F.when(c < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
                        else:
                            text = F.lit("_")
                        parts.append(text)
                    return F.concat_ws(" ", *parts)

                positive = [said(f) for f in r.body if isinstance(f, Atom)]
                negative = [F.concat(F.lit("not "), said(f.atom)) for f in r.body if isinstance(f, Not)]
                empty = F.array().cast("array<string>")
                row = frame.select(said(h).alias("fact"), F.lit(r.label or f"rule{k}").alias("rule"), (F.array(*positive) if positive else empty).alias("premises"), (F.array(*negative) if negative else empty).alias("negated")).distinct()
                out = row if out is None else out.union(row)
        if out is None:
            schema = "fact string, rule string, premises array<string>, negated array<string>"
            return self.engine.spark.createDataFrame([], T._parse_datatype_string(schema))
        return out

    def stats(self) -> dict[str, int]:
        return dict(self.engine.stats)

    def cleanup(self) -> None:
        self.engine.tables.delete()


def V(names: str):  # noqa: N802
    """Variables by name, one or several."""
    made = [Var(n) for n in names.split()]
    return made[0] if len(made) == 1 else made


def atom(rel: str, *args) -> Atom:
    return Atom(rel, tuple(map(term, args)))


def con(rel: str, *args) -> Con:
    return Con(rel, tuple(map(term, args)))


def count_(target: Term, value, *body) -> Agg:
    return Agg(target, "count", term(value), tuple(body))


def sum_(target: Term, value, *body) -> Agg:
    return Agg(target, "sum", term(value), tuple(body))


def min_(target: Term, value, *body) -> Agg:
    return Agg(target, "min", term(value), tuple(body))


def max_(target: Term, value, *body) -> Agg:
    return Agg(target, "max", term(value), tuple(body))


def cmp(op: str, left, right) -> Cmp:
    return Cmp(op, term(left), term(right))


def not_(a: Atom) -> Not:
    return Not(a)


def either(*options) -> Disj:
    return Disj(tuple(tuple(o) if isinstance(o, (tuple, list)) else (o,) for o in options))

