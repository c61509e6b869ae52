"""The catalogue against DuckDB, files and the command line, and the entry point without the corpus operators."""

import math
import os
import shutil
import subprocess
import sys

import pytest

from facteng import Program
from facteng import queries as Q
from facteng.functions import scalars as S
from facteng.__main__ import main
from facteng.sources.files import fact_lines, table, write

DATA = "/root/testdata/sf0.001"
SLOW = {"hops", "shortest", "demand_fib", "scc", "rtc", "mutual_recursion", "diverge_inf"}  # covered by the engine's tests
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(set(Q.SQL) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    found = duck.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    assert mine == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)


@needs_data
def test_selections_reach_the_scan(spark):
    plan = Q.QUERIES["constant_selection"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in plan
    plan = Q.QUERIES["anti"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Cartesian" not in plan


def test_extended_integers(spark):
    from pyspark.sql import functions as F

    rows = [(-1, 0), (0, -3), (0, 0), (0, 7), (1, 0)]
    df = spark.createDataFrame([(a, b, c, d) for a, b in rows for c, d in rows], "ai int, av long, bi int, bv long")
    a, b = (S.ext(F.col(f"{x}v"), F.col(f"{x}i")) for x in "ab")
    got = df.select("*", *[S.arith(op, (a, "ext"), (b, "ext"))[0].alias(n) for op, n in zip("+-*/", ("add", "sub", "mul", "div"), strict=True)], S.compare("<", (a, "ext"), (b, "ext")).alias("lt")).collect()
    num = lambda i, v: math.inf * i if i else v
    for r in got:
        x, y = num(r.ai, r.av), num(r.bi, r.bv)
        for name, f in (("add", lambda: x + y), ("sub", lambda: x - y), ("mul", lambda: x * y), ("div", lambda: math.trunc(x / y) if math.isfinite(x / y) else x / y)):
            try:
                want = f()
            except ZeroDivisionError:
                want = math.nan
            mine = r[name] and num(r[name].inf, r[name].v)
            assert mine is None if math.isnan(want) else mine == want, (x, name, y)
        assert r.lt == (x < y)


def test_fact_files_and_formats(spark, tmp_path):
    (tmp_path / "f.facts").write_text('edge 1 "a b".\nedge (-2) "c".\nother 5.\n')
    p = Program("edge : int -> string -> rel. other : int -> rel. q : string -> rel. q S :- edge X S, X < 0.")
    p.load("edge", fact_lines(spark, str(tmp_path / "f.facts"), p, "edge"))
    r = p.evaluate(spark)
    assert r.render("q") == ['q "c".']
    write(r.relation("q"), str(tmp_path / "out"), "json")
    assert table(spark, str(tmp_path / "out"), ["c0"], "json").collect()[0].c0 == "c"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.dl").write_text('edge, path : string -> string -> rel. %input edge. path X Y :- edge X Y. path X Z :- path X Y, edge Y Z. ?- path "a" X.')
    (tmp_path / "f").write_text('edge "a" "b". edge "b" "c".')
    assert main(["run", str(tmp_path / "p.dl"), "--facts", str(tmp_path / "f"), "--certify"]) == 0
    assert capsys.readouterr().out == 'X = "b".\nX = "c".\n'
    (tmp_path / "bad.dl").write_text("p : int -> rel. p X.")
    assert main(["check", str(tmp_path / "bad.dl"), "--error-format", "json"]) == 1
    assert '"code": "E0501"' in capsys.readouterr().err


def test_entry_without_the_corpus_operators(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/facteng", tmp_path / "facteng", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tc' in q and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
