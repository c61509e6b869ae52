"""The engine against naive evaluation, feature by feature; the naive evaluator itself; and what refuses or cancels."""

import random

import pytest

from facteng import Program
from facteng.errors import ProgramError
from facteng.functions import numerals
from facteng.lib import lists
from facteng.naive import holds, perfect, unfounded
from facteng.sources.proofs import export, outside_fragment
from facteng.verify import verify

GRAPH = "flight : string -> string -> int -> rel. "
PROGRAMS = {
    "negation": GRAPH + "city, end, far : string -> rel. city X :- flight X _ _. city Y :- flight _ Y _. end X :- city X, not flight X _ _. far X :- city X, not flight 'A' X _.".replace("'", '"'),
    "negated recursion below": GRAPH + 'go : string -> string -> rel. lost : string -> string -> rel. go X Y :- flight X Y _. go X Z :- go X Y, flight Y Z _. lost X Y :- go X _, go Y _, not go X Y.',
    "aggregates": GRAPH + "n : string -> int -> rel. best : string -> int -> rel. total : int -> rel. n X N :- flight X _ _, N = count { Y | flight X Y _ }. best X M :- flight X _ _, M = max { W | flight X _ W }. total S :- S = sum { W | flight _ _ W }.",
    "aggregate of an aggregate": GRAPH + "top : int -> rel. top M :- M = max { N | flight X _ _, N = count { Y | flight X Y _ } }.",
    "disjunction": GRAPH + "q : string -> rel. q X :- flight X Y W, (W < 3 ; W > 7, X <> Y).",
    "disjunction under aggregates": GRAPH + "q : string -> int -> rel. q X N :- flight X _ _, N = count { Y | (flight X Y W, W > 2 ; flight Y X W) }.",
    "bound columns": GRAPH + "near : string -> string -> (d : min int) -> rel. near X Y W :- flight X Y W. near X Z (D + W) :- near X Y D, flight Y Z W.",
    "undefined arithmetic": GRAPH + "q : string -> int -> rel. q X (100 / (W - 4)) :- flight X _ W. big : int -> rel. big (W * 9223372036854775807) :- flight _ _ W.",
    "negative numbers and folding": GRAPH + "q : int -> rel. q (-W) :- flight _ _ W, -W < 0 - 2 * 2 + 1. r : int -> rel. r (7 / 2 - 10).",
    "several heads": GRAPH + "a, b : string -> rel. a X, b Y :- flight X Y W, W > 4.",
    "repeated variables": GRAPH + "loop : string -> rel. loop X :- flight X X _. pair : string -> string -> rel. pair X Y :- flight X Y W, flight Y X W.",
    "formula functions": GRAPH + "small : int -> prop. small X :- X < 3. small X :- X = 7. joined : string -> string -> prop. joined X Y :- flight X Z _, flight Z Y W, not big W. big : int -> prop. big N :- N > 8. "
    + "none : int -> prop. diagonal : string -> string -> prop. diagonal X X :- flight X _ _. q : string -> rel. q X :- flight X _ W, small W. r : string -> string -> rel. r X Y :- joined X Y, not big 9, flight X _ W, not none W. "
    + "r X Y :- joined X Y, flight X _ Z, small (Z - 1). s : string -> int -> rel. s X N :- flight X _ _, N = count { Y | flight X Y W, small W }. t : string -> rel. t X :- flight X Y _, diagonal X Y.",
    "mutual recursion": GRAPH + "odd, even : string -> string -> rel. odd X Y :- flight X Y _. odd X Z :- even X Y, flight Y Z _. even X Z :- odd X Y, flight Y Z _.",
    "values": GRAPH + "leg : type. hop : string -> string -> leg. used : leg -> int -> rel. used (hop X Y) W :- flight X Y W. q : string -> int -> rel. q Y W :- used (hop _ Y) W, W > 3. r : string -> rel. r X :- flight X Y _, L = hop Y X.",
    "demand under negation": GRAPH + 'go, q : string -> string -> rel. %demand go + -. go X Y :- flight X Y _. go X Z :- flight X Y _, go Y Z. c : string -> rel. c X :- flight X _ _. q X Y :- c X, c Y, not go X Y, X < Y.',
    "demand under aggregates": GRAPH + 'go : string -> string -> rel. %demand go + -. go X Y :- flight X Y _. go X Z :- flight X Y _, go Y Z. q : string -> int -> rel. q X N :- flight X _ W, W > 5, N = count { Y | go X Y }.',
    "demand under disjunction": GRAPH + 'go : string -> string -> rel. %demand go + -. go X Y :- flight X Y _. go X Z :- flight X Y _, go Y Z. q : string -> rel. q Y :- (go "A" Y ; go "B" Y).',
    "a rule split over strata": "src : int -> rel. src 1. src 2. box : type. mk : int -> box. r, s : int -> rel. s N :- N = count { X | src X }. r X, s (X + 10) :- src X, not r 5. t : box -> rel. t (mk X) :- r X. u : int -> rel. u X :- t (mk X).",
}


@pytest.mark.parametrize("name", sorted(PROGRAMS))
def test_engine_equals_naive_evaluation(spark, name):
    rng = random.Random(name)
    rows = sorted({(rng.choice("ABCDE"), rng.choice("ABCDE"), rng.randint(0, 9)) for _ in range(9)} | {("A", "B", 4), ("C", "C", 2)})
    make = lambda: Program(PROGRAMS[name])
    p = make()
    given = {"flight": {tuple(r) for r in rows}} if "flight" in p.types.rels else {}
    if given:
        p.load("flight", spark.createDataFrame(rows, "a string, b string, w int"))
    try:
        want = perfect(make(), given)
    except ProgramError as e:
        with pytest.raises(ProgramError) as mine:
            p.evaluate(spark)
        assert mine.value.code == e.code
        return
    got = p.evaluate(spark)
    plain = [r for r in want if not any(isinstance(v, tuple) for f in want[r] for v in f) and not got.program.types.rels[r].internal]
    for rel in plain:
        assert {tuple(x) for x in got.relation(rel).collect()} == want[rel], rel
    assert any(want[r] for r in plain)


def test_formula_functions_that_are_refused():
    for code, text in (("E0603", "f : int -> prop. f X :- f X. q : int -> rel. q X :- f X."), ("E0402", "f : int -> prop. f X :- X > 1. q : int -> rel. q 1 :- f 1 2."),
                       ("E0404", "f : int -> prop. f : int -> rel."), ("E0502", "p : int -> rel. f : int -> prop. f X :- p X, X > 1. q : int -> rel. q X :- p X, not f X.")):
        with pytest.raises(ProgramError) as e:
            Program(text).checked()
        assert e.value.code == code


def test_what_holds_after_some_rounds():
    p = lambda: Program("next, go : int -> int -> rel. next 1 2. next 2 3. next 3 4. go X Y :- next X Y. go X Z :- go X Y, next Y Z.")
    assert holds(p(), "go", 1, 4) and not holds(p(), "go", 1, 4, rounds=2) and holds(p(), "go", 1, 3, rounds=2) and not holds(p(), "go", 4, 1)
    assert unfounded(p(), {"go": {(1, 4), (4, 4)}, "next": {(1, 2)}}) == {"go": {(4, 4)}}


def test_facts_that_only_support_each_other_are_found(spark):
    p = Program("seed, p, q : int -> rel. seed 1. p X :- seed X. p X :- q X. q X :- p X.")
    r = p.evaluate(spark)
    assert verify(r) == []
    for rel in ("p", "q"):
        state = r.engine.states[rel]
        state.pieces = [(r.engine.scan(rel).union(spark.createDataFrame([(99,)], "c0 long")), 2)]
    assert sorted(verify(r)) == ["p has facts that don't follow from the given ones", "q has facts that don't follow from the given ones"]


def test_only_the_exported_fragment_is_exported(spark):
    r = Program("e : int -> int -> rel. e 1 2. n : int -> int -> rel. @plus n X (Y + 1) :- e X Y. @few n X N :- e X _, N = count { Y | e X Y }. @ok n X Y :- e X Y, X < Y.").evaluate(spark)
    assert [x for x, _ in outside_fragment(r)] == ["plus", "few"]
    with pytest.raises(ProgramError) as e:
        export(r)
    assert e.value.code == "E0956"


def test_cancellation(spark):
    calls = iter([False, False, True])
    p = Program("next, go : int -> int -> rel. " + " ".join(f"next {k} {k + 1}." for k in range(9)) + " go X Y :- next X Y. go X Z :- go X Y, next Y Z.")
    with pytest.raises(ProgramError) as e:
        p.evaluate(spark, cancelled=lambda: next(calls))
    assert e.value.code == "E0999"


def test_list_and_number_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3, 1, 3], [4]), ([], [1, 2])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = df.select(lists.append(a, b), lists.reverse(a), lists.map_(a, lambda x: x + 1), lists.filter_(a, lambda x: x > 1), lists.any_(a, lambda x: x == 1), lists.all_(a, lambda x: x == 3),
                    lists.elem(a, 3), lists.concat(F.array(a, b, a)), lists.if_(lists.same(a, b), F.lit(1), F.lit(2)), lists.diff(a, F.array(F.lit(1))), lists.length(a),
                    lists.fold_right(a, F.lit(0), lambda x, acc: x - acc), lists.fold_left(a, F.lit(0), lambda acc, x: x - acc), lists.lookup(a, a, F.lit(1)), F.size(lists.zip_shorter(a, b))).collect()
    assert tuple(got[0]) == ([3, 1, 3, 4], [3, 1, 3], [4, 2, 4], [3, 3], True, False, True, [3, 1, 3, 4, 3, 1, 3], 2, [3, 3], 3, 5, 5, 1, 1)
    assert tuple(got[1]) == ([1, 2], [], [], [], False, True, False, [1, 2], 2, [], 0, 0, 0, None, 0)
    assert lists.iterate(3, lambda x: x * 2, 1) == 8
    assert (numerals.nat_minus(2, 5), numerals.nat_div(7, 0), numerals.nat_mod(7, 0), numerals.int_div(-7, 2), numerals.int_div(1, 0), numerals.fits64(1 << 63)) == (0, 0, 7, -3, 0, False)


def test_values_that_improve_for_ever(spark):
    """A long chain into a cycle whose weight is negative, far more keys than rounds, and a cycle of positive weight."""
    n = 3000
    edges = [(k, k + 1, 2) for k in range(5)] + [(5, 6, 1), (6, 7, -4), (7, 5, 2), (7, 100, 3)] + [(0, 200, 1), (200, 201, 1), (201, 200, 5)]
    edges += [(0, 1000 + k, k) for k in range(n)] + [(100, 1000, 1)]
    p = Program("""road : int -> int -> int -> rel. near : int -> (d : min int) -> rel. far : int -> (d : max int) -> rel.
        near 0 0. near Y (D + W) :- near X D, road X Y W. far 0 0. far Y D :- far X C, road X Y W, D = C - W.""")
    p.load("road", spark.createDataFrame(edges, "a int, b int, w int"))
    r = p.evaluate(spark)
    got = {x.c0: x.d for x in r.extended("near").collect()}
    assert {k for k, v in got.items() if v == "-inf"} == {5, 6, 7, 100, 1000}
    assert got[4] == "8" and got[201] == "2" and got[1007] == "7" and len(got) == 6 + 2 + 1 + 2 + n
    far = {x.c0: x.d for x in r.extended("far").collect()}
    assert {k for k, v in far.items() if v == "inf"} == {5, 6, 7, 100, 1000} and far[201] == "-2"
    assert r.stats()["rounds"] < 60
    swap = Program("a : int -> (x : min int) -> rel. b : int -> (y : max int) -> rel. s : int -> rel. s 1. a X 0 :- s X. b X (0 - D) :- a X D. a X (0 - D - 1) :- b X D. c : int -> (z : min int) -> rel. c X 5 :- s X. c X (D / 2) :- c X D.")
    swap.types.rels["c"].terminates = True
    out = swap.evaluate(spark)
    assert out.extended("a").collect()[0].x == "-inf" and out.extended("b").collect()[0].y == "inf" and out.extended("c").collect()[0].z == "0"


def test_functors_check_their_parameters():
    from facteng.lib import graph

    base = "edge, big : string -> string -> rel. mixed : string -> int -> rel. road : string -> string -> string -> rel. loose : string -> string -> rel. %open loose. seed : int -> rel. "
    for code, use in (("E0204", (graph.tc, "absent")), ("E0204", (graph.tc, "mixed")), ("E0204", (graph.shortest, "road")), ("E0204", (graph.reach, "edge", "seed")), ("E0208", (graph.degrees, "loose"))):
        with pytest.raises(ProgramError) as e:
            Program(base).use(*use)
        assert e.value.code == code
    assert Program(base).use(graph.degrees, "edge").out_degree == "outdeg_edge"


def test_imports(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "paths.dl").write_text('%import "base". path X Y :- edge X Y. path X Z :- path X Y, edge Y Z.')
    (tmp_path / "lib" / "base.dl").write_text("edge, path : int -> int -> rel. edge 1 2. edge 2 3.")
    p = Program('%import "lib/paths". %import "lib/base.dl". far : int -> rel. far Y :- path 1 Y, not edge 1 Y.', str(tmp_path))
    assert p.evaluate(spark).render("far") == ["far 3."]
    with pytest.raises(ProgramError) as e:
        Program('%import "nothing".', str(tmp_path))
    assert e.value.code == "E0201"
