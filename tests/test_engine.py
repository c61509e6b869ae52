"""Programs against their known results: recursion, negation, aggregates, facts as values, bound columns, demand."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facteng import Program, V, atom, cmp, count_, not_
from facteng.lib import graph, lists, order
from facteng.rewrite.simplify import fold
from facteng.ast import Arith, Lit
from facteng.sources.proofs import export
from facteng.streaming.monotone import Incremental
from facteng.verify import verify


def run(spark, source, facts=""):
    p = Program(source)
    if facts:
        p.load_facts(facts)
    return p.evaluate(spark)


TC = "edge, path : string -> string -> rel. path X Y :- edge X Y. path X Z :- path X Y, edge Y Z. "


def test_closure_of_a_cycle_and_verification(spark):
    r = run(spark, TC + '%input edge. ?- path "a" X.', 'edge "a" "b". edge "b" "a". edge "b" "c".')
    assert r.answers() == ['X = "a".', 'X = "b".', 'X = "c".'] and r.relation("path").count() == 6
    assert verify(r) == []
    r.engine.states["path"].pieces = r.engine.states["path"].pieces[:1]
    assert verify(r) == ["path lacks facts that its rules derive"]


def test_random_closures_against_a_naive_one(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(12)}
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in edges if b == c}
        if more == want:
            break
        want = more
    for rule in ("path X Z :- path X Y, edge Y Z.", "path X Z :- path X Y, path Y Z.", "path X Z :- edge X Y, path Y Z."):
        p = Program("edge, path : int -> int -> rel. path X Y :- edge X Y. " + rule)
        p.load("edge", spark.createDataFrame(sorted(edges), "a int, b int"))
        assert {tuple(x) for x in p.evaluate(spark).relation("path").collect()} == want
    for n, m in ((9, 12), (40, 60), (30, 29), (5, 0)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} if m != 29 else {(k, k + 1) for k in range(29)}
        reached = {a: {b for x, b in edges if x == a} for a in range(n)}
        for _ in range(n):
            reached = {a: r | {c for b in r for c in reached.get(b, ())} for a, r in reached.items()}
        got = [tuple(r) for r in graph.closure(spark, spark.createDataFrame(sorted(edges), "a int, b int")).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, r in reached.items() for b in r}


def naive(rules, facts):
    """All facts that rules derive, by trying every combination of facts until nothing is new. A rule: head, body atoms and
    tests; an atom: relation and variable names."""
    known = {r: set(f) for r, f in facts.items()}

    def match(body, env):
        if not body:
            yield env
            return
        (rel, names), *rest = body
        for fact in list(known[rel]):
            new = dict(env)
            if all(new.setdefault(n, v) == v for n, v in zip(names, fact, strict=True)):
                yield from match(rest, new)

    while True:
        made = [(rel, tuple(env[n] for n in names)) for (rel, names), body, (a, op, b) in rules for env in match(body, {}) if {"<": env[a] < env[b], "<>": env[a] != env[b], "": True}[op]]
        if all(f in known[rel] for rel, f in made):
            return known
        for rel, f in made:
            known[rel].add(f)


@pytest.mark.parametrize("seed", range(6))
def test_random_programs_against_naive_evaluation(spark, seed):
    rng = random.Random(seed)
    base, derived = ["bus", "tram"], ["link", "loop", "hub"]
    facts = {r: {(rng.randrange(6), rng.randrange(6)) for _ in range(7)} for r in base} | {r: set() for r in derived}
    rules = []
    for head in derived:
        for _ in range(rng.randint(1, 2)):
            chain = [f"V{k}" for k in range(rng.randint(2, 4))]
            body = [(rng.choice(base if k == 0 else base + derived), rng.choice([(a, b), (b, a), (a, b)])) for k, (a, b) in enumerate(zip(chain, chain[1:], strict=False))]
            test = rng.choice([("V0", "", "V1"), ("V0", "<", chain[-1]), ("V0", "<>", chain[-1])])
            rules.append(((head, (rng.choice(chain), rng.choice(chain))), body, test))
    text = "bus, tram, link, loop, hub : int -> int -> rel. "
    for (head, names), body, (a, op, b) in rules:
        text += f"{head} {' '.join(names)} :- {', '.join(f'{r} {x} {y}' for r, (x, y) in body)}{f', {a} {op} {b}' if op else ''}. "
    p = Program(text)
    for r in base:
        p.load(r, spark.createDataFrame(sorted(facts[r]), "a int, b int"))
    got, want = p.evaluate(spark), naive(rules, facts)
    for r in derived:
        assert {tuple(x) for x in got.relation(r).collect()} == want[r], (text, r)
    assert set(got.outputs()) == set(derived) and verify(got) == []


def test_negation_and_aggregates_of_random_rows(spark):
    rng = random.Random(11)
    depots = [f"depot{k}" for k in range(7)]
    loads = {(rng.choice(depots[:5]), f"crate{rng.randrange(9)}", rng.randint(-40, 40)) for _ in range(25)}
    temps = {(rng.choice(depots), round(rng.uniform(-5, 5), 2)) for _ in range(12)}
    p = Program("""load : string -> string -> int -> rel. temp : string -> float -> rel. depot : string -> rel.
        idle, crowded, light : string -> rel. weight, kinds : string -> int -> rel. warmest : string -> float -> rel. odd, excess : string -> int -> rel. whole : int -> int -> rel.
        idle D :- depot D, not load D _ _. weight D W :- depot D, W = sum { K | load D _ K }. kinds D N :- depot D, N = count { C | load D C _ }.
        crowded D :- kinds D N, N > 4. light C :- load _ C _, C = min { X | load _ X _ }. warmest D T :- depot D, T = max { U | temp D U }.
        odd D W :- depot D, W = sum { 60 / (K - 3) | load D _ K }. excess D W :- depot D, W = sum { 9223372036854775807 | load D _ _ }.
        whole A B :- A = count { D | crowded D }, B = sum { W | weight _ W }.""")
    p.load("load", spark.createDataFrame(sorted(loads), "d string, c string, k int"))
    p.load("temp", spark.createDataFrame(sorted(temps), "d string, t double"))
    p.load("depot", spark.createDataFrame([(d,) for d in depots], "d string"))
    r = p.evaluate(spark)
    got = lambda name: {tuple(x) for x in r.relation(name).collect()}
    of = {d: [x for x in loads if x[0] == d] for d in depots}
    weight = {d: sum(k for *_, k in of[d]) for d in depots}
    assert got("weight") == set(weight.items()) and got("idle") == {(d,) for d in depots if not of[d]}
    kinds = {d: len(of[d]) for d in depots}  # valuations are counted, of the crate and of what isn't named
    assert got("kinds") == set(kinds.items())
    assert got("crowded") == {(d,) for d in depots if kinds[d] > 4} and got("light") == {(min(c for _, c, _ in loads),)}
    assert got("warmest") == {(d, max(t for x, t in temps if x == d)) for d in {x for x, _ in temps}}
    trunc = lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    assert got("odd") == {(d, sum(trunc(60, k - 3) for *_, k in of[d])) for d in depots if all(k != 3 for *_, k in of[d])}
    assert got("excess") == {(d, 9223372036854775807 * len(of[d])) for d in depots if len(of[d]) <= 1}
    assert got("whole") == {(len(got("crowded")), sum(weight.values()))}


def test_random_terms_are_values(spark):
    rng = random.Random(4)

    def grow(depth):
        return rng.randint(-9, 9) if depth == 0 or rng.random() < 0.3 else (rng.choice(["glue", "stack"]), grow(depth - 1), grow(depth - 1))

    text = lambda t: f"(plank {t if t >= 0 else f'({t})'})" if isinstance(t, int) else f"({t[0]} {text(t[1])} {text(t[2])})"
    high = lambda t: 1 if isinstance(t, int) else (high(t[1]) + high(t[2]) if t[0] == "stack" else max(high(t[1]), high(t[2])))
    parts = lambda t: {text(t)} | (set() if isinstance(t, int) else parts(t[1]) | parts(t[2]))
    made = [grow(3) for _ in range(5)]
    r = run(spark, """wood : type. plank : int -> wood. glue, stack : wood -> wood -> wood. built : wood -> rel. high : wood -> int -> rel.
        high (plank N) 1 :- plank N. high (stack A B) (X + Y) :- stack A B, high A X, high B Y. high (glue A B) X :- glue A B, high A X, high B Y, X >= Y.
        high (glue A B) Y :- glue A B, high A X, high B Y, X < Y. ?- built T, high T N. ?- X = plank 77.
        nail : int -> wood. firm : wood -> rel. firm X :- plank N, X = nail N. nail 2. alike : int -> rel. alike 1 :- plank N, plank N = plank N. alike 2 :- nail 8 = nail 9.""",
        " ".join(f"built {text(t)}." for t in made) + " built (plank 2).")
    want = {f"T = {text(t)[1:-1]}, N = {high(t)}." for t in [*made, 2]}
    assert set(r.answers(0)) == want and r.answers(1) == ["no."]
    assert r.render("firm") == ["firm (nail 2)."] and r.render("alike") == ["alike 1."]
    assert len(r.render("high")) == len(set().union(*map(parts, [*made, 2])))


def test_recursive_existence_check(spark):
    r = run(spark, """t : type. at : int -> t. step : int -> int -> rel. step 1 2. step 2 3. step 5 6. seen : t -> rel. %terminates seen. %terminates at.
        at 1. seen X :- X = at 1. at B, seen (at B) :- step A B, X = at A, seen X.""")
    assert r.render("seen") == ["seen (at 1).", "seen (at 2).", "seen (at 3)."]


def test_records_refinements_and_downcasts(spark):
    rng = random.Random(8)
    buoys = [(rng.randint(0, 9), rng.randint(0, 9), f"b{k}") for k in range(6)]
    ships = [(rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 50)) for _ in range(6)]
    p = Program("""spot : type = { east : int, north : int }. buoy : type = { at : spot, tag : string }. ship : type = { at : spot, crew : int }. craft : type = buoy | ship.
        b : int -> int -> string -> rel. s : int -> int -> int -> rel. seen, towed : craft -> rel. seen (buoy (spot E N) T) :- b E N T. seen (ship (spot E N) C) :- s E N C.
        place : int -> int -> rel. place E N :- seen X, E = X.at.east, N = X.at.north. towed (X with { at = (spot 0 1) }) :- seen X. tags : string -> rel. tags T :- buoy { tag = T, .. }.
        crews, many : int -> rel. crews C :- seen (X : ship), X = ship _ C. size <: int. berth : size -> rel. berth 3. fits : int -> rel. fits N :- berth B, N = B + 1. many C :- crews C, C > 20.
        harbour : int -> rel. harbour N :- N = count { X | towed X }.""")
    p.load("b", spark.createDataFrame(buoys, "e int, n int, t string"))
    p.load("s", spark.createDataFrame(ships, "e int, n int, c int"))
    r = p.evaluate(spark)
    got = lambda name: {tuple(x) for x in r.relation(name).collect()}
    assert got("place") == {(e, n) for e, n, _ in buoys + ships} and got("crews") == {(c,) for *_, c in ships} and got("many") == {(c,) for *_, c in ships if c > 20}
    assert {t for _, _, t in buoys} == {t for (t,) in got("tags")} and r.render("fits") == ["fits 4."]
    assert set(r.render("towed")) == {f'towed (buoy (spot 0 1) "{t}").' for *_, t in buoys} | {f"towed (ship (spot 0 1) {c})." for *_, c in ships}
    assert got("harbour") == {(len({t for *_, t in buoys}) + len({c for *_, c in ships}),)}


def test_bound_columns_and_divergence(spark):
    r = run(spark, """cheap : string -> (c : min int) -> rel. cost : string -> int -> rel. part : string -> string -> int -> rel.
        cost "w" 3. cost "w" 5. cost "f" 9. part "bike" "w" 2. cheap I C :- cost I C. cheap W (C * N) :- part W P N, N > 0, cheap P C.
        e : string -> string -> int -> rel. d : string -> (m : max int) -> rel. d "s" 0. d Y (D + W) :- d X D, e X Y W.
        e "s" "a" 1. e "a" "b" 3. e "b" "a" (-2). e "s" "z" 5. later : string -> int -> rel. later X (D + 1) :- d X D.""")
    assert r.render("cheap") == ['cheap "bike" 6.', 'cheap "f" 9.', 'cheap "w" 3.']
    assert r.render("d") == ['d "a" inf.', 'd "b" inf.', 'd "s" 0.', 'd "z" 5.'] and r.render("later") == ['later "s" 1.', 'later "z" 6.']


def test_disjunction_multiple_heads_and_repeated_variables(spark):
    r = run(spark, """n : int -> rel. n 1. n 2. n 3. n 4. n 5. n 6. a, b, c, k : int -> rel. a X, b X :- n X, X > 4. c X :- n X, (X < 2 ; Y = X / 2, X = Y * 2).
        k N :- N = count { X | n X, (X < 2 ; X > 5) }. e : int -> int -> rel. e 1 1. e 1 2. l : int -> rel. l X :- e X X. next : int -> rel. next X :- n X, n (X + 1).""")
    assert r.render("a") == ["a 5.", "a 6."] and r.render("b") == ["b 5.", "b 6."] and r.render("c") == ["c 1.", "c 2.", "c 4.", "c 6."]
    assert r.render("k") == ["k 2."] and r.render("l") == ["l 1."] and len(r.render("next")) == 5


def test_demand_gives_the_same_answers(spark):
    text = 'edge "a" "b". edge "b" "c". edge "x" "y". ?- path "a" Y.'
    plain = "edge, path : string -> string -> rel. path X Y :- edge X Y. path X Z :- edge X Y, path Y Z. " + text
    asked = plain.replace(". path X Y :-", ". %demand path + -. path X Y :-", 1)
    a, b = run(spark, plain), run(spark, asked)
    assert a.answers() == b.answers() == ['Y = "b".', 'Y = "c".'] and b.relation("path").count() == 3 < a.relation("path").count()


def test_undefined_arithmetic_never_fires(spark):
    r = run(spark, "n : int -> rel. n 0. n 7. n (-7). q : int -> int -> rel. q X (7 / X) :- n X. h : int -> rel. h (X / 2) :- n X. o : int -> rel. o (X * 9223372036854775807) :- n X. f : float -> rel. f (1.0 / 0.0).")
    assert r.render("q") == ["q (-7) (-1).", "q 7 1."] and r.render("h") == ["h (-3).", "h 0.", "h 3."] and r.render("o") == ["o 0."] and r.render("f") == []
    assert fold(Arith("/", Lit(-7), Lit(2))) == Lit(-3)


def test_python_builders(spark):
    p = Program()
    p.relation("edge", ("a", "int"), ("b", "int"))
    p.relation("deg", ("a", "int"), ("n", "int"))
    p.relation("end", ("a", "int"))
    X, Y, N = V("X Y N")  # noqa: N806
    p.fact("edge", 1, 2)
    p.fact("edge", 1, 3)
    p.rule(atom("deg", X, N), atom("edge", X, V("_")), count_(N, Y, atom("edge", X, Y)), cmp(">", N, 1))
    p.rule(atom("end", Y), atom("edge", X, Y), not_(atom("edge", Y, V("_"))))
    r = p.evaluate(spark)
    assert r.render("deg") == ["deg 1 2."] and r.render("end") == ["end 2.", "end 3."]


def test_derivations_and_proofs(spark):
    r = run(spark, "edge, path : int -> int -> rel. edge 1 2. edge 2 3. edge 3 4. %derivations path. @one path X Y :- edge X Y. @more path X Z :- path X Y, edge Y Z. top : int -> rel. top X :- edge X _, not edge _ X.")
    got = {(d.fact, d.rule, tuple(d.premises)) for d in r.derivations("path").collect()}
    assert ("path 1 3", "more", ("path 1 2", "edge 2 3")) in got and len(got) == 6
    tree = next(t for t in json.loads(export(r)) if t["fact"] == "path 1 4")
    assert tree["rule"] == "more" and tree["premises"][0]["fact"] == "path 1 3" and tree["premises"][1] == {"fact": "edge 3 4"}
    nodes = json.loads(export(r, ["top 1"], "ordered-graph"))
    assert nodes[-1]["fact"] == "top 1" and all(p < n["id"] for n in nodes for p in n.get("premises", []))


def test_reuse_and_growth(spark):
    p = Program("edge, path : int -> int -> rel. edge 1 2. path X Y :- edge X Y. path X Z :- path X Y, edge Y Z. ")
    a = p.evaluate(spark)
    p.read("big : int -> rel. big X :- path X Y, Y > 1.")
    b = p.evaluate(spark, reuse=a)
    assert b.stats()["reused components"] >= 2 and b.render("big") == ["big 1."]
    inc = Incremental(Program("edge, path : int -> int -> rel. edge 1 2. path X Y :- edge X Y. path X Z :- path X Y, edge Y Z."), spark)
    assert inc.add("edge", spark.createDataFrame([(2, 3), (1, 2)], "a long, b long")) == 1
    assert inc.add("edge", spark.createDataFrame([(2, 3)], "a long, b long")) == 0
    assert inc.result.relation("path").count() == 3


def test_structured_streaming(spark, tmp_path):
    inc = Incremental(Program("edge, path : int -> int -> rel. path X Y :- edge X Y. path X Z :- path X Y, path Y Z."), spark)
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(f"{tmp_path}/in/1")
    source = spark.readStream.schema("a long, b long").parquet(f"{tmp_path}/in/*")
    q = inc.stream("edge", source, f"{tmp_path}/ck")
    q.processAllAvailable()
    spark.createDataFrame([(3, 4)], "a long, b long").write.parquet(f"{tmp_path}/in/2")
    q.processAllAvailable()
    q.stop()
    assert inc.result.relation("path").count() == 6


def test_lists(spark):
    p = Program()
    m = p.use(lists.family, "int")
    assert p.use(lists.family, "int") is m
    p.read(f"mine : {m.type} -> rel. n : int -> rel. n N :- mine L, {m.len} L N. x : int -> rel. x X :- mine L, {m.member} L X.")
    p.fact("mine", lists.lift([4, 4, 5]))
    r = p.evaluate(spark)
    assert r.render("n") == ["n 3."] and r.render("x") == ["x 4.", "x 5."]


def test_order_library(spark):
    s = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("a", "z", 1), ("b", "x", -2)], "k string, i string, s long")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(order.argmax(s)) == [("a", "x"), ("a", "y"), ("b", "x")] and got(order.argmin(s)) == [("a", "z"), ("b", "x")]
    assert got(order.rank(s)) == [("a", "x", 1), ("a", "y", 1), ("a", "z", 3), ("b", "x", 1)] and got(order.top(s, 2)) == [("a", "x"), ("a", "y"), ("b", "x")]
    n = spark.createDataFrame([(5,), (-1,), (5,), (9,), (None,)], "x long")
    assert got(order.next_(n)) == [(-1, 5), (5, 9)] and got(order.position(n)) == [(-1, 0), (5, 1), (9, 2)] and got(order.first(n)) == [(-1,)]
    assert got(order.first(n.limit(0))) == got(order.next_(n.limit(0))) == got(order.position(n.limit(0))) == []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:  # bounds of ranges are sampled for every shuffle, so each must be made once
        wide = spark.range(200_000).select(((F.xxhash64("id") % 10**9) * 2).alias("x")).distinct().repartition(16)
        n = wide.count()
        assert order.position(wide).agg(F.min("position"), F.max("position"), F.countDistinct("position")).first() == (0, n - 1, n)
        assert order.next_(wide).agg(F.count("x"), F.sum((F.col("next") <= F.col("x")).cast("int"))).first() == (n - 1, 0)
        one = wide.select(F.lit("k").alias("k"), F.col("x").alias("i"), F.floor(F.col("x") / 1000).alias("s"))
        mine, slow = order.rank(one), one.select(F.col("i").alias("item"), F.rank().over(Window.orderBy(F.desc("s"))).cast("long").alias("want"))
        assert mine.join(slow, "item").where("rank = want").count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.exchange.reuse")
    many = spark.range(1000).selectExpr("1000 - id AS x")
    assert got(order.next_(many)) == [(k, k + 1) for k in range(1, 1000)]


@pytest.mark.parametrize(
    "code,source",
    [
        ("E0601", "win : int -> rel. move : int -> int -> rel. win X :- move X Y, not win Y."),
        ("E0602", "p, q : int -> rel. %open p. q X :- p X, not p X."),
        ("E0603", "n : int -> rel. n 0. n (X + 1) :- n X."),
        ("E0606", "d : int -> (m : min int) -> rel. d 1 0. d X (0 - D) :- d X D."),
        ("E0605", "d : (m : min int) -> int -> rel."),
        ("E0501", "p, q : int -> rel. q Y :- p X."),
        ("E0401", "p : int -> rel. s : string -> rel. q : int -> rel. q 1 :- p X, s X."),
        ("E0402", 'p : int -> rel. p "x".'),
        ("E0404", "p : nothing -> rel."),
        ("E0701", "p : int -> rel. %frobnicate p."),
        ("E0002", "p : int -> rel. p :- ."),
        ("E0001", "p : int -> rel. p 1 ~."),
    ],
)
def test_programs_that_are_refused(code, source):
    with pytest.raises(Exception) as e:
        Program(source).checked()
    assert e.value.code == code


def test_bad_inputs(spark):
    p = Program("p : int -> string -> rel. %input p.")
    for facts in ("q 1.", "p 1.", 'p "a" "b".', "p X \"a\"."):
        with pytest.raises(Exception) as e:
            p.load_facts(facts)
        assert e.value.code == "E0801"
    with pytest.raises(Exception) as e:
        p.load("p", spark.createDataFrame([("x", "y")], "a string, b string"))
    assert e.value.code == "E0801"


def test_guarded_recursion_and_warnings():
    Program("n : int -> rel. n 0. n (X + 2) :- n X, X < 10.").checked()
    warned = [w.code for w in Program("t : type. yes : t. p : int -> rel. q : int -> rel. q 1 :- p X. q 2 :- yes. q (1 / 0) :- p 1.").checked()[2]]
    assert warned == ["W0002", "W0008", "W0001"]
