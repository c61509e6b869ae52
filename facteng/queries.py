"""The catalogue of queries over the sample tables, one for each operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lib import graph, lists, order
from .program import Program

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Tables with a key among the columns that are loaded, so no row repeats.
KEYED = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem"}
#: Relations over the sample tables: (columns of the table, declaration).
SOURCES = {
    "region": ("region", ["r_regionkey", "r_name"], "(key : int) -> (name : string)"),
    "nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"], "(key : int) -> (name : string) -> (region : int)"),
    "customer": ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"], "(key : int) -> (nation : int) -> (segment : string)"),
    "supplier": ("supplier", ["s_suppkey", "s_nationkey"], "(key : int) -> (nation : int)"),
    "part": ("part", ["p_partkey", "p_name", "p_brand", "p_size"], "(key : int) -> (name : string) -> (brand : string) -> (size : int)"),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], "(key : int) -> (customer : int) -> (price : float) -> (priority : string)"),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "(order : int) -> (line : int) -> (part : int) -> (supplier : int) -> (quantity : float)"),
    "events": ("events", ["event_id", "user_id", "event_type", "value"], "(id : int) -> (user : int) -> (type : string) -> (value : float)"),
    "document": ("documents", ["doc_id", "lang", "source"], "(id : int) -> (lang : string) -> (source : string)"),
    "doc": ("documents", ["doc_id", "lang"], "(id : int) -> (lang : string)"),
    "label": ("labels", ["doc_id", "quality", "toxic"], "(doc : int) -> (quality : int) -> (toxic : int)"),
    "turn": ("conversations", ["conv_id", "turn"], "(conv : int) -> (turn : int)"),
}


def program(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> Program:
    """A program with the relations of SOURCES that its text mentions; keys make their rows distinct."""
    p = Program()
    for name, (table, cols, decl) in SOURCES.items():
        if name in text.replace("(", " ").replace(",", " ").split():
            p.read(f"{name} : {decl} -> rel.")
            p.load(name, spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols), unique=table in KEYED)
    for name, df in frames.items():
        decl = " -> ".join(f"({c} : {'string' if t == 'string' else 'float' if t == 'double' else 'int'})" for c, t in df.dtypes)
        p.read(f"{name} : {decl} -> rel.")
        p.load(name, df)
    p.read(text)
    return p


def rules(name: str, out: str, text: str, sql: str) -> None:
    """Registers a program over the tables whose result is a relation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return program(spark, sf_dir, text).evaluate(spark).relation(out)

    QUERIES[name], SQL[name] = run, sql


def frame(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Scans, selections, projections, scalar functions

rules("scan_filter", "big", "big : (key : int) -> (name : string) -> rel. big K N :- part K N _ S, S > 40.", "SELECT p_partkey AS key, p_name AS name FROM part WHERE p_size > 40")
rules("constant_selection", "building", 'building : (key : int) -> rel. building K :- customer K _ "BUILDING".', "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
rules("repeated_variable", "same", "pair : int -> int -> rel. pair K R :- nation K _ R. same : (key : int) -> rel. same X :- pair X X.", "SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation WHERE n_nationkey = n_regionkey")
rules("computed_argument", "after", "after : (a : int) -> (b : int) -> rel. after A B :- nation A _ _, nation B _ _, nation (A + 1) _ _, B = A + 1.", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
rules("project_arith", "made", "made : (key : int) -> (a : int) -> (b : int) -> rel. made K (S * 2 + K) (K - S) :- part K _ _ S.", "SELECT p_partkey AS key, CAST(p_size * 2 + p_partkey AS BIGINT) AS a, CAST(p_partkey - p_size AS BIGINT) AS b FROM part")
rules("wildcard_distinct", "brand", "brand : (brand : string) -> rel. brand B :- part _ _ B _.", "SELECT DISTINCT p_brand AS brand FROM part")
rules("int_div_trunc", "q", "q : (key : int) -> (q : int) -> rel. q K (V / 7) :- part K _ _ S, V = 20 - S.", "SELECT p_partkey AS key, CAST((20 - p_size) // 7 AS BIGINT) AS q FROM part")
rules("undefined_drop", "q", "q : (key : int) -> (q : int) -> rel. q K (100 / D) :- part K _ _ S, D = S - 10.", "SELECT p_partkey AS key, CAST(100 // nullif(p_size - 10, 0) AS BIGINT) AS q FROM part WHERE p_size <> 10")
rules("overflow_drop", "q", "q : (key : int) -> (q : int) -> rel. q K (S * 300000000000000000) :- part K _ _ S.", "SELECT p_partkey AS key, CAST(p_size AS BIGINT) * 300000000000000000 AS q FROM part WHERE CAST(p_size AS HUGEINT) * 300000000000000000 <= 9223372036854775807")
rules("float_arith", "q", "q : (key : int) -> (half : float) -> rel. q K (P / 2.0 - 1.0) :- orders K _ P _.", "SELECT o_orderkey AS key, o_totalprice / 2.0 - 1.0 AS half FROM orders")
rules("concat_str", "q", 'q : (key : int) -> (s : string) -> rel. q K (B ^ "/" ^ N) :- part K N B _.', "SELECT p_partkey AS key, p_brand || '/' || p_name AS s FROM part")
rules("compare_str", "q", "q : (a : string) -> (b : string) -> rel. q A B :- region _ A, region _ B, A < B.", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
rules("named_pattern", "q", "q : (key : int) -> (name : string) -> rel. q K N :- nation { key = K, name = N, region = 2, .. }.", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation WHERE n_regionkey = 2")
rules("binding_equation", "q", "q : (key : int) -> (v : int) -> rel. q K V :- supplier K N, V = N * 10 + 1.", "SELECT s_suppkey AS key, CAST(s_nationkey AS BIGINT) * 10 + 1 AS v FROM supplier")

# Joins

rules("join_equi", "q", "q : (supplier : int) -> (nation : string) -> rel. q S N :- supplier S K, nation K N _.", "SELECT s_suppkey AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
rules("join_multi", "q", "q : (customer : int) -> (region : string) -> (price : float) -> rel. q C R P :- orders _ C P _, customer C N _, nation N _ K, region K R, P > 300000.0.", "SELECT DISTINCT c_custkey AS customer, r_name AS region, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000")
rules("join_big", "q", "q : (customer : int) -> (supplier : int) -> rel. q C S :- lineitem O _ _ S _, orders O C P _, P > 250000.0.", "SELECT DISTINCT o_custkey AS customer, l_suppkey AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 250000")
rules("join_theta", "q", "q : (a : int) -> (b : int) -> rel. q A B :- nation A _ R, nation B _ S, R < S.", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey")
rules("join_self", "q", "q : (a : int) -> (b : int) -> rel. q A B :- supplier A N, supplier B N, A < B.", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
rules("join_cross", "q", "q : (r : string) -> (n : string) -> rel. q R N :- region _ R, nation _ N _.", "SELECT r_name AS r, n_name AS n FROM region, nation")
rules("semi", "q", 'q : (customer : int) -> rel. q C :- customer C _ _, orders _ C _ "1-URGENT".', "SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
rules("anti", "q", "q : (key : int) -> rel. q O :- orders O _ _ _, not lineitem O _ _ _ _.", "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
rules("anti_documents", "q", "q : (id : int) -> (lang : string) -> rel. q D L :- doc D L, not label D _ _.", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
rules("anti_global", "q", "q : (key : int) -> rel. q K :- region K _, not nation 99 _ _.", "SELECT CAST(r_regionkey AS BIGINT) AS key FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)")
rules("anti_computed", "q", "q : (key : int) -> rel. q K :- nation K _ _, not nation (K + 1) _ _.", "SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation WHERE n_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)")

# Set operations

rules("union_rules", "q", "q : (nation : int) -> rel. q N :- supplier _ N. q N :- customer _ N _.", "SELECT CAST(s_nationkey AS BIGINT) AS nation FROM supplier UNION SELECT CAST(c_nationkey AS BIGINT) FROM customer")
rules("intersect", "q", 's, c, q : (nation : int) -> rel. s N :- supplier _ N. c N :- customer _ N "BUILDING". q N :- s N, c N.', "SELECT CAST(s_nationkey AS BIGINT) AS nation FROM supplier INTERSECT SELECT CAST(c_nationkey AS BIGINT) FROM customer WHERE c_mktsegment = 'BUILDING'")
rules("except", "q", 'q : (customer : int) -> rel. q C :- customer C _ _, not orders _ C _ "1-URGENT".', "SELECT c_custkey AS customer FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
rules("disjunction", "q", "q : (key : int) -> rel. q K :- part K _ _ S, (S < 5 ; S > 45, K > 10).", "SELECT p_partkey AS key FROM part WHERE p_size < 5 OR (p_size > 45 AND p_partkey > 10)")
rules("multi_head", "q", "big, q : (key : int) -> rel. big K, q K :- part K _ _ S, S > 25.", "SELECT p_partkey AS key FROM part WHERE p_size > 25")

# Aggregates

rules("count_zero", "q", "q : (customer : int) -> (n : int) -> rel. q C N :- customer C _ _, N = count { O | orders O C P _, P > 450000.0 }.", "SELECT c_custkey AS customer, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY c_custkey")
rules("sum_group", "q", "q : (brand : string) -> (total : int) -> rel. b : string -> rel. b B :- part _ _ B _. q B T :- b B, T = sum { S | part _ _ B S }.", "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
rules("min_str", "q", "q : (nation : int) -> (least : string) -> rel. q N M :- nation N _ _, M = min { S | customer _ N S }.", "SELECT CAST(c_nationkey AS BIGINT) AS nation, min(c_mktsegment) AS least FROM customer GROUP BY c_nationkey")
rules("max_float", "q", "q : (customer : int) -> (most : float) -> rel. q C M :- customer C _ _, M = max { P | orders _ C P _ }.", "SELECT o_custkey AS customer, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
rules("agg_test", "q", "q : (nation : int) -> rel. q N :- nation N _ _, 4 = count { S | supplier S N }.", "SELECT CAST(s_nationkey AS BIGINT) AS nation FROM supplier GROUP BY s_nationkey HAVING count(*) = 4")
rules("agg_global", "q", "q : (n : int) -> (most : int) -> rel. q N M :- N = count { K | part K _ _ _ }, M = max { S | part _ _ _ S }.", "SELECT count(*) AS n, CAST(max(p_size) AS BIGINT) AS most FROM part")
rules("agg_arith", "q", "q : (brand : string) -> (t : int) -> rel. b : string -> rel. b B :- part _ _ B _. q B T :- b B, T = sum { 100 / (S - 10) | part _ _ B S }.", "SELECT p_brand AS brand, CAST(sum(100 // nullif(p_size - 10, 0)) AS BIGINT) AS t FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size = 10) = 0")
rules("agg_disjunction", "q", "q : (nation : int) -> (n : int) -> rel. q N C :- nation N _ _, C = count { K | (supplier K N ; customer K N _) }.", "SELECT CAST(n_nationkey AS BIGINT) AS nation, count(k) AS n FROM nation LEFT JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier UNION SELECT c_custkey, c_nationkey FROM customer) ON n = n_nationkey GROUP BY n_nationkey")
rules("agg_nested", "q", "q : (region : int) -> (most : int) -> rel. q R M :- region R _, M = max { C | nation N _ R, C = count { S | supplier S N } }.", "SELECT CAST(n_regionkey AS BIGINT) AS region, max(c) AS most FROM (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
rules("agg_big", "q", "q : (supplier : int) -> (n : int) -> rel. q S N :- supplier S _, N = count { L | lineitem O L _ S Q, Q > 25.0 }.", "SELECT s_suppkey AS supplier, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 25 GROUP BY s_suppkey")

# Ranking and order


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.floor("value").cast("long").alias("v")).dropna()


_EV = "(SELECT DISTINCT user_id AS key, event_type AS item, CAST(floor(value) AS BIGINT) AS score FROM events WHERE value IS NOT NULL)"


@frame("argmin", f"SELECT key, item FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY score) AS r FROM {_EV}) WHERE r = 1")
def _argmin(spark, d):
    return order.argmin(_scores(spark, d)).distinct()


@frame("argmax", f"SELECT DISTINCT key, item FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY score DESC) AS r FROM {_EV}) WHERE r = 1")
def _argmax(spark, d):
    return order.argmax(_scores(spark, d)).distinct()


SQL["argmin"] = SQL["argmin"].replace("SELECT key", "SELECT DISTINCT key", 1)


@frame("rank", f"SELECT key, item, rank() OVER (PARTITION BY key ORDER BY score DESC) AS rank FROM {_EV}")
def _rank(spark, d):
    return order.rank(_scores(spark, d))


@frame("top3", f"SELECT DISTINCT key, item FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY score DESC) AS r FROM {_EV}) WHERE r <= 3")
def _top(spark, d):
    return order.top(_scores(spark, d), 3).distinct()


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("value") * 10).cast("long").alias("x"))


_NUM = "(SELECT DISTINCT CAST(floor(value * 10) AS BIGINT) AS x FROM events WHERE value IS NOT NULL)"


@frame("order_next", f"SELECT x, n AS next FROM (SELECT x, lead(x) OVER (ORDER BY x) AS n FROM {_NUM}) WHERE n IS NOT NULL")
def _next(spark, d):
    return order.next_(_numbers(spark, d))


@frame("order_first", f"SELECT min(x) AS x FROM {_NUM}")
def _first(spark, d):
    return order.first(_numbers(spark, d))


@frame("order_position", f"SELECT x, row_number() OVER (ORDER BY x) - 1 AS position FROM {_NUM}")
def _position(spark, d):
    return order.position(_numbers(spark, d))


rules("rank_by_rule", "q", "q : (part : int) -> (rank : int) -> rel. q K R :- part K _ B S, N = count { J | part J _ B T, T > S }, R = N + 1.", "SELECT p_partkey AS part, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part")

# Graphs: suppliers, each with an edge to (3 s + 1) mod 100

EDGE = "edge : (src : int) -> (dst : int) -> rel. edge S T :- supplier S _, X = 3 * S + 1, T = X - X / 100 * 100. "
_E = "e AS (SELECT s_suppkey AS src, (3 * s_suppkey + 1) % 100 AS dst FROM supplier)"
_TC = f"WITH RECURSIVE {_E}, p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"
_VX = "v AS (SELECT src AS x FROM e UNION SELECT dst FROM e)"


def functor(name: str, make: Callable, out: Callable, cols: list[str], sql: str, text: str = EDGE) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = program(spark, sf_dir, text)
        rel = out(make(p))
        return p.evaluate(spark).relation(rel, labels=False).toDF(*cols)

    QUERIES[name], SQL[name] = run, sql


functor("reverse", lambda p: p.use(graph.reverse, "edge"), lambda m: m.edge, ["src", "dst"], f"WITH {_E} SELECT dst AS src, src AS dst FROM e")
functor("undirected", lambda p: p.use(graph.undirected, "edge"), lambda m: m.edge, ["src", "dst"], f"WITH {_E} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
functor("vertices", lambda p: p.use(graph.vertices, "edge"), lambda m: m.vertex, ["x"], f"WITH {_E}, {_VX} SELECT x FROM v")
functor("tc", lambda p: p.use(graph.tc, "edge"), lambda m: m.path, ["src", "dst"], f"{_TC} SELECT src, dst FROM p")
functor("rtc", lambda p: p.use(graph.rtc, "edge"), lambda m: m.path, ["src", "dst"], f"{_TC}, {_VX} SELECT src, dst FROM p UNION SELECT x, x FROM v")
functor("scc", lambda p: p.use(graph.scc, "edge"), lambda m: m.same, ["a", "b"], f"{_TC}, {_VX}, r AS (SELECT src, dst FROM p UNION SELECT x, x FROM v) SELECT a.src AS a, a.dst AS b FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src")
functor("reach", lambda p: p.use(graph.reach, "edge", "seed"), lambda m: m.reached, ["x"], f"WITH RECURSIVE {_E}, r AS (SELECT 7 AS x UNION SELECT e.dst FROM r JOIN e ON e.src = r.x) SELECT CAST(x AS BIGINT) AS x FROM r", EDGE + "seed : int -> rel. seed 7. ")
functor("out_degree", lambda p: p.use(graph.degrees, "edge"), lambda m: m.out_degree, ["x", "n"], f"WITH {_E}, {_VX} SELECT x, count(DISTINCT dst) AS n FROM v LEFT JOIN e ON src = x GROUP BY x")
functor("in_degree", lambda p: p.use(graph.degrees, "edge"), lambda m: m.in_degree, ["x", "n"], f"WITH {_E}, {_VX} SELECT x, count(DISTINCT src) AS n FROM v LEFT JOIN e ON dst = x GROUP BY x")
HALF = "edge : (src : int) -> (dst : int) -> rel. edge S T :- supplier S _, T = S / 2, S > 3. "
_H = "e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 3)"
functor("sources", lambda p: p.use(graph.degrees, "edge"), lambda m: m.source, ["x"], f"WITH {_H} SELECT src AS x FROM e EXCEPT SELECT dst FROM e", HALF)
functor("sinks", lambda p: p.use(graph.degrees, "edge"), lambda m: m.sink, ["x"], f"WITH {_H} SELECT dst AS x FROM e EXCEPT SELECT src FROM e", HALF)
functor("bounded", lambda p: p.use(graph.bounded, "edge", 3), lambda m: m.hop, ["src", "dst", "n"], f"WITH RECURSIVE {_E}, b AS (SELECT src, dst, 1 AS n FROM e UNION SELECT b.src, e.dst, n + 1 FROM b JOIN e ON b.dst = e.src WHERE n < 3) SELECT src, dst, CAST(n AS BIGINT) AS n FROM b")
functor("hops", lambda p: p.use(graph.hops, "edge"), lambda m: m.dist, ["src", "dst", "d"], f"WITH RECURSIVE {_E}, b AS (SELECT src, dst, 1 AS n FROM e UNION SELECT b.src, e.dst, n + 1 FROM b JOIN e ON b.dst = e.src WHERE n < 100) SELECT src, dst, CAST(min(n) AS BIGINT) AS d FROM b GROUP BY src, dst")
_WEDGE = "wedge : int -> int -> int -> rel. wedge S T W :- supplier S W, X = 3 * S + 1, T = X - X / 100 * 100. "
functor("shortest", lambda p: p.use(graph.shortest, "wedge"), lambda m: m.dist, ["src", "dst", "d"], "WITH RECURSIVE e AS (SELECT s_suppkey AS src, (3 * s_suppkey + 1) % 100 AS dst, s_nationkey AS w FROM supplier), b AS (SELECT src, dst, w, 1 AS n FROM e UNION SELECT b.src, e.dst, b.w + e.w, n + 1 FROM b JOIN e ON b.dst = e.src WHERE n < 100) SELECT src, dst, CAST(min(w) AS BIGINT) AS d FROM b GROUP BY src, dst", _WEDGE)


@frame("closure_squaring", f"{_TC} SELECT src, dst FROM p")
def _closure(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return graph.closure(spark, s.select("s_suppkey", ((3 * F.col("s_suppkey") + 1) % 100).alias("t")))


# Recursion: mutual, bound columns, divergence, demand

rules("mutual_recursion", "even", EDGE + "even, odd : (src : int) -> (dst : int) -> rel. odd X Y :- edge X Y. odd X Z :- even X Y, edge Y Z. even X Z :- odd X Y, edge Y Z.", f"WITH RECURSIVE {_E}, w AS (SELECT src, dst, 1 AS k FROM e UNION SELECT w.src, e.dst, 1 - k FROM w JOIN e ON w.dst = e.src) SELECT src, dst FROM w WHERE k = 0")
rules("bound_max", "q", "q : (brand : string) -> (size : max int) -> rel. q B S :- part _ _ B S.", "SELECT p_brand AS brand, CAST(max(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand")
rules("bound_mutual", "hi", "lo : (n : int) -> (v : min int) -> rel. hi : (n : int) -> (v : max int) -> rel. lo N K :- supplier K N. hi N (0 - V) :- lo N V.", "SELECT CAST(s_nationkey AS BIGINT) AS n, -min(s_suppkey) AS v FROM supplier GROUP BY s_nationkey")


@frame("diverge_inf", "SELECT * FROM (VALUES ('a', '-inf'), ('b', '-inf'), ('s', '0'), ('t', '-inf'), ('z', '5')) x(node, d)")
def _diverge(spark, d):
    p = Program("""e : string -> string -> int -> rel. dist : (node : string) -> (d : min int) -> rel. dist "s" 0. dist Y (D + W) :- dist X D, e X Y W.
        e "s" "a" 1. e "a" "b" (-3). e "b" "a" 2. e "s" "z" 5. e "b" "t" 7.""")
    return p.evaluate(spark).extended("dist")


_DEMAND = EDGE + "path : (src : int) -> (dst : int) -> rel. %demand path + -. path X Y :- edge X Y. path X Z :- edge X Y, path Y Z. ?- path 5 Y."


@frame("demand_reach", f"WITH RECURSIVE {_E}, r AS (SELECT dst AS \"Y\" FROM e WHERE src = 5 UNION SELECT e.dst FROM r JOIN e ON e.src = r.\"Y\") SELECT \"Y\" FROM r")
def _demand(spark, d):
    return program(spark, d, _DEMAND).evaluate(spark).query(0)


@frame("demand_fib", "SELECT CAST(144 AS BIGINT) AS \"F\"")
def _fib(spark, d):
    return Program("fib : int -> int -> rel. %demand fib + -. fib 0 0. fib 1 1. fib N F :- N > 1, A = N - 1, B = N - 2, fib A X, fib B Y, F = X + Y. ?- fib 12 F.").evaluate(spark).query(0)


@frame("diverge_walk", f"""WITH RECURSIVE e AS (SELECT s_suppkey AS src, (3 * s_suppkey + 1) % 100 AS dst, s_nationkey - 20 AS w FROM supplier),
    w AS (SELECT CAST(7 AS BIGINT) AS x, CAST(0 AS BIGINT) AS d, 0 AS n UNION ALL SELECT e.dst, w.d + e.w, n + 1 FROM w JOIN e ON e.src = w.x WHERE n < 300)
    SELECT x AS node, CASE WHEN arg_max(d, n) < arg_min(d, n) THEN '-inf' ELSE CAST(min(d) AS VARCHAR) END AS d FROM w GROUP BY x""")
def _diverge_walk(spark, d):
    text = "step : int -> int -> int -> rel. step S T W :- supplier S N, X = 3 * S + 1, T = X - X / 100 * 100, W = N - 20. at : (node : int) -> (d : min int) -> rel. at 7 0. at Y (D + W) :- at X D, step X Y W."
    return program(spark, d, text).evaluate(spark).extended("at")


_PATH = EDGE + "path : (src : int) -> (dst : int) -> rel. %demand path + -. path X Y :- edge X Y. path X Z :- edge X Y, path Y Z. "
_SOME = f"WITH RECURSIVE {_E}, p AS (SELECT src, dst FROM e WHERE src < 6 UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"
rules("demand_negation", "q", _PATH + "q : (key : int) -> rel. q X :- supplier X _, X < 6, not path X 40.", f"{_SOME} SELECT s_suppkey AS key FROM supplier WHERE s_suppkey < 6 AND s_suppkey NOT IN (SELECT src FROM p WHERE dst = 40)")
rules("demand_aggregate", "q", _PATH + "q : (key : int) -> (n : int) -> rel. q X N :- supplier X _, X < 6, N = count { Y | path X Y }.", f"{_SOME} SELECT src AS key, count(*) AS n FROM p GROUP BY src")
rules("demand_disjunction", "q", _PATH + "q : (key : int) -> rel. q Y :- (path 2 Y ; path 5 Y).", f"{_SOME} SELECT DISTINCT dst AS key FROM p WHERE src IN (2, 5)")

# Inputs, outputs, answers

rules("negate", "q", "q : (key : int) -> (v : int) -> rel. q K (-S) :- part K _ _ S, -S < 0 - 40.", "SELECT p_partkey AS key, CAST(-p_size AS BIGINT) AS v FROM part WHERE -p_size < -40")
rules("fold_constants", "q", "q : (key : int) -> (v : int) -> rel. q K (S + (2 * 3 - 7 / 2)) :- part K _ _ S, S < 6 * 2 - 5.", "SELECT p_partkey AS key, CAST(p_size + 3 AS BIGINT) AS v FROM part WHERE p_size < 7")
rules("inline_facts", "q", 'q : (key : int) -> (rank : int) -> rel. level : string -> int -> rel. level "BUILDING" 1. level "MACHINERY" 2. q K R :- customer K _ S, level S R.', "SELECT c_custkey AS key, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")


rules("formula_functions", "q", "small, odd : int -> prop. small X :- X < 4. small X :- X = 40. odd X :- Y = X / 2, X <> Y * 2. q : (key : int) -> rel. q K :- part K _ _ S, small S, odd K.", "SELECT p_partkey AS key FROM part WHERE (p_size < 4 OR p_size = 40) AND p_partkey % 2 = 1")


@frame("given_facts", "SELECT c_custkey AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey <> 3")
def _given_facts(spark, d):
    p = program(spark, d, "wanted : string -> rel. %input wanted. barred : int -> rel. %input barred. q : (key : int) -> rel. %output q. q K :- customer K N S, wanted S, not barred N.")
    p.load_facts('wanted "BUILDING". wanted "HOUSEHOLD". barred 3. barred 99.')
    return p.evaluate(spark).outputs()["q"]


@frame("open_input", "SELECT s_suppkey AS key FROM supplier WHERE s_nationkey IN (1, 2, 5)")
def _open_input(spark, d):
    p = program(spark, d, "seen : int -> rel. %open seen. q : (key : int) -> rel. q K :- supplier K N, seen N.")
    p.load_facts("seen 1. seen 2. seen 5.")
    return p.evaluate(spark).outputs(all_relations=True)["q"]


@frame("query_answers", "SELECT c_custkey AS \"C\", o_totalprice AS \"P\" FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 400000")
def _query_answers(spark, d):
    return program(spark, d, '?- customer C _ "BUILDING", orders _ C P _, P > 400000.0.').evaluate(spark).query(0)


@frame("rounds_of_strata", "SELECT 'a' AS stage, count(*) AS n FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT 'b', count(*) FROM supplier WHERE s_nationkey >= 5")
def _strata(spark, d):
    text = "low, high : int -> rel. low K :- supplier K N, N < 5. high K :- supplier K _, not low K. q : (stage : string) -> (n : int) -> rel. q X N :- X = \"a\", N = count { K | low K }. q X N :- X = \"b\", N = count { K | high K }."
    return program(spark, d, text).evaluate(spark).relation("q")


# Facts as values

rules("ctor_match", "q", "shape : type. box : int -> int -> shape. bag : string -> shape. has : int -> shape -> rel. has K (box S K) :- part K _ _ S, S > 20. has K (bag N) :- part K N _ S, S <= 20. q : (key : int) -> (side : int) -> rel. q K A :- has K (box A _).", "SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS side FROM part WHERE p_size > 20")
rules("ctor_ids", "q", "t : type. pt : int -> t. at : int -> t -> rel. at K (pt N) :- supplier K N. q : (a : int) -> (b : int) -> rel. q A B :- at A P, at B P, A < B.", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
rules("exists_check", "q", "t : type. pt : int -> t. some : t -> rel. some (pt N) :- supplier _ N. q : (n : int) -> rel. q N :- nation N _ _, X = pt N.", "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS n FROM supplier")
rules("downcast", "q", "who : type. c : int -> who. s : int -> who. all : who -> int -> rel. all (c K) N :- customer K N _. all (s K) N :- supplier K N. q : (key : int) -> (nation : int) -> rel. q K N :- all (X : s) N, X = s K.", "SELECT s_suppkey AS key, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
rules("proj_union", "q", "c : type = { id : int, at : int }. s : type = { id : int, seg : string }. who : type = c | s. all : who -> rel. all (c K N) :- supplier K N. all (s K G) :- customer K _ G. q : (id : int) -> rel. q (X.id) :- all X.", "SELECT s_suppkey AS id FROM supplier UNION SELECT c_custkey FROM customer")
rules("update_record", "q", "c : type = { id : int, at : int }. all, moved : c -> rel. all (c K N) :- supplier K N. moved (X with { at = 0 - 1 }) :- all X. q : (id : int) -> (at : int) -> rel. q I A :- moved X, X = c I A.", "SELECT s_suppkey AS id, CAST(-1 AS BIGINT) AS at FROM supplier")
rules("as_pattern", "q", "c : type = { id : int, at : int }. c K N :- supplier K N. held : c -> rel. held X :- (c _ 3 as X). q : (id : int) -> rel. q (X.id) :- held X.", "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 3")


@frame("list_len_member", "SELECT CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS x")
def _lists(spark, d):
    p = Program()
    m = p.use(lists.family, "int")
    p.read(f"mine : {m.type} -> rel. q : (n : int) -> (x : int) -> rel. q N 2 :- mine L, {m.len} L N, {m.member} L 2.")
    p.fact("mine", lists.lift([1, 2, 5]))
    return p.evaluate(spark).relation("q")


# Provenance


@frame("derivations", f"WITH {_E} SELECT 'two ' || a.src || ' ' || b.dst AS fact, 'step' AS rule, 'edge ' || a.src || ' ' || a.dst || ', edge ' || b.src || ' ' || b.dst AS premises FROM e a JOIN e b ON a.dst = b.src")
def _derivations(spark, d):
    r = program(spark, d, EDGE + "two : int -> int -> rel. %derivations two. @step two X Z :- edge X Y, edge Y Z.").evaluate(spark)
    return r.derivations("two").select("fact", "rule", F.array_join("premises", ", ").alias("premises"))


@frame("neg_premise", f"WITH {_H} SELECT 'end ' || dst AS fact, 'edge ' || src || ' ' || dst AS premise, 'not edge ' || dst || ' _' AS negated FROM e WHERE dst NOT IN (SELECT src FROM e)")
def _negative(spark, d):
    r = program(spark, d, HALF + "end : int -> rel. %derivations end. end Y :- edge X Y, not edge Y _.").evaluate(spark)
    return r.derivations("end").select("fact", F.col("premises")[0].alias("premise"), F.col("negated")[0].alias("negated"))
