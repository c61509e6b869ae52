import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facteng.llm import decontaminate as D
from facteng.llm import linededup as L
from facteng.llm import native_text as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_removed(rows, t=0.8, least=5):
    lines = [((i is not None, i or 0), i, x, k, set(WORD.findall(s.lower()))) for i, x in {(r[0], r[1]) for r in rows} for k, s in enumerate((x or "").split("\n"))]
    out = set()
    for key, i, x, k, w in lines:
        for key2, _, x2, k2, v in lines:
            if len(w) >= least and len(v) >= least and (key2, k2) < (key, k) and x2 is not None and len(w & v) >= t * len(w | v):
                out.add((i, x, k))
    return out


def line_rows(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["the", "of", "and", *[f"w{k}" for k in range(40)]]) for _ in range(rng.randint(3, 30))) for _ in range(12)]

    def vary(s):
        w = s.split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        return " ".join(w)

    return [(i, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(25)] + [(99, ""), (100, None), (None, pool[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_lines_by_brute_force(spark, seed):
    rows = line_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = {r.th: r.text for r in docs.select("text", F.xxhash64("text").alias("th")).collect()}
    found = {(r.doc_id, back[r.th], k) for r in L.removed_lines(docs, spark).collect() for k in r["lines"]}
    assert found == slow_removed(rows) and found


def test_dedup_lines_edge_cases(spark, docs, rows, none):
    out = L.dedup_lines(docs, spark)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (5, None) in got and (4, "") in got and (2, "") in got  # a copy loses its only line
    assert next(r for r in out.collect() if r.doc_id == 2).n_chars == 0
    assert L.dedup_lines(none, spark).count() == 0


def test_cut_lines_keep_their_order(spark):
    s = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, s), (2, f"first own line of the text\n{s}\n\nlast one"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(docs, spark).collect()}
    assert got == {1: s, 2: "first own line of the text\n\nlast one", 3: ""}


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=0, max_size=9))
@settings(max_examples=15, deadline=None)
def test_native_simhash(spark, hashes):
    planes = max(1, len(hashes).bit_length())
    got = spark.createDataFrame([(hashes,)], "h array<bigint>").select(N.simhash(F.col("h"), planes)).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum((h & (2**64 - 1)) >> b & 1 for h in hashes) > len(hashes))
    assert got & (2**64 - 1) == want


def test_overlap_counts_repeats(spark):
    df = spark.createDataFrame([([1, 1, 2, 3], [1, 1, 1, 3]), ([1, 2], [2, 1]), ([], [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(N.overlap(F.col("a"), F.col("b"))).collect()] == [3, 2, 0]


def slow_leaks(docs, items, width=5, t=0.8):
    out = {}
    for i, text in docs:
        w = WORD.findall((text or "").lower())
        for k, it in items:
            v = WORD.findall((it or "").lower())
            n = min(width, len(v))
            if not n or len(w) < n:
                continue
            sh = lambda x, n=n: [tuple(x[j : j + n]) for j in range(len(x) - n + 1)]
            a, b = sh(w), sh(v)
            for s in range(max(1, len(a) - len(b) + 1)):
                x, y = Counter(a[s : s + len(b)]), Counter(b)
                o = sum((x & y).values())
                sim = o / (x.total() + y.total() - o)
                if sim >= t:
                    best, at, count = out.get((i, k), (0, 0, 0))
                    out[i, k] = (max(best, sim), s if sim > best else at, count + 1)
    return out


def test_leaks_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("mnopq")
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 40)))) for k in range(8)] + [(8, "One two"), (9, ""), (10, None), (11, "go go go go go go go go go go")]
    docs = []
    for i in range(40):
        w = [word() for _ in range(rng.randint(0, 80))]
        if i % 2:
            v = rng.choice(items)[1] or ""
            v = v.split()
            if i % 4 == 1 and len(v) > 12:
                v[rng.randrange(len(v))] = "zz"
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((i, " ".join(w)))
    docs += [(50, None), (51, ""), (52, items[0][1].upper()), (None, items[1][1]), (53, " ".join(items[2][1].split()[:-1])), (54, "x " + "go " * 30)]
    got = D.contaminated(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, m int, sh string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, fp long"), spark)
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.windows) for r in got.collect()}
    assert found == {k: (round(a, 9), s, n) for k, (a, s, n) in slow_leaks(docs, items).items()} and len(found) > 15


def test_clean_documents_stay(spark, docs, rows, none):
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    out = D.keep_clean(docs, bench, spark)
    left = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and not {1, 2, 3} & set(left) and len(left) == len(rows) - 4
    assert D.keep_clean(docs, bench.limit(0), spark).count() == len(rows)
    assert D.keep_clean(none, bench, spark).count() == 0
