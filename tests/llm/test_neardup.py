import random

import pytest

import corpus_pipeline as P
from facteng.llm import neardup as N

from .conftest import words


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [i for i in range(len(texts)) if find(i) == i]


@pytest.fixture(scope="module")
def texts():
    """Copies with a few changed words, many of them between 0.7 and 1, chains, and a passage that many share."""
    rng = random.Random(11)
    common = words(rng, 30)
    out = [None, "", "one two three", "ONE  two three", "one two four"]
    for _ in range(25):
        base = words(rng, rng.randint(20, 150)).split() + (common.split() if rng.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 8)):
            new = list(base)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(["xx", "yy", "zz"])
            out.append(" ".join(new))
            base = new if rng.random() < 0.5 else base
    return out


@pytest.mark.parametrize("block", [N.BLOCK, 3])
def test_groups_are_those_of_all_pairs(spark, texts, block):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = {}
    for r in N.similar_groups(docs, spark, block=block).collect():
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert sorted(least.values()) == kept_by_all_pairs(texts)


def test_the_stage_keeps_what_all_pairs_keep(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = P.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_all_pairs(texts)


def test_simhash_finds_most_links_without_the_exact_join(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(N, "_candidates", lambda *a: spark.createDataFrame([], "k long, k_ long"))
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()}
    equal = len({shingles(t) for t in texts})
    right = set(kept_by_all_pairs(texts))
    assert right <= kept and len(kept) - len(right) <= (equal - len(right)) // 5


def test_simhash_counts_more_than_half_of_the_remixed_hashes():
    s = N.shingle_set(b"a b c d e f g h i j k l m", 5)
    one = [N.prints(s[i : i + 1]) for i in range(len(s))]
    bits = [[int(w) >> k & 1 for w in p for k in range(64)] for p in one]
    plain = [int(2 * sum(x) > len(s)) for x in zip(*bits, strict=True)]
    assert [int(w) >> k & 1 for w in N.prints(s) for k in range(64)] == plain
