import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from facteng.llm import simhash as S


def slow_fingerprint(text, width=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@given(st.text(alphabet="aAbB é\t\n 漢", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint_is_as_defined(text):
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdef") * 3 for _ in range(500)).encode()
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(text) == want


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_manhattan_distance_is_a_lower_bound(a, b):
    x, y = (S.segment_counts(np.array([v], dtype=np.uint64))[0] for v in (a, b))
    fields = [(int(x) >> 2 * k & 3, int(y) >> 2 * k & 3) for k in range(32)]
    u, v = S.unary_counts(np.array([a, b], dtype=np.uint64)).tolist()
    assert bin(u ^ v).count("1") == sum(abs(p - q) for p, q in fields) <= bin(a ^ b).count("1")


def clustered(seed, n, radius=6):
    r = np.random.default_rng(seed)
    centers = r.integers(0, 2**63, 5, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, radius)).tolist())) for _ in range(n)]
    return sorted({int(centers[i % 5]) ^ flips[i] for i in range(n)} | set(r.integers(0, 2**63, n // 2).tolist()))


@pytest.mark.parametrize("block", [2048, 5])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, block):
    """With blocks of five, large cells are cut and all pairs of their blocks are compared."""
    fps = clustered(3, 150)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block).collect()
    at = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        assert bin(fps[at[e.u]] ^ fps[at[e.v]]).count("1") <= 64
        parent[find(at[e.u])] = find(at[e.v])
    want = slow_components(fps, 4)
    groups = lambda f: {frozenset(i for i in range(len(fps)) if f(i) == r) for r in map(f, range(len(fps)))}
    assert groups(find) == groups(lambda i: want[i])


def test_forests_of_large_and_small_units_agree(monkeypatch):
    fp = np.array(clustered(5, 300), dtype=np.uint64)
    key = np.zeros(len(fp), np.int64)
    u, v = S.links_of_units(key, fp, 4)
    monkeypatch.setattr(S, "SMALL", 2)
    a, b = S.links_of_units(key, fp, 4)
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_radius_is_limited():
    with pytest.raises(ValueError):
        S.links(None, radius=5)


def test_near_duplicates_by_brute_force(spark, docs, rows):
    got = S.near_duplicates(docs, spark).collect()
    fps = [slow_fingerprint(r[1] or "") for r in rows]
    comp = slow_components(fps, 4)
    least = {c: min((r[0] for r, d in zip(rows, comp, strict=True) if d == c and r[0] is not None), default=None) for c in comp}
    want = sorted(((r[0], np.uint64(f).astype(np.int64).item(), least[c]) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == want


def test_one_of_each_group_stays(spark, docs, rows):
    kept = S.one_of_each_group(docs, spark).collect()
    ids = [r.doc_id for r in kept]
    assert 1 in ids and ids.count(2) == 0 and len(kept) == len({r.root for r in S.near_duplicates(docs, spark).collect()})
    assert kept[0].asDict().keys() == docs.first().asDict().keys()
    twice = docs.where("doc_id = 2")
    assert S.one_of_each_group(twice, spark).count() == 1


def test_empty_table(spark, none):
    assert S.near_duplicates(none, spark).count() == 0
    assert S.one_of_each_group(none, spark).count() == 0
