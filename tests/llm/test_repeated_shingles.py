import random

from facteng.llm import decontaminate as D

from .test_text_joins import slow_leaks


def test_items_with_repeated_shingles_are_found(spark):
    """A window that lacks just the repeated shingle of an item still has similarity 0.8."""
    rng = random.Random(5)
    items, docs = [], []
    for k in range(8):
        rest = [f"w{rng.randrange(10**6)}" for _ in range(8 * 60 + 36)]
        items.append((k, " ".join([f"run{k}"] * 64 + rest)))
        docs.append((k, " ".join([f"x{rng.randrange(10**6)}" for _ in range(64)] + rest)))
    docs += [(100, items[0][1]), (101, "go " * 3 + items[1][1])]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), spark)
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.windows) for r in got.collect()}
    want = {k: (round(a, 9), s, n) for k, (a, s, n) in slow_leaks(docs, items).items()}
    assert {(k, k) for k in range(8)} <= set(want) and found == want
