"""The quality operator's reader: counts as by pieces, without a memory of every token."""

from __future__ import annotations

from collections import Counter

import numpy as np

from facteng.llm import quality

TOKENS = "the The THE the, (the) ((the)) the!! the$$$ the_ _the don't a1 A1 2024 x² ² ... !! -- ª ǅ ǅx İ İx é É é, «é» A B! b| " + "w" * 25 + " " + "W" * 24


def test_counts_are_those_of_pieces():
    text = f"{TOKENS} {TOKENS}\nthe The unknown, Unknown UNKNOWN! unknown"
    every = sorted(quality.all_pieces(text) - {"unknown", "2024"})
    vocabulary = {p: i for i, p in enumerate(every)}
    want = Counter(p for t in text.split() for p in quality.pieces(t) if p in vocabulary)
    counts = Counter(text.split())
    want |= Counter({m: 1 for m in quality.shape_marks(text, sum(counts.values()), len(counts), max(counts.values()))})
    reader = quality.Reader(vocabulary)
    for _ in range(2):
        ids, n = reader(text)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {vocabulary[p]: float(k) for p, k in want.items()}
        assert (np.diff(ids) > 0).all()
    for empty in ("", None, " \n "):
        assert {every[i] for i in reader(empty)[0]} <= set(quality.shape_marks(empty or "", 0, 0, 0))


def test_unknown_words_are_not_remembered():
    reader = quality.Reader({"<lower>": 0, "<end!>": 1, "word": 2})
    ids, n = reader("word Word word! " + " ".join("x" + "abcdefghij"[i % 10] * (i // 10) + "!" for i in range(1000)))
    assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {0: 1002.0, 1: 1001.0, 2: 3.0}
    assert set(reader.seen) == {"word", "Word", "word!"}
