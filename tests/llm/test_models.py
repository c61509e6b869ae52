import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from facteng.llm import lm, quality, toxicity
from facteng.llm.training import SparseRows, fit_logistic, labelled_sample, sigmoid


def labelled(spark, n=240):
    rng = random.Random(4)
    bad = ["fool", "clod", "swine", "toad"]
    out = []
    for i in range(n):
        w = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 40))]
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)
        out.append((i, text, "en" if i % 3 else "de", 0 if junk else 1, int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in out], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in out] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, out


def test_logistic_regression_separates():
    rng = np.random.default_rng(0)
    y = (rng.random(200) < 0.5).astype(float)
    x = SparseRows(np.arange(200), y.astype(np.int64), np.ones(200), (200, 2))
    w, b = fit_logistic(x, y)
    assert ((sigmoid(x.dot(w) + b) > 0.5) == (y > 0.5)).all()
    w, b = fit_logistic(x.take(np.flatnonzero(y == 0)), np.zeros(int((y == 0).sum())))
    assert not w.any() and sigmoid(b) < 0.02


def test_sample_is_bounded_and_clean(spark):
    docs, labels, _ = labelled(spark)
    got = labelled_sample(docs, labels, ["toxic"], 50).collect()
    assert len(got) == 50 and all(r.toxic in (0, 1) for r in got)
    again = labelled_sample(docs, labels, ["toxic"], 50).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in again}


def test_chain_finds_toxic_texts(spark, docs, none):
    d, labels, rows = labelled(spark)
    chain = toxicity.fit_chain(toxicity.training_rows(d, labels.where("doc_id % 2 = 0 or doc_id % 3 = 0")))
    assert len(chain.models) == 5 and len(chain.models[-1][0]) == len(chain.features) + 4  # earlier categories feed the last
    got = {r.doc_id: r.p_toxic for r in toxicity.score(d, spark, chain).collect()}
    wrong = sum((got[r[0]] >= 0.5) != bool(r[4]) for r in rows)
    assert wrong <= 3
    kept = {r.doc_id for r in toxicity.keep_clean(d, spark, chain).collect()}
    assert kept == {i for i, p in got.items() if p < 0.5}
    out = toxicity.keep_clean(docs, spark, chain)
    assert out.columns == docs.columns and out.count() >= docs.count() - 1  # 30,000 random words may hit the model's stems
    assert toxicity.score(none, spark, chain).count() == 0
    empty = toxicity.fit_chain(toxicity.training_rows(none, labels))
    assert toxicity.keep_clean(docs, spark, empty).count() in (0, docs.count())


def test_quality_learns_form(spark, docs, none):
    d, labels, rows = labelled(spark)
    sample = labelled_sample(d, labels, ["quality"], 1000, where=quality.fold(4) != 2)
    model = quality.fit(d, spark, sample)
    got = {r.doc_id: r.score for r in quality.score(d, spark, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    wrong = sum((got[r[0]] >= 0.5) != bool(r[3]) for r in held)
    assert wrong <= len(held) * 0.05 and model.temperature > 0
    other = {(r.doc_id, r.score) for r in quality.score(docs, spark, model).collect()}
    assert len(other) >= 60 and all(0 <= s <= 1 for _, s in other)
    assert len({s for i, s in other if i in (1, 2)}) == 1  # equal texts
    assert quality.score(none, spark, model).count() == 0


def test_word_vectors_do_not_depend_on_partitions(spark):
    d, labels, _ = labelled(spark)
    words = quality.vocabulary_of(d, 200)
    a, b = quality.word_vectors(d.repartition(1), spark, words), quality.word_vectors(d.repartition(5), spark, words)
    assert np.allclose(a, b, atol=1e-4) and a.shape == (len(words), quality.DIM)


@pytest.mark.parametrize("n", [[0, 50, 20, 10, 6, 4, 3], [0, 5, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0], [0, 3, 9, 1, 1, 1, 9]])
def test_discounts_are_proper(n):
    assert all(0 < x <= 1 for x in lm.discounts(n))


def corpus(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "W1\tunseenword"), (None, "w1 w2")]


def test_long_tokens_are_split_in_linear_time():
    assert quality.pieces("--Wo-rd!!") == ("wo-rd", "<title>", "<odd>", "<end!>") and quality.pieces("...") == ("<symbol>", "<odd>")
    began = time.process_time()
    assert quality.pieces("a" + "-" * 2_000_000 + "a")[1:] == ("<lower>", "<odd>")
    assert time.process_time() - began < 5


def test_repeated_rows_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i % 2}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.toxic) for r in labelled_sample(docs, labels, ["toxic"], 10).collect()) == [(0, 1), (1, 1)]
    assert labelled_sample(docs, labels, ["toxic"], 1).count() == 1


class Katz:
    """The model again, from plain counts."""

    def __init__(self, texts, order):
        self.order, self.texts = order, texts
        self.c = [None, Counter(w for t in texts for w in t)]
        for k in range(2, order + 1):
            seqs = [[None] + t for t in texts]
            self.c.append(Counter(tuple(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1)))
        tally = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, 7)]
        self.d = [None] + [lm.discounts(tally(c)) for c in self.c[1:]]
        self.N, self.V = sum(self.c[1].values()), len(self.c[1])
        mass = sum(self.cut(1, v) for v in self.c[1].values()) / self.N
        self.share = self.N / (self.N + 1) if mass >= 1 - 1e-15 else 1.0
        self.unseen = (1 - mass * self.share) / (self.V + 1)
        self.after, self.memo = {}, {}
        for k in range(2, order + 1):
            for gram, v in self.c[k].items():
                self.after.setdefault(gram[:-1], []).append((gram[-1], v))

    def cut(self, k, v):
        return v * self.d[k][v] if v <= lm.CUTOFF else v

    def p(self, context, w):
        if not context:
            v = self.c[1].get(w, 0)
            return self.cut(1, v) / self.N * self.share if v else self.unseen
        own, backoff = self.weights(context)
        return own[w] if w in own else backoff * self.p(context[1:], w)

    def weights(self, context):
        if context not in self.memo:
            k, seen = len(context) + 1, self.after.get(context, [])
            count = sum(v for _, v in seen)
            own = {w: self.cut(k, v) / count for w, v in seen}
            mass, under = math.fsum(own.values()), math.fsum(self.p(context[1:], w) for w in own)
            if not seen:
                self.memo[context] = {}, 1.0
            elif 1 - under <= 1e-12:
                self.memo[context] = {w: x / mass for w, x in own.items()}, 1e-300
            else:
                kept = mass if mass <= 1 - 1e-12 else 1 - 0.5 / (count + 0.5)
                self.memo[context] = {w: x * kept / mass for w, x in own.items()}, (1 - kept) / (1 - under)
        return self.memo[context]

    def score(self, t):
        s = [None] + t
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i]), s[i])) for i in range(1, len(s)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_by_brute_force(spark, order):
    rows = corpus(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_known long").repartition(3)
    got = {r.doc_id: r for r in lm.katz_scores(df, spark, order, per_part=64, per_block=300, split=16, turns=2).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    model = Katz([t for i, t in toks.items() if not held(i)], order)
    if order <= 3:
        for context in list(model.after)[:200]:  # every context sums to one
            assert sum(model.p(context, w) for w in model.c[1]) + (model.V + 1) * model.p(context, "unseen") == pytest.approx(1, abs=1e-9)
    c = model.c[1]
    for i, ws in toks.items():
        r = got[i]
        assert r.score == pytest.approx(model.score(ws), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((c.get(w, 0) + 1) / (model.N + model.V + 1)) for w in ws), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in c for w in ws), model.N, held(i))
    assert len(got) == len(rows)


def test_katz_edge_cases(spark, docs, rows, none):
    assert lm.katz_scores(docs, spark).count() == len(rows)
    assert lm.katz_scores(none, spark).count() == 0
