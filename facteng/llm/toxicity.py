"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models. The model of a category sees the words of the text
and the probabilities of all earlier categories; while it is fitted those are out-of-fold predictions, so it
learns from probabilities as uncertain as the ones it will get. The last category is the verdict.

The word features are whole words and their first three to five letters, which let a model recognise families of
words it saw only in part. They are selected for each category by their log odds over the fitted sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean
from .training import SparseRows, fit_logistic, labelled_sample, sigmoid

_WORD = re.compile(r"\w+")
#: Languages whose toxic texts are categories of their own; the verdict over all comes last.
LANGUAGES = ("en", "fr", "de", "es")
CATEGORIES = tuple(f"toxic_{x}" for x in LANGUAGES) + ("toxic",)
#: Labelled rows the chain is fitted on, at most; the only bound, and on training alone.
MAX_ROWS = 12_000
FEATURES_PER_CATEGORY = 400
#: Logarithm of how many times as frequent a feature must be inside a category to be used.
LEAST_ODDS = 1.5
FOLDS = 3


class Chain(NamedTuple):
    features: dict[str, int]
    models: list[tuple[np.ndarray, float]]  # of each category: weights of features and earlier categories; bias
    categories: tuple[str, ...]


def word_features(word: str) -> list[str]:
    return [word] + [f"^{word[:n]}" for n in (3, 4, 5) if len(word) > n]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _statistics(sample: DataFrame, categories: tuple[str, ...]) -> pd.DataFrame:
    """feature, n (documents with it), and for each category the positives among them; features of three or more."""
    names = [f"n_{k}" for k in range(len(categories))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [Counter() for _ in range(len(categories) + 1)]
            for text, marks in zip(b["text"], b[list(categories)].to_numpy(), strict=True):
                mine = {f for w in distinct_words(text) for f in word_features(w)}
                counts[0].update(mine)
                for k in np.flatnonzero(marks):
                    counts[k + 1].update(mine)
            yield pd.DataFrame({"feature": list(counts[0]), "n": list(counts[0].values())} | {x: [c[f] for f in counts[0]] for x, c in zip(names, counts[1:], strict=True)})

    schema = "feature string, n long, " + ", ".join(f"{x} long" for x in names)
    sums = sample.mapInPandas(lean(run), schema).groupBy("feature").agg(*[F.sum(x).alias(x) for x in ["n", *names]])
    return sums.where(" or ".join(f"{x} >= 3" for x in names))


def fit_chain(sample: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """Fits a chain on sample (text and an int 0/1 column for each category). Categories without positives or
    without negatives are predicted by their base rate; an empty sample gives a chain that rejects nothing."""
    sums = [int(x or 0) for x in sample.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()]
    total, positives = sums[0], sums[1:]
    stats = _statistics(sample, categories).toPandas().sort_values("feature")  # bounded by the sample
    features: dict[str, int] = {}
    for k in range(len(categories)):
        mine = stats[f"n_{k}"].to_numpy(np.float64)
        odds = np.log((mine + 0.5) / (positives[k] + 1.0) / ((stats["n"] - mine + 0.5) / (total - positives[k] + 1.0)))
        telling = (mine >= 3) & (odds >= LEAST_ODDS)
        order = np.argsort(np.where(telling, -mine * odds, np.inf), kind="stable")
        best = stats["feature"].to_numpy()[order[: min(FEATURES_PER_CATEGORY, int(telling.sum()))]]
        for f in sorted(best):
            features.setdefault(f, len(features))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Counter(features[f] for w in distinct_words(t) for f in word_features(w) if f in features) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "col": [list(c) for c in found], "val": [list(c.values()) for c in found]} | {c: b[c] for c in categories})

    schema = "doc_id long, col array<int>, val array<int>, " + ", ".join(f"{c} int" for c in categories)
    data = sample.mapInPandas(lean(rows), schema).toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    lengths = [len(c) for c in data["col"]]
    flat = lambda c: np.concatenate([np.asarray(v, dtype=np.int64) for v in data[c]]) if sum(lengths) else np.empty(0, np.int64)
    x = SparseRows(np.repeat(np.arange(len(data)), lengths), flat("col"), np.log1p(flat("val")), (len(data), len(features)))
    fold = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in data["doc_id"]], dtype=np.int64)
    models = []
    for c in categories:
        y = data[c].to_numpy(np.float64)
        models.append(fit_logistic(x, y))
        ahead = np.zeros(len(y))  # out-of-fold probabilities for the models that follow
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(outside):
                w, b = fit_logistic(x.take(inside), y[inside])
                ahead[outside] = sigmoid(x.take(outside).dot(w) + b)
        x = x.with_dense(ahead)
    return Chain(features, models, categories)


class Scorer:
    """Applies a chain to texts; remembers which features a word has."""

    def __init__(self, chain: Chain, remember: int = 1 << 17):
        self.chain, self.remember, self.seen = chain, remember, {}
        n = len(chain.features)
        self.words = np.array([w[:n] for w, _ in chain.models]).reshape(len(chain.models), n)
        self.ahead = [w[n:] for w, _ in chain.models]

    def ids(self, word: str) -> tuple[int, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            got = self.seen[word] = tuple(self.chain.features[f] for f in word_features(word) if f in self.chain.features)
        return got

    def __call__(self, text: str | None) -> list[float]:
        counts: Counter[int] = Counter()
        seen = self.seen
        for w in distinct_words(text):
            got = seen.get(w)
            if got is None:
                got = self.ids(w)
            if got:
                counts.update(got)
        z = np.zeros(len(self.chain.models))
        if counts:
            z = self.words[:, list(counts)] @ np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        out: list[float] = []
        for k, (_, b) in enumerate(self.chain.models):
            out.append(float(sigmoid(z[k] + b + float(self.ahead[k] @ np.array(out)))) if out else float(sigmoid(z[k] + b)))
        return out


def score(docs: DataFrame, spark: SparkSession, chain: Chain) -> DataFrame:
    """(doc_id, one probability p_<category> double for each category): one row per row of docs, from whole texts.

    Null and empty texts get the chain's biases; repeated rows and equal texts get equal results; a null doc_id stays
    null; further columns are not read; no rows give no rows."""
    shared = spark.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = np.array([scorer(t) for t in b.column(1).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in p.T]], ["doc_id", *names])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return plain.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{n} double" for n in names))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The labelled sample with a column for each category: a toxic text counts for its language's category too."""
    sample = labelled_sample(docs, labels, ["toxic"], max_rows, extra=[F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang")])
    return sample.select("doc_id", "text", *[F.when(F.col("_lang") == x, F.col("toxic")).otherwise(0).cast("int").alias(f"toxic_{x}") for x in LANGUAGES], "toxic")


def fit_from_tables(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> Chain:
    return fit_chain(training_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows))


def keep_clean(docs: DataFrame, spark: SparkSession, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose verdict (the last category) is below threshold, columns and values unchanged.

    Null and empty texts are kept unless the chain's base rate alone reaches threshold; repeated rows share their fate."""
    shared, schema = spark.sparkContext.broadcast(chain), docs.schema
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            keep = [scorer(t)[-1] < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; predicted is 1 if score is 0.5 or more. Null and empty texts, repeated rows and null
    ids as in score(); null labels and labels of absent documents teach nothing; without labels all scores are the base rate."""
    chain = fit_from_tables(spark, sf_dir)
    found = score(documents(spark, sf_dir), spark, chain)
    return found.withColumn("score", F.col("p_toxic")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
