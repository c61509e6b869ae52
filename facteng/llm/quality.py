"""Quality scores from random-indexing word vectors and a two-layer network.

Random indexing: every document of the corpus has a sparse ternary index vector drawn from a hash of its text; a
word's vector is the sum of the index vectors of the documents it occurs in, over the whole corpus. Each text
pools the vectors of its words and, separately, of its form marks (case, symbols, repetition, length), and
a network with one hidden layer turns the pool into a probability, calibrated by a temperature on rows kept
out of the fit. Only labels are learnt from a bounded sample; word vectors come from all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean
from .training import labelled_sample, sigmoid

DIM = 64
NONZERO = 8
#: Words with a vector, the most frequent of the labelled sample; all others are pooled by their form alone.
VOCABULARY = 8192
MAX_ROWS = 20_000
HIDDEN = 32
_LETTER = re.compile(r"\w")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"  # of ASCII, without what counts as a letter
BLOCK = 1024


def pieces(token: str) -> tuple[str, ...]:
    """What a token counts as: its letters in lower case, and marks of its form."""
    before, core, after = "", token, ""
    if not token.isalnum():
        first = _LETTER.search(token)
        start = first.start() if first else len(token)
        end = len(token) - _LETTER.search(token[::-1]).start() if first else start
        before, core, after = token[:start], token[start:end], token[end:]
    marks = []
    if not core:
        marks.append("<symbol>")
    elif core.isupper() and len(core) > 1:
        marks.append("<upper>")
    elif core[0].isupper():
        marks.append("<title>")
    else:
        marks.append("<lower>")
    if not core.isalpha() and any(map(str.isdigit, core)):
        marks.append("<digit>")
    if len(before) + len(after) > 1 or len(core) > 24:
        marks.append("<odd>")
    if after[:1] in "!%&$#*|" and after:
        marks.append(f"<end{after[:1]}>")
    return (core.lower(), *marks) if core else tuple(marks)


def shape_marks(text: str, total: int, distinct: int, tops: int) -> list[str]:
    """Marks of the whole text: length, variety of words, share of the most frequent word, repeated lines."""
    lines = text.split("\n")
    return [f"<words{min(total, 1 << 20).bit_length()}>", f"<variety{10 * distinct // max(total, 1)}>", f"<variety{10 * distinct // max(total, 1)}at{min(total, 1 << 20).bit_length()}>",
            f"<top{10 * tops // max(total, 1)}>", f"<lines{10 * len(set(lines)) // len(lines)}>"]


class Reader:
    """Turns texts into counts of known pieces, by ascending number. Tokens of known words are remembered; the many others
    are told by their form each time, which costs less than to find them in a large memory."""

    def __init__(self, vocabulary: dict[str, int], remember: int = 1 << 16):
        self.vocabulary, self.remember, self.seen = vocabulary, remember, {}
        self.kinds: dict[tuple[int, ...], int] = {}  # the known marks of a token, numbered: there are few combinations
        self.forms: dict[tuple, int] = {}  # kinds of tokens of letters between ASCII punctuation, by all that their marks depend on

    def kind(self, marks: tuple[str, ...]) -> int:
        known = tuple(self.vocabulary[m] for m in marks if m in self.vocabulary)
        return self.kinds.setdefault(known, len(self.kinds)) << 32

    def code(self, token: str) -> int:
        """Number of the token's marks in the upper bits, number of its word (or of none) in the lower 32."""
        core = token if token.isalpha() else token.strip(_PUNCTUATION)
        if core.isalpha():
            word = self.vocabulary.get(core.lower())
            n, size, end = len(token), len(core), ""
            if n > size:
                at = token.index(core) + size
                end = token[at : at + 1]
            form = (size > 1 and core.isupper(), core[0].isupper(), n - size > 1 or size > 24, end)
            kind = self.forms.get(form)
            if kind is None:
                kind = self.forms[form] = self.kind(pieces(token)[1:])
            if word is None:
                return kind | len(self.vocabulary)
        else:
            found = pieces(token)
            some = not found[0].startswith("<")
            word = self.vocabulary.get(found[0], len(self.vocabulary)) if some else len(self.vocabulary)
            kind = self.kind(found[some:])
        if len(self.seen) >= self.remember:
            self.seen.clear()
        got = self.seen[token] = kind | word
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        counts = Counter(text.split())
        get, code = self.seen.get, self.code
        codes = np.array([got if (got := get(t)) is not None else code(t) for t in counts], np.int64)
        times = np.fromiter(counts.values(), np.float64, len(counts))
        out = np.bincount(codes & 0xFFFFFFFF, times, len(self.vocabulary) + 1)
        out[-1] = 0.0
        for marks, n in zip(self.kinds, np.bincount(codes >> 32, times).tolist()):  # later kinds, if any, aren't in this text
            for i in marks if n else ():
                out[i] += n
        for m in shape_marks(text, int(times.sum()), len(counts), int(times.max(initial=0))):
            if m in self.vocabulary:
                out[self.vocabulary[m]] = 1.0
        ids = np.flatnonzero(out > 0)
        return ids, out[ids]


def all_pieces(text: str | None) -> set[str]:
    text = text or ""
    counts = Counter(text.split())
    found = {p for t in counts for p in pieces(t)}
    return found | set(shape_marks(text, sum(counts.values()), len(counts), max(counts.values(), default=0)))


def vocabulary_of(sample: DataFrame, size: int) -> list[str]:
    """The pieces of three or more documents of the sample, the most frequent first, size at most; marks first of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(p for t in b["text"] for p in all_pieces(t))
            yield pd.DataFrame({"piece": list(c), "n": list(c.values())})

    counts = sample.select("text").mapInPandas(lean(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n >= 3")
    best = counts.orderBy(F.desc(F.col("piece").startswith("<")), F.desc("n"), "piece").limit(size)
    return [r.piece for r in best.collect()]


def index_vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a document's sparse ternary vector."""
    bits = xxhash.xxh64_intdigest(text, 3)
    return np.array([bits >> 6 * k & 63 for k in range(NONZERO)]), np.array([1.0 if bits >> (48 + k) & 1 else -1.0 for k in range(NONZERO)])


def word_vectors(docs: DataFrame, spark: SparkSession, vocabulary: list[str]) -> np.ndarray:
    """(words, DIM) over all of docs. Every task adds up its own texts; sums travel in blocks of BLOCK words, so
    what is gathered is bounded by the vocabulary and not by the documents."""
    shared = spark.sparkContext.broadcast({p: i for i, p in enumerate(vocabulary)})
    n = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(shared.value), np.zeros((n, DIM))
        for b in batches:
            for t in b.column(0).to_pylist():
                ids, counts = reader(t)
                at, sign = index_vector((t or "").encode())
                sums[ids] += np.outer(np.log1p(counts), np.bincount(at, sign, DIM))
        for k in range(0, n, BLOCK):
            part = np.ascontiguousarray(sums[k : k + BLOCK], dtype=np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in b["sums"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"block": b["block"].iloc[:1], "sums": [total.tobytes()]})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "block long, sums binary")
    blocks = parts.groupBy("block").applyInPandas(add, "block long, sums binary").collect()
    out = np.zeros((n, DIM))
    for r in blocks:
        part = np.frombuffer(r.sums, np.float64).reshape(-1, DIM)
        out[r.block : r.block + len(part)] = part
    # Without the common direction, at unit length: what is left tells words apart.
    out -= out.mean(axis=0, keepdims=True) if n else 0.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Model(NamedTuple):
    vocabulary: dict[str, int]
    vectors: np.ndarray
    marks: int  # the first so many pieces are marks
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def pool(reader: Reader, vectors: np.ndarray, marks: int, text: str | None) -> np.ndarray:
    """Mean vector of words, mean vector of marks, and the marks' own shares (hashed into DIM places)."""
    ids, counts = reader(text)
    out = np.zeros(3 * DIM)
    if len(ids):
        first = int(np.searchsorted(ids, marks))  # ids ascend, and marks come first
        for k, part in ((0, slice(first, None)), (1, slice(first))):
            if len(ids[part]):
                out[k * DIM : (k + 1) * DIM] = counts[part] @ vectors[ids[part]] / counts[part].sum()
        total = max(float(counts[first:].sum()), 1.0)
        out[2 * DIM :] = np.bincount(ids[:first] % DIM, np.minimum(counts[:first] / total, 1.0), DIM)
    return out


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, batch: int = 64) -> tuple:
    """Two layers (tanh, logistic) by Adam on minibatches; a fifth of the rows is kept out for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    kept, inside = order[: len(y) // 5], order[len(y) // 5 :]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(inside)
        for at in range(0, len(inside), batch):
            rows = inside[at : at + batch]
            h = np.tanh(x[rows] @ p[0] + p[1])
            d = (sigmoid(h @ p[2] + p[3][0]) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    best = 1.0
    if len(kept):
        z = np.tanh(x[kept] @ p[0] + p[1]) @ p[2] + p[3][0]
        loss = lambda s: float(np.mean(np.logaddexp(0, np.where(y[kept] > 0.5, -z, z) / s)))
        best = min((float(s) for s in np.geomspace(0.25, 8, 61)), key=loss)
    return (*p[:3], float(p[3][0]), best)


def fit(docs: DataFrame, spark: SparkSession, sample: DataFrame, vocabulary_size: int = VOCABULARY) -> Model:
    """Fits on sample (text, quality 0/1); word vectors come from all of docs. Without rows of both classes the score is
    the smoothed base rate everywhere."""
    words = vocabulary_of(sample, vocabulary_size)
    vectors = word_vectors(docs, spark, words)
    known = {p: i for i, p in enumerate(words)}
    marks = sum(p.startswith("<") for p in words)
    shared = spark.sparkContext.broadcast((known, vectors, marks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, vectors, marks = shared.value
        reader = Reader(known)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [pool(reader, vectors, marks, t).tolist() for t in b["text"]], "y": b["quality"]})

    data = sample.select("doc_id", "text", "quality").mapInPandas(lean(run), "doc_id long, x array<double>, y int").toPandas().sort_values("doc_id", kind="stable")
    y = data["y"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        base = float((y.sum() + 0.5) / (len(y) + 1.0))
        zero = np.zeros(3 * DIM)
        return Model(known, vectors, marks, zero, zero + 1, np.zeros((3 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(base / (1 - base))), 1.0)
    x = np.array(data["x"].tolist())
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return Model(known, vectors, marks, center, scale, *fit_network((x - center) / scale, y))


def score(docs: DataFrame, spark: SparkSession, model: Model) -> DataFrame:
    """(doc_id, score double in 0 to 1): one row per row of docs, from whole texts alone.

    Null and empty texts get the score of an empty pool; equal texts get equal scores; a null doc_id stays null; further
    columns are not read; no rows give no rows."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.vocabulary)
        for b in batches:
            x = np.array([pool(reader, m.vectors, m.marks, t) for t in b.column(1).to_pylist()]).reshape(-1, 3 * DIM)
            z = np.tanh((x - m.center) / m.scale @ m.w1 + m.b1) @ m.w2 + m.b2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(z / m.temperature))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")


def fold(modulus: int):
    """crc32 of doc_id as text, by modulus; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op4_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = labelled_sample(docs, labels, ["quality"], MAX_ROWS, where=fold(4) != 2)
    model = fit(docs, spark, sample)
    found = score(docs, spark, model).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
