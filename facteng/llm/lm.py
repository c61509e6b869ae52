"""Katz backoff language model over whole corpora, of n-grams of any order.

Tokens are words, told apart by a 64-bit hash, and one end per text; the end is also the context a text begins in. Counts of every
order are discounted by Good-Turing. A token is evaluated recursively: if its context has been seen with it, by
the discounted count; else by the context's backoff weight times the next lower order, where the weights make every context sum to
one exactly. Below unigrams, the discount is shared by words that training never had, of which as many are assumed as it had.

The corpus is encoded once into blocks of texts. For each order, every block asks the partitions of that order's table about its
distinct n-grams, with how often training has them in the block; a partition adds these up over all blocks (so asking is
also counting) and answers each block in the order it asked, with what the block cannot know about its contexts. The answers
are written as tables, and the next order builds on them. So texts never travel word by word, nothing larger
than one partition of a table is held by a task, and their number grows with the corpus. A frequent context is dealt out over
several partitions by the hash of the next word; a frequent n-gram is one entry for each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, lean, release

#: Longest n-grams of the query. Three are right too, but exceed the budgets; see the README for figures.
ORDER = 2
#: Discounts apply to counts up to this one.
CUTOFF = 5
#: Training tokens for each partition of a table, about.
PER_PART = 2 << 20
#: Tokens of a block, about; a longer text is a block of its own.
PER_BLOCK = 2 << 20
#: Successors of a context that one partition counts, about.
SPLIT = 1 << 20
#: Steps in which the longest n-grams are asked for, so that what is shuffled at once is a part of them.
TURNS = 2


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """Bytes of an array, those of equal weight together, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=level).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def discounts(n: list[float]) -> np.ndarray:
    """d[r] for counts r = 0..CUTOFF from n[r], the number of n-grams seen r times (r = 1..CUTOFF+1): Katz's form of
    Good-Turing where it is between 0 and 1, else an absolute discount of a half."""
    d = np.ones(CUTOFF + 1)
    common = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        got = -1.0
        if n[r] and common < 1:
            got = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= CUTOFF, d[np.minimum(c, CUTOFF)] * c, c.astype(np.float64))


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which partition of a table a key is in."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = (a ^ a >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) + b
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


class Hashes(dict):
    """Hashes of words, each made once; 0 is the end's."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word, 42) or 1
        return out


class Block(NamedTuple):
    ids: np.ndarray  # of each text its doc_id and whether that is null
    sizes: np.ndarray  # tokens of each text
    words: np.ndarray  # distinct hashes; the first is the end's
    tokens: np.ndarray  # places in words

    @property
    def training(self) -> np.ndarray:
        """For every token whether its text is in training."""
        return np.repeat(np.array([not held_out(None if null else int(i)) for i, null in self.ids], bool), self.sizes)


def encode(plain: DataFrame, per_block: int) -> DataFrame:
    """(block, n, docs, sizes, words, tokens): the texts of plain(doc_id, text) in blocks."""
    names = ["block", "n", "docs", "sizes", "words", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made, task = Hashes(), 0, TaskContext.get().partitionId()
        ids: list[tuple[int, int]] = []
        hashed: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            words, at, n = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
            n[0] = len(at) + 1  # the end's comes first, then the most frequent: small numbers compress well
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            values = (pack(np.array(ids, np.int64).reshape(-1)), pack(np.array([len(x) for x in hashed], np.uint64)), pack(words[order]), pack(rank[at], 5))
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), pa.array([len(at)], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names)

        held = 0
        for b in batches:
            for at in range(b.num_rows):
                i = b.column(0)[at].as_py()
                own = [known[w] for w in tokens(b.column(1)[at].as_py())]
                own.append(0)
                ids.append((i or 0, i is None))
                hashed.append(np.array(own, np.uint64))
                held += len(own)
                if held >= per_block:
                    yield out()
                    made, held, ids, hashed = made + 1, 0, [], []
                if len(known) > 1 << 19:
                    known.clear()
        if ids:
            yield out()

    return plain.mapInArrow(lean(run), "block string, n long, docs binary, sizes binary, words binary, tokens binary")


def read_block(docs: bytes, sizes: bytes, words: bytes, tokens: bytes) -> Block:
    return Block(unpack(docs, np.int64).reshape(-1, 2), unpack(sizes, np.uint64).astype(np.int64), unpack(words, np.uint64), unpack(tokens, np.uint32).astype(np.int64))


ANSWER = "level int, block string, part long, total binary, odd binary, other binary, stats array<long>"
ANSWER_NAMES = [x.split()[0] for x in ANSWER.split(", ")]


def _stats(total: np.ndarray) -> list[int]:
    """How many n-grams are seen 1, .., CUTOFF + 1 times, how many at all, and the sum of their counts."""
    return [int((total == r).sum()) for r in range(1, CUTOFF + 2)] + [int((total > 0).sum()), int(total.sum())]


# --- words


def ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, keys, n): the distinct words of every block by partition, with their training counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = read_block(row["docs"], row["sizes"], row["words"], row["tokens"])
                n = np.bincount(block.tokens[block.training], minlength=len(block.words)).astype(np.uint64)
                part = parts_of(block.words, parts)
                own = [(p, part == p) for p in np.unique(part)]
                columns = [pa.array([p for p, _ in own], pa.int64()), pa.array([row["block"]] * len(own), pa.string()), *[pa.array(x, pa.binary()) for x in ([pack(block.words[m]) for _, m in own], [pack(n[m]) for _, m in own])]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "keys", "n"])

    return blocks.mapInArrow(lean(run), "part long, block string, keys binary, n binary")


def count_words(b: pd.DataFrame) -> pd.DataFrame:
    """The answers of one partition of the words' table."""
    keys = [unpack(k, np.uint64) for k in b["keys"]]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, np.concatenate([unpack(n, np.uint64) for n in b["n"]]).astype(np.int64))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    rows = [(1, name, int(b["part"].iloc[0]), pack(total[x].astype(np.uint64)), None, None, None) for name, x in zip(b["block"], np.split(at, cuts), strict=True)]
    return pd.DataFrame([*rows, (1, None, int(b["part"].iloc[0]), None, None, None, _stats(total))], columns=ANSWER_NAMES)


# --- longer n-grams


class Grams(NamedTuple):
    """The n-grams of one order in a block. Contexts are the n-grams of the next lower order, and so are the suffixes."""

    at: np.ndarray  # of each token its n-gram, -1 where there are too few tokens before it
    context: np.ndarray  # of each n-gram
    word: np.ndarray
    suffix: np.ndarray
    hash: np.ndarray
    n: np.ndarray  # training counts in the block


def single(block: Block) -> Grams:
    n = len(block.words)
    none = np.empty(0, np.int64)
    return Grams(block.tokens, none, np.arange(n), none, block.words, none)


def longer(block: Block, low: Grams, order: int) -> Grams:
    """n-grams of the given order from those one shorter."""
    first = np.cumsum(block.sizes) - block.sizes
    context = np.concatenate((np.zeros(1, np.int64), low.at[:-1]))
    if order == 2:
        context[first] = 0  # a text begins after an end
    else:
        context[first] = -1  # before it there are too few tokens
    ok = context >= 0
    key, place, at = np.unique(context[ok] << np.int64(32) | block.tokens[ok], return_index=True, return_inverse=True)
    whole = np.full(len(block.tokens), -1, np.int64)
    whole[ok] = at
    n = np.bincount(at[block.training[ok]], minlength=len(key))
    own, word = key >> np.int64(32), key & np.int64(0xFFFFFFFF)
    return Grams(whole, own, word, low.at[ok][place], joined(low.hash[own], block.words[word]), n)


class Dealt(NamedTuple):
    """Into how many partitions the tables are dealt, and how many successors of a context go together."""

    parts: int
    split: int


class Layout(NamedTuple):
    """How a block asks: entries are contexts by partition; n-grams come in the order of their entries."""

    part: np.ndarray  # of each entry
    context: np.ndarray
    runs: np.ndarray  # n-grams of each entry
    grams: np.ndarray

    def pieces(self) -> Iterator[tuple[int, slice, slice]]:
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.runs)))
        for p in np.unique(self.part):
            a, b = np.searchsorted(self.part, (p, p + 1))
            yield int(p), slice(a, b), slice(int(ends[a]), int(ends[b]))


def layout(block: Block, g: Grams, low: Grams, count: np.ndarray, dealt: Dealt) -> Layout:
    """count: training counts of the lower order. What has an unseen context or suffix is unseen and needs no asking."""
    ways = -(-count // dealt.split)

    def part_of(context: np.ndarray, way: np.ndarray) -> np.ndarray:
        return parts_of(low.hash[context] + way.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), dealt.parts)

    seen = np.unique(g.context)
    seen = seen[count[seen] > 0]
    all_ways = np.arange(int(ways[seen].sum())) - np.repeat(np.cumsum(ways[seen]) - ways[seen], ways[seen])
    each = np.repeat(seen, ways[seen])
    size = max(1, len(low.hash))
    entries = np.unique(part_of(each, all_ways) * size + each)
    asked = np.flatnonzero((count[g.context] > 0) & (count[g.suffix] > 0))
    context = g.context[asked]
    way = (block.words[g.word[asked]] >> np.uint64(7)).astype(np.int64) % np.maximum(ways[context], 1)
    at = np.searchsorted(entries, part_of(context, way) * size + context)
    return Layout(entries // size, entries % size, np.bincount(at, minlength=len(entries)), asked[np.argsort(at, kind="stable")])


#: Words are sent once for each partition asked, and n-grams as places among them.
ASKED = "part long, block string, contexts binary, runs binary, words binary, word binary, n binary, low binary"


def asked_of(name: str, block: Block, g: Grams, low: Grams, count: np.ndarray, dealt: Dealt, order: int, turn: int, turns: int) -> list[tuple]:
    lay, out = layout(block, g, low, count, dealt), []
    for p, entries, grams in lay.pieces():
        if p % turns == turn:
            own = lay.grams[grams]
            words, word = np.unique(g.word[own], return_inverse=True)
            below = count[g.suffix[own]]
            if order == 2:  # the suffix is the word
                below = count[words]
            arrays = (low.hash[lay.context[entries]], lay.runs[entries].astype(np.uint32), block.words[words], word.astype(np.uint32), g.n[own].astype(np.uint32), below.astype(np.uint64))
            out.append((p, name, *(pack(x) for x in arrays)))
    return out


def _classes(at: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """(size, CUTOFF + 1): for each place how many of the counts there are 1, .., CUTOFF, and the sum of the larger ones."""
    own = (c > 0) & (c <= CUTOFF)
    out = np.bincount(at[own] * (CUTOFF + 1) + c[own] - 1, minlength=size * (CUTOFF + 1)).reshape(size, CUTOFF + 1)
    out[:, CUTOFF] = np.bincount(at[c > CUTOFF], weights=c[c > CUTOFF], minlength=size)  # exact, as sums stay below 2**53
    return out


def count_grams(level: int):
    """The answers of one partition of a table: of each n-gram asked for its training count; and of the contexts whose seen
    successors the block doesn't have all, the counts of the others and of their suffixes, by class."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        release()
        contexts = [unpack(x, np.uint64) for x in b["contexts"]]
        runs = [unpack(x, np.uint32).astype(np.int64) for x in b["runs"]]
        sizes = np.array([int(r.sum()) for r in runs])
        own, entry = np.unique(np.concatenate(contexts), return_inverse=True)
        context = np.repeat(entry, np.concatenate(runs))
        word = [unpack(x, np.uint32) for x in b["word"]]
        words = np.concatenate([unpack(x, np.uint64)[w] for x, w in zip(b["words"], word, strict=True)])
        n = np.concatenate([unpack(x, np.uint32) for x in b["n"]]).astype(np.int64)
        low = [unpack(x, np.uint64).astype(np.int64) for x in b["low"]]
        low = np.concatenate([x[w] for x, w in zip(low, word, strict=True)] if level == 2 else low)
        order = np.lexsort((words, context))
        sorted_c, sorted_w = context[order], words[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_c[1:] != sorted_c[:-1]) | (sorted_w[1:] != sorted_w[:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        del sorted_w, words
        first = order[new]
        total = np.bincount(at, weights=n, minlength=len(first)).astype(np.int64)
        low = np.where(total > 0, low[first], 0)
        whole = np.hstack((_classes(context[first], total, len(own)), _classes(context[first], low, len(own))))
        rows, e, g = [], 0, 0
        for name, r, size in zip(b["block"], runs, sizes, strict=True):
            mine, entries = at[g : g + size], entry[e : e + len(r)]
            place = np.repeat(np.arange(len(r)), r)
            rest = whole[entries] - np.hstack((_classes(place, total[mine], len(r)), _classes(place, low[mine], len(r))))
            odd = np.flatnonzero(rest.any(axis=1))
            rows.append((level, name, int(b["part"].iloc[0]), pack(total[mine].astype(np.uint32)), pack(odd.astype(np.uint32)), pack(rest[odd].T.ravel().astype(np.uint64)), None))
            e, g = e + len(r), g + size
        return pd.DataFrame([*rows, (level, None, int(b["part"].iloc[0]), None, None, None, _stats(total))], columns=ANSWER_NAMES)

    return run


class Found(NamedTuple):
    """What the tables say of a block's n-grams of one order."""

    count: np.ndarray  # of each n-gram
    factor: np.ndarray  # of each context: a seen n-gram's probability is this times its discounted count
    backoff: np.ndarray  # log10 of each context's weight


class Model(NamedTuple):
    total: int
    distinct: int
    share: float
    unseen: float
    discounts: list[np.ndarray]  # of each order, from 1


def model_of(stats: list[list[int]]) -> Model:
    d = [discounts([0, *s[: CUTOFF + 1]]) for s in stats]
    n, distinct, total = stats[0][: CUTOFF + 1], stats[0][-2], stats[0][-1]
    share, unseen = 1.0, 0.5
    if total:
        mass = (total - sum((1 - d[0][r]) * r * n[r - 1] for r in range(1, CUTOFF + 1))) / total
        share = total / (total + 1.0) if mass >= 1 - 1e-15 else 1.0  # nothing was discounted: one token is set aside
        unseen = 1 - mass * share
    return Model(total, distinct, share, unseen / (distinct + 1), d)


def words_found(block: Block, answers: pd.DataFrame, parts: int) -> np.ndarray:
    """Training counts of the block's words."""
    out, part = np.zeros(len(block.words), np.int64), parts_of(block.words, parts)
    for r in answers[answers["level"] == 1].itertuples(index=False):
        out[part == r.part] = unpack(r.total, np.uint64).astype(np.int64)
    return out


def grams_found(block: Block, answers: pd.DataFrame, level: int, g: Grams, low: Grams, count: np.ndarray, lower: np.ndarray, model: Model, dealt: Dealt) -> Found:
    """lower: of each context the factor of its own suffix as a context of the lower order."""
    lay = layout(block, g, low, count, dealt)
    by = {r.part: r for r in answers[answers["level"] == level].itertuples(index=False)}
    d, d_low = model.discounts[level - 1], model.discounts[level - 2]
    weights = lambda d: np.append(d[1:] * np.arange(1, CUTOFF + 1), 1.0)
    total, mass, under = np.zeros(len(g.context), np.int64), np.zeros(len(count)), np.zeros(len(count))
    for p, entries, grams in lay.pieces():
        total[lay.grams[grams]] = unpack(by[p].total, np.uint32)
        odd = unpack(by[p].odd, np.uint32)
        if len(odd):
            rest = unpack(by[p].other, np.uint64).astype(np.float64).reshape(-1, len(odd))
            np.add.at(mass, lay.context[entries][odd], weights(d) @ rest[: CUTOFF + 1])
            np.add.at(under, lay.context[entries][odd], weights(d_low) @ rest[CUTOFF + 1 :])
    seen = total > 0
    sums = lambda c, d: np.bincount(g.context[seen], weights=discounted(c[seen], d), minlength=len(count))
    mass += sums(total, d)
    under = (under + sums(count[g.suffix], d_low)) * lower
    some = mass > 0
    mass = np.where(some, mass / np.maximum(count, 1), 0.5)
    open_ = 1 - under > 1e-12
    none = open_ & (mass > 1 - 1e-12)  # nothing was discounted: half a token is set aside
    kept = np.where(none, 1 - 0.5 / (count + 0.5), mass)
    scale = np.where(open_, kept / mass, 1 / mass)
    backoff = np.where(open_, (1 - kept) / np.where(open_, 1 - under, 1), 1e-300)
    return Found(total, scale / np.maximum(count, 1), np.where(some, np.log10(backoff), 0.0))


def walk(block: Block, answers: pd.DataFrame, model: Model, dealt: Dealt, order: int, logs_too: bool = True) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray | None]:
    """Climbs to the given order: its n-grams, their counts, the factors of their suffixes' contexts, and the log10 probability
    of every token (if asked for)."""
    low, count = single(block), words_found(block, answers, dealt.parts)
    p = np.where(count > 0, discounted(count, model.discounts[0]) / max(model.total, 1) * model.share, model.unseen)
    logs = np.log10(p)[block.tokens] if logs_too else None
    lower = np.full(len(count), model.share / max(model.total, 1))
    for level in range(2, order + 1):
        g = longer(block, low, level)
        found = grams_found(block, answers, level, g, low, count, lower, model, dealt)
        if logs is not None:
            ok = g.at >= 0
            at = g.at[ok]
            c = found.count
            seen = np.log10(found.factor[g.context] * np.maximum(discounted(c, model.discounts[level - 1]), 1e-300))
            logs[ok] = np.where(c > 0, seen, 0.0)[at] + np.where(c > 0, 0.0, found.backoff[g.context])[at] + np.where(c[at] > 0, 0.0, logs[ok])
        lower = found.factor[g.suffix]  # a longer context's suffix is, less its last word, a context of this order
        low, count = g, found.count
    return low, count, lower, logs


def katz_scores(docs: DataFrame, spark: SparkSession, order: int = ORDER, per_part: int = PER_PART, per_block: int = PER_BLOCK, split: int = SPLIT, turns: int = TURNS) -> DataFrame:
    """Trains on the texts whose doc_id isn't held out and scores all of docs(doc_id, text): one row per row with
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null texts count as empty: their only token is the end. A null doc_id is in training and stays null. Repeated
    rows count as often as they occur. Only doc_id and text are read. No rows: no rows. Without training texts every token has
    the same probability."""
    scratch = Scratch(spark, "katz")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    blocks = scratch.save(encode(plain, per_block), "blocks")
    parts = max(1, -(-int(blocks.agg(F.sum("n")).first()[0] or 0) // per_part))
    dealt = Dealt(parts, split)
    answers = scratch.save(ask_words(blocks, parts).groupBy("part").applyInPandas(count_words, ANSWER), "words")
    columns = ("docs", "sizes", "words", "tokens")

    def stats(table: DataFrame) -> list[int]:
        row = table.where(F.col("block").isNull()).agg(*[F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(CUTOFF + 3)]).first()
        return [int(x or 0) for x in row]

    known = [stats(answers)]
    replies = answers.where(F.col("block").isNotNull())
    for level in range(2, order + 1):
        model = model_of(known)
        many = turns if level == order else 1

        def ask(turn: int, level=level, model=model, many=many):
            def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                release()
                out = []
                for r in left.itertuples(index=False):
                    block = read_block(*(getattr(r, c) for c in columns))
                    low, count, _, _ = walk(block, right, model, dealt, level - 1, logs_too=False)
                    out += asked_of(r.block, block, longer(block, low, level), low, count, dealt, level, turn, many)
                return pd.DataFrame(out, columns=[x.split()[0] for x in ASKED.split(", ")])

            return run

        got = []
        for turn in range(many):
            asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(ask(turn), ASKED)
            got.append(scratch.save(asked.groupBy("part").applyInPandas(count_grams(level), ANSWER), f"grams{level}"))
            scratch.settle()
        table = reduce(DataFrame.unionByName, got)
        known.append(stats(table))
        replies = replies.unionByName(table.where(F.col("block").isNotNull()))

    model = model_of(known)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        release()
        out = []
        for r in left.itertuples(index=False):
            block = read_block(*(getattr(r, c) for c in columns))
            logs = walk(block, right, model, dealt, order)[3]
            count = words_found(block, right, parts)
            text = np.repeat(np.arange(len(block.sizes)), block.sizes)
            total = lambda x, text=text, n=len(block.sizes): np.bincount(text, weights=x, minlength=n)
            base = np.log10((count + 1) / (model.total + model.distinct + 1))
            out.append(pd.DataFrame({
                "doc_id": [None if null else str(i) for i, null in block.ids.tolist()], "n_tokens": block.sizes, "n_known": total((count > 0)[block.tokens].astype(float)).astype(np.int64),
                "base_score": total(base[block.tokens]), "score": total(logs),
            }))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "base_score", "score")})

    found = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(score, "doc_id string, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), spark)
