"""Near-duplicate groups by SimHash in a segment-popcount embedding, checked by the exact Jaccard similarity of shingle sets.

A text is the set of its word shingles; its fingerprint has four 64-bit SimHashes of them. The last two are embedded as in
simhash: the bit counts of their 64 two-bit segments. Every fingerprint goes into 64 grid cells, each of equal counts in
twelve segments. In a cell the Manhattan distance of the embeddings of the first two and then their Hamming distance prune. Sets of
similarity 0.8 differ in 15.2% of the bits (27.3 degrees) at most, so of 128 bits more than RADIUS differ five deviations off; by estimate (cells
taken as independent) a pair that similar meets in some cell in about four of five cases, one of 0.85 in over nine of ten, one of 0.9
nearly always. What is found is verified on whole sets.

What SimHash can miss is then asked for exactly, among the sets it hasn't connected. Shingles are ordered by rarity, counted over
the corpus in 2**20 hash buckets: any global order keeps the join exact, rarity makes it fast. Two sets of similarity t share a shingle among their first
n - ceil(t n) + 1 (prefix filter), so all similar pairs meet in the cell of some shingle. Inside a cell pairs must fit in length
and in the shingles that can still follow the shared one (positional filter); what is left is verified on whole sets.

Equal sets are merged first. Only components are asked for, so each of these steps leaves out the pairs that are connected
already, and of the exact join's cells neighbours are verified before all others: groups of near copies don't make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import connected_components
from .lm import pack, unpack
from .simhash import CHUNK, first_of_groups, segment_counts, unary_counts

BUCKETS = 1 << 20
#: Buckets in one row of the partial counts.
SLICE = 1 << 16
#: Cells whose bucket holds more shingles than this are cut into blocks, every two of which are a unit of work.
BLOCK = 1 << 14
#: Longs of a set's parities.
WORDS = 32
#: Neighbours verified in the first round.
NEIGHBOURS = 2
#: Grid cells of a fingerprint, the segments whose counts make a cell, and the turns in which the cells are made.
CELLS, SEGMENTS, TURNS = 64, 12, 4
#: Differing bits of the first two SimHashes.
RADIUS = 40
#: Of a cell each fingerprint is compared with so many that follow it in order of their bits, until so many links are found.
FOLLOWING, LINKS = 255, 2
FACTORS = np.random.default_rng(42).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Ascending 64-bit hashes of the different word shingles of a UTF-8 text (words as in simhash.fingerprint); with fewer
    than width words the whole sequence is the one shingle; without words there is none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out += hashed[k : k + len(out)] * FACTORS[k]
    out ^= out >> np.uint64(29)
    return np.unique(out * FACTORS[-1])


def prints(s: np.ndarray) -> np.ndarray:
    """Four 64-bit SimHashes of a set of hashes: a bit is set if it is set in over half of them, as remixed for each SimHash."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(s), CHUNK):
        x = s[at : at + CHUNK, None]
        x = (x ^ x >> np.uint64(32)) * FACTORS[None, 10:14]
        x = (x ^ x >> np.uint64(29)) * FACTORS[None, 14:18]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)


def _cell_masks() -> list[tuple[np.uint64, np.uint64]]:
    """For each cell the packed fields of its segments in the embeddings of the last two SimHashes."""
    rng, out = np.random.default_rng(7), []
    for _ in range(CELLS):
        bits = np.zeros(64, np.uint8)
        bits[rng.choice(64, SEGMENTS, replace=False)] = 1
        out.append(tuple(np.packbits(bits.repeat(2), bitorder="little").view(np.uint64)))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))


def rarity(texts: DataFrame, width: int) -> np.ndarray:
    """One byte for each hash bucket: a class of how many shingles of the corpus fall into it; class c means fewer than
    2 ** ((c + 1) / 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(total, (shingle_set(t, width) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        cuts = range(0, BUCKETS, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([pack(total[a : a + SLICE]) for a in cuts], pa.binary())], ["at", "n"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for x in b["n"]:
            total += unpack(x, np.int64)
        return pd.DataFrame({"at": b["at"].iloc[:1], "c": [np.minimum(126, 4 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()]})

    out = np.zeros(BUCKETS, np.uint8)
    for r in texts.select("text").mapInArrow(lean(run), "at int, n binary").groupBy("at").applyInPandas(add, "at int, c binary").collect():  # a byte for each bucket
        out[r.at : r.at + SLICE] = np.frombuffer(r.c, np.uint8)
    return out


def _sets(texts: DataFrame, classes, width: int, t: Fraction) -> DataFrame:
    """(doc_id, text_hash, k, n, prefix, p0 .. p3): key and size of each text's set, the codes of its prefix in the global
    order, and its SimHashes."""
    schema = "doc_id long, text_hash long, k long, n int, prefix array<long>, p0 long, p1 long, p2 long, p3 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for b in batches:
            keys, sizes, prefixes, marks = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, width)
                n = len(s)
                code = table[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                keys.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                sizes.append(n)
                marks.append(prints(s).view(np.int64))
                prefixes.append(np.sort(code)[: n - -(-n * t.numerator // t.denominator) + 1 if n else 0].view(np.int64))
            k = np.array(keys, np.uint64).view(np.int64)
            p = [pa.array(x) for x in np.array(marks, np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), *p], names)

    return texts.mapInArrow(lean(run), schema)


def _linked(marks: DataFrame, turn: int) -> DataFrame:
    """(k, k_): pairs of marks(k, p0, .. p3) that share a grid cell of this turn and whose first two SimHashes differ in
    RADIUS bits or fewer."""
    masks = _cell_masks()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, p0, p1, p2, p3 = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            low, high = segment_counts(p2.view(np.uint64)), segment_counts(p3.view(np.uint64))
            for at in range(turn, CELLS, TURNS):
                cell = (low & masks[at][0]) * FACTORS[20] + (high & masks[at][1]) * FACTORS[21] + np.full(1, at, np.uint64) * FACTORS[22]
                cell = (cell ^ cell >> np.uint64(29)) * FACTORS[23]
                yield _record([cell.view(np.int64), p0, p1, k], ["cell", "p0", "p1", "k"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for b in batches:
            now = [np.concatenate((x, c.to_numpy(zero_copy_only=False))) for x, c in zip(held, b.columns, strict=True)]
            cell, k, bits = now[0], now[3], [x.view(np.uint64) for x in now[1:3]]
            counts = [unary_counts(x) for x in bits]
            apart = lambda words, i, j: sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words)
            i, got, us, vs = np.arange(len(cell)), np.zeros(len(cell), np.int32), [], []
            for step in range(1, FOLLOWING + 1):
                i = i[i + step < len(cell)]
                i = i[(cell[i] == cell[i + step]) & (got[i] < LINKS)]
                if not len(i):
                    break
                ok = i[apart(counts, i, i + step) <= RADIUS]
                ok = ok[apart(bits, ok, ok + step) <= RADIUS]
                got[ok] += 1
                us.append(k[ok])
                vs.append(k[ok + step])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield _record([np.minimum(u, v), np.maximum(u, v)], ["k", "k_"])
            held = [x[-FOLLOWING:] for x in now]

    cells = marks.select("k", "p0", "p1", "p2", "p3").mapInArrow(lean(deal), "cell long, p0 long, p1 long, k long")
    found = cells.repartition("cell").sortWithinPartitions("cell", "p0", "p1", "k").mapInArrow(lean(near), "k long, k_ long")
    return found.where("k <> k_").distinct()


def _runs(df: DataFrame, name: str, found, schema: str) -> DataFrame:
    """found(columns) for whole runs of equal values of the first column, each batch of which is sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last run may go on in the next batch
            if cut:
                yield from found([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield from found(held)

    return df.repartition(name).sortWithinPartitions(*df.columns).mapInArrow(lean(run), schema)


def _record(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _shared(sets: DataFrame, block: int) -> DataFrame:
    """(unit, n, k, pos): the postings of cells that at least two sets are in."""
    posts = sets.select("k", "n", "prefix").dropDuplicates(["k"]).select("k", "n", F.posexplode("prefix").alias("pos", "code"))
    many = F.pow(F.lit(2.0), (F.shiftrightunsigned("code", 56) + 1) / 4)
    blocks = F.ceil(many / block).cast("long")
    mine = F.pmod(F.xxhash64("k", F.lit(7)), blocks)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.least(mine, o) * blocks + F.greatest(mine, o))
    unit = F.when(blocks <= 1, F.array("code")).otherwise(F.transform(pair, lambda p: F.xxhash64("code", p)))
    rows = posts.select(F.explode(unit).alias("unit"), "n", "k", F.col("pos").cast("int").alias("pos"))

    def several(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        same = c[0][1:] == c[0][:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        yield _record([x[keep] for x in c], ["unit", "n", "k", "pos"])

    return _runs(rows, "unit", several, "unit long, n int, k long, pos int")


def _candidates(shared: DataFrame, t: Fraction, neighbours: int | None) -> DataFrame:
    """(k, k_): pairs of a unit that fit and have different roots; with neighbours only the nearest so many in order of size.

    shared: unit, n, k, pos, root."""
    a, b = t.numerator, t.denominator

    def found(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        unit, n, k, pos, root = c[0], c[1].astype(np.int64), c[2], c[3].astype(np.int64), c[4]
        new = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        end = np.repeat(np.concatenate((new[1:], [len(unit)])), np.diff(np.concatenate((new, [len(unit)]))))
        i, step, us, vs, held = np.arange(len(unit)), 0, [], [], 0

        def out() -> pa.RecordBatch:
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
            return _record([pairs[0], pairs[1]], ["k", "k_"])

        while len(i) and (neighbours is None or step < neighbours):
            step += 1
            i = i[i + step < end[i]]
            i = i[n[i] * b >= n[i + step] * a]  # sizes ascend, so what is too long now stays so
            j = i + step
            ok = (root[i] != root[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) * (a + b) >= a * (n[i] + n[j]))
            us.append(k[i[ok]])
            vs.append(k[j[ok]])
            held += int(ok.sum())
            if held > 1 << 20:
                yield out()
                us, vs, held = [], [], 0
        if held:
            yield out()

    return _runs(shared.select("unit", "n", "k", "pos", "root"), "unit", found, "k long, k_ long").distinct()


def parities(s: np.ndarray) -> np.ndarray:
    """64 * WORDS bits, each the parity of how many elements have it as their lowest bits: two sets differ in at least as many
    elements as their parities in bits."""
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: Scratch, width: int, t: Fraction) -> DataFrame:
    """(u, v): the pairs whose whole sets have similarity t or more. Pairs that differ in more parities than similar sets can
    are left out first, so whole sets travel with few others."""
    asked = pairs.select("k").union(pairs.select("k_")).distinct()
    rows = sets.join(asked, "k", "left_semi").groupBy("k", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("k").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("f"))
    first = scratch.save(first.select("k", F.col("f.doc_id").alias("_d"), F.col("f.text_hash").alias("_t"), F.col("f.rows").alias("rows")), "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):  # bounds what is held at once
                own = [shingle_set(x, width) for x in b.column(1)[at : at + 1024].to_pylist()]
                marks = pa.array([parities(x) for x in own], pa.list_(pa.int64()))
                whole = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 1024], pa.array([len(x) for x in own], pa.int32()), marks, whole], ["k", "n", "marks", "s"])

    chosen = texts.join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")))
    schema = "k long, n int, marks array<long>, s array<long>"
    whole = chosen.where("rows = 1").select("k", "text").mapInArrow(lean(run), schema)
    if not first.where("rows > 1").isEmpty():  # repeated rows, of which one is enough
        whole = whole.union(chosen.where("rows > 1").select("k", "text").dropDuplicates(["k"]).mapInArrow(lean(run), schema))
    whole = scratch.save(whole, "whole")

    def twin(*names: str) -> DataFrame:
        return whole.select(*[F.col(c).alias(f"{c}_") for c in ("k", *names)])

    differ = F.aggregate(F.zip_with("marks", "marks_", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    a, b = t.numerator, t.denominator
    likely = pairs.join(whole.select("k", "n", "marks"), "k").join(twin("n", "marks"), "k_").where((F.col("n") + F.col("n_") - differ) * (a + b) >= (F.col("n") + F.col("n_")) * (2 * a))
    likely = scratch.save(likely.select("k", "k_"), "likely")
    both = likely.join(whole.select("k", "s"), "k").join(twin("s"), "k_")
    enough = F.size(F.array_intersect("s", "s_")) * (a + b) >= (F.size("s") + F.size("s_")) * a
    out = scratch.save(both.where(enough).select(F.col("k").alias("u"), F.col("k_").alias("v")), "similar")
    for table in (first, whole, likely):
        scratch.drop(table)
    return out


def similar_groups(docs: DataFrame, spark: SparkSession, width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, root long): components of the graph that links texts whose sets of word shingles have the given
    Jaccard similarity or more; root names the component. One row per row of docs; text_hash is xxhash64 of the text.

    Null and empty texts have an empty set and are one group; a null doc_id is a value like any other. Only doc_id and
    text are read. No rows: no rows."""
    t = Fraction(similarity).limit_denominator(1000)
    scratch, texts = Scratch(spark, "similar"), _texts(docs)
    classes = spark.sparkContext.broadcast(rarity(texts, width))
    sets = scratch.save(_sets(texts, classes, width, t), "sets")
    marks = scratch.save(sets.where("n > 0").select("k", "p0", "p1", "p2", "p3").dropDuplicates(["k"]), "marks")
    turns = [scratch.save(_linked(marks, turn), "linked") for turn in range(TURNS)]
    linked = scratch.save(reduce(DataFrame.union, turns).distinct(), "linked")
    edges = _verified(linked, sets, texts, scratch, width, t)
    for table in (marks, *turns, linked):
        scratch.drop(table)
    roots = scratch.save(connected_components(edges, scratch), "roots")

    # What SimHash missed: neighbours first, then all.
    shared = scratch.save(_shared(sets, block), "shared")
    for neighbours in (NEIGHBOURS, None):
        known = shared.join(roots, shared["k"] == roots["node"], "left").withColumn("root", F.coalesce("root", "k"))
        pairs = scratch.save(_candidates(known, t, neighbours), "missed")
        edges = edges.union(_verified(pairs, sets, texts, scratch, width, t))
        roots = scratch.save(connected_components(edges, scratch), "roots")
        scratch.drop(pairs)
    scratch.drop(shared)
    return sets.join(roots, sets["k"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "k").alias("root"))


def one_of_each_group(docs: DataFrame, spark: SparkSession, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar texts, chosen as in simhash.one_of_each_group."""
    return first_of_groups(docs, similar_groups(docs, spark, width, similarity), Scratch(spark, "keep"))
