"""SimHash near-duplicate groups by a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance
of two embeddings never exceeds the Hamming distance of the fingerprints, so it is a lower bound. The
segments form six bands. Within Hamming distance 4 at most four bands differ, so at least two of the six have
equal counts: every fingerprint goes into the grid cells of its 15 pairs of bands, and linked
fingerprints always share a cell. Inside a cell the range condition (Manhattan distance of the embeddings
over all 32 segments at most the radius) prunes, and the exact Hamming distance decides.

Only distinct fingerprints enter the join. A cell with many of them is cut into blocks of bounded size, and
every pair of blocks is a unit of work of its own, so no cell is gathered in one task. A unit reports a
spanning forest of its links, never all its pairs; components of the forests are components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, lean
from .components import connected_components

#: Segments in each of the six bands (32 in all), as (first segment, segments).
BANDS = ((0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 5))
PAIRS = tuple(combinations(range(len(BANDS)), 2))
ODD = np.uint64(0x5555555555555555)
#: Shingles hashed and counted at once, which bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text (A-Z lower-cased, words as runs without ASCII white
    space). Repeated shingles count as often as they occur; with fewer than width words the whole sequence is the
    one shingle; without words the result is 0. A bit is set if it is set in over half the shingle hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= width:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: n - width + 1], ends[width - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        cut = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in cut], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp long): one row per row of docs, null texts as empty ones. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", width) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text"), F.col("text").cast("string").cast("binary"))
    return plain.mapInArrow(lean(run), "doc_id long, text_hash long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding, packed: 32 two-bit fields that each hold the bit count of a two-bit segment."""
    return (fp & ODD) + ((fp >> np.uint64(1)) & ODD)


def _band_mask(band: int) -> int:
    first, n = BANDS[band]
    return ((1 << 2 * n) - 1) << 2 * first


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding with each count of 0, 1 or 2 written as 00, 01 or 11: the Manhattan distance of two embeddings over all
    32 segments is the number of differing bits."""
    low, high = fp & ODD, (fp >> np.uint64(1)) & ODD
    return low | high | (low & high) << np.uint64(1)


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, pair, cell): every fingerprint in its 15 grid cells, by built-in expressions."""
    odd = F.lit(int(ODD.astype(np.int64)))
    low, high = F.col("fp").bitwiseAND(odd), F.shiftrightunsigned("fp", 1).bitwiseAND(odd)
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # their sum; + would overflow
    masks = [np.uint64(_band_mask(a) | _band_mask(b)).astype(np.int64) for a, b in PAIRS]
    cells = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("pair"), F.col("_c").bitwiseAND(F.lit(int(m))).alias("cell")) for k, m in enumerate(masks)])
    return fps.select("fp", counts.alias("_c")).select("fp", F.inline(cells))


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among fp (distinct values): whoever is not yet reached is compared with
    one reached value at a time. Pruned by the Manhattan distance of the embeddings, verified exactly."""
    n = len(fp)
    left, counts = np.arange(n), unary_counts(fp)
    out_u, out_v, queue = [], [], []
    while queue or len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        near = left[np.bitwise_count(counts[left] ^ counts[at]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[at]) <= radius]
        if len(near):
            out_u.append(np.full(len(near), at))
            out_v.append(near)
            queue.extend(near.tolist())
            left = np.setdiff1d(left, near, assume_unique=True)
    if not out_u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_u), np.concatenate(out_v)


def _reduce(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least reachable node) of the given links, at most one for each node."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            keep = label != np.arange(len(nodes))
            return nodes[keep], nodes[label[keep]]


#: Units of up to so many fingerprints are compared together, vectorised over units.
SMALL = 256


def links_of_units(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, reduced to forests. key and fp are sorted by (key, fp)."""
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((new, [len(key)])))
    us, vs = [], []
    counts = unary_counts(fp)
    mine = np.repeat(size, size)
    place = np.arange(len(key)) - np.repeat(new, size)
    for step in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((mine <= SMALL) & (place + step < mine))
        if not len(i):
            break
        j = i + step
        ok = np.bitwise_count(counts[i] ^ counts[j]) <= radius
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        if ok.any():
            us.append(fp[i[ok]])
            vs.append(fp[j[ok]])
            if sum(map(len, us)) > 1 << 20:
                u, v = _reduce(np.concatenate(us), np.concatenate(vs))
                us, vs = [u], [v]
    for k in np.flatnonzero(size > SMALL):
        part = np.unique(fp[new[k] : new[k] + size[k]])
        u, v = _forest(part, radius)
        us.append(part[u])
        vs.append(part[v])
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _reduce(np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Forest edges (u, v) whose components are those of all pairs of fps.fp within radius (at most 4) bits.

    fps: distinct fingerprints in a column fp long. block: most fingerprints of a cell in one block."""
    if not 0 <= radius <= len(BANDS) - 2:
        raise ValueError("two equal bands are guaranteed for a radius of 0 to 4 only")
    cells = _cells(fps)
    # A cell's number of blocks; cells of one block or fewer than two members need no entry.
    large = cells.groupBy("pair", "cell").count().where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block))
    dealt = cells.join(large.drop("count"), ["pair", "cell"], "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    units = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    )
    rows = dealt.select("pair", "cell", "fp", F.explode(units).alias("unit")).select(F.xxhash64("pair", "cell", "unit").alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = links_of_units(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            key = np.concatenate((held_key, b.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((held_fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last unit may go on in the next batch
            if cut:
                yield found(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            yield found(held_key, held_fp)

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(run), "u long, v long")


def near_duplicates(docs: DataFrame, spark: SparkSession, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp long, root long, component_id): components of the graph that links fingerprints at radius or
    fewer differing bits. component_id is the least doc_id of the component, root its least fingerprint as a signed number;
    text_hash is xxhash64 of the text.

    One row per row of docs (repeated rows stay repeated). Null or empty texts have fingerprint zero and are
    linked like any other. A null doc_id stays null; a component has a null id only if all its rows have. Only doc_id and
    text are read, so further columns of any name do no harm. No rows: no rows."""
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs, width), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = scratch.save(links(distinct.select("fp"), radius).distinct(), "links")
    roots = connected_components(edges, scratch)
    member = roots.join(distinct, roots["node"] == distinct["fp"]).select("node", "root", "least")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.save(member.select("node", "root").join(least, "root").select("node", "root", "component"), "named")
    own = distinct.join(named, distinct["fp"] == named["node"], "left").select(
        distinct["fp"].alias("_fp"), F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id")
    )
    return fps.join(own, fps["fp"] == own["_fp"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, spark: SparkSession, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs for each near-duplicate group, columns and values unchanged: the one with the least doc_id (null
    last), of several texts with that doc_id the one of the least hash, of repeated rows any single one."""
    return first_of_groups(docs, near_duplicates(docs, spark, width, radius), Scratch(spark, "keep"))


def first_of_groups(docs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """The row of docs that stays of each group; groups: root, doc_id, text_hash for every row of docs."""
    found = groups.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("k")
    kept = scratch.save(found.groupBy("root").agg(first).select(F.col("k.doc_id").alias("_d"), F.col("k.text_hash").alias("_t"), F.col("k.n").alias("_n")), "kept")
    joined = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(kept["_d"]) & (F.xxhash64(docs["text"]) == kept["_t"]))
    single = joined.where(kept["_n"] == 1).select(*[docs[c] for c in docs.columns])
    if kept.where("_n > 1").isEmpty():
        return single
    again = joined.where(kept["_n"] > 1).select(*[docs[c] for c in docs.columns], kept["_d"].alias("_kd"), kept["_t"].alias("_kt"))
    return single.unionByName(again.dropDuplicates(["_kd", "_kt"]).drop("_kd", "_kt"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), spark)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
