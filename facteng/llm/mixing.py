"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into permuted blocks of their source (a seeded hash of doc_id). A source's target buys a number
of block draws: whole epochs, then distinct blocks until the target is met as nearly as blocks allow. The tree
halves the range of output shards again and again; at each node the exact draws of every source are
split by one multivariate hypergeometric draw, so shards get random shares that add up exactly. Every
leaf then takes its quota as a disjoint piece of the source's permuted draws, and rows of a shard are ordered by a
hash (the local shuffle). Only the table of blocks (at most blocks rows for each source) is planned on the driver.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, documents, maybe_broadcast, replace_columns, text_or_empty

#: Weights of the sources in order of code points (null last), repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)


class Plan(NamedTuple):
    sources: pd.DataFrame  # source, source_size, target, taken (words)
    draws: pd.DataFrame  # source, block, epoch, shard


def word_count(name: str = "text") -> Column:
    """Words of a text as a long; null and empty texts have none."""
    return F.size(F.array_remove(F.split(text_or_empty(name), SPACE_CLASS), "")).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 3.0) -> list[float]:
    """Shares total by weight; a target stops at most times its size, and the excess is shared by weight again
    among the others until none is above."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def block_column(blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(blocks)).cast("int")


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): the exact quotas of the leaves, whose columns add up to quota."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    total = int(quota.sum())
    got = rng.multivariate_hypergeometric(quota, round(total * left / shards), method="marginals")
    return np.concatenate((split(got, left, rng), split(quota - got, shards - left, rng)))


def plan(table: pd.DataFrame, weights: tuple[float, ...], shards: int, seed: int, most: float) -> Plan:
    """table: source, block, words, one row for each block that has documents."""
    names = sorted({s for s in table["source"] if s is not None}) + [None] * int(table["source"].isna().any())
    by = {s: g for s, g in table.groupby("source", dropna=False, sort=False)}
    groups = [by[s] if s is not None else table[table["source"].isna()] for s in names]
    sizes = [int(g["words"].sum()) for g in groups]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(sizes), most)
    rng = np.random.default_rng(seed)
    drawn, taken = [], []
    for s, g, size, t in zip(names, groups, sizes, goal, strict=True):
        own = np.random.default_rng([seed, zlib.crc32(repr(s).encode())])
        block, words = (g.sort_values("block")[c].to_numpy(np.int64) for c in ("block", "words"))
        order = own.permutation(len(block))
        whole = min(int(t // size), int(most)) if size else 0
        some, got = [], whole * size
        if whole < most:
            for i in order:  # a block is drawn if it brings the words nearer to the target
                if words[i] and abs(got + words[i] - t) < abs(got - t):
                    some.append(i)
                    got += int(words[i])
        blocks = np.concatenate([own.permutation(block) for _ in range(whole)] + [block[np.array(some, dtype=np.int64)]])
        epochs = np.concatenate([np.full(len(block), e) for e in range(whole)] + [np.full(len(some), whole)])
        drawn.append((blocks.astype(np.int64), epochs.astype(np.int64)))
        taken.append(got)
    leaves = split(np.array([len(b) for b, _ in drawn], dtype=np.int64), shards, rng) if names else np.zeros((shards, 0), np.int64)
    rows = []
    for k, (s, (blocks, epochs)) in enumerate(zip(names, drawn, strict=True)):
        ends = np.cumsum(leaves[:, k])
        for shard, (a, b) in enumerate(zip(ends - leaves[:, k], ends, strict=True)):  # each leaf takes its piece of the draws
            if b > a:
                rows.append(pd.DataFrame({"source": pd.Series([s] * (b - a), dtype=object), "block": blocks[a:b], "epoch": epochs[a:b], "shard": shard}))
    draws = pd.concat(rows) if rows else pd.DataFrame({"source": [], "block": [], "epoch": [], "shard": []})
    return Plan(pd.DataFrame({"source": pd.Series(names, dtype=object), "source_size": sizes, "target": goal, "taken": taken}), draws)


def _plan_for(sized: DataFrame, weights, shards, blocks, seed, most) -> Plan:
    table = sized.groupBy("source", "block").agg(F.sum("size").alias("words")).toPandas()
    table["source"] = table["source"].astype(object).where(table["source"].notna(), None)
    return plan(table, weights, shards, seed, most)


def _frame(spark: SparkSession, data: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame(list(data.itertuples(index=False, name=None)), schema)


def mix(
    docs: DataFrame, spark: SparkSession, weights: tuple[float, ...] = WEIGHTS, shards: int = 64, blocks: int = 1024, seed: int = 17, most: float = 3.0
) -> DataFrame:
    """The rows of docs that the mix draws, once for each draw, with shard and epoch int and order_key long, ordered by
    (shard, order_key). Reading a shard in that order is a random permutation of it.

    Null texts have no words; blocks without words are never drawn in a partial epoch. Null sources form one source that
    comes last; a null doc_id falls into one fixed block; repeated rows are drawn together. Columns of
    docs named like the three new ones are replaced. No rows: no rows."""
    sized = docs.select("source", word_count().alias("size"), block_column(blocks, seed).alias("block"))
    found = _plan_for(sized, weights, shards, blocks, seed, most)
    new = ["shard", "epoch", "order_key"]
    plain = replace_columns(docs, new)
    drawn = _frame(spark, found.draws, "_s string, _b int, epoch int, shard int")
    drawn = maybe_broadcast(drawn, len(found.draws), 64)
    key = plain["source"].eqNullSafe(drawn["_s"]) & (block_column(blocks, seed) == drawn["_b"])
    out = plain.join(drawn, key).select(*[plain[c] for c in plain.columns], "shard", "epoch")
    out = out.withColumn("order_key", F.xxhash64(F.lit(seed), "shard", "epoch", F.col("doc_id").cast("string")))
    return out.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")


def op3_mix_sources(spark: SparkSession, sf_dir: str, blocks: int = 1024, shards: int = 64, seed: int = 17) -> DataFrame:
    """One row for each row of documents; shards: the shards of the mix that draw it, ascending, one for each draw. taken
    counts these draws. Nulls, ties and repeated rows are treated as in mix; a source's name is compared exactly."""
    scratch = Scratch(spark, "mix")
    sized = scratch.save(
        documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"), block_column(blocks, seed).alias("block")), "sized"
    )
    found = _plan_for(sized, WEIGHTS, shards, blocks, seed, 3.0)
    leaves = found.draws.groupby(["source", "block"], dropna=False)["shard"].agg(lambda x: sorted(int(k) for k in x)).reset_index(name="shards")
    leaves["source"] = leaves["source"].astype(object).where(leaves["source"].notna(), None)
    drawn = maybe_broadcast(_frame(spark, leaves, "_s string, _b int, shards array<int>"), len(leaves), 96)
    about = maybe_broadcast(_frame(spark, found.sources[["source", "source_size", "target"]], "_n string, source_size long, target double"), len(found.sources), 64)
    times = F.coalesce(F.size("shards"), F.lit(0))
    return (
        sized.join(drawn, sized["source"].eqNullSafe(drawn["_s"]) & (sized["block"] == drawn["_b"]), "left")
        .join(about, sized["source"].eqNullSafe(about["_n"]))
        .select("doc_id", "size", "source_size", "target", F.when(F.col("shards").isNull(), 0).otherwise(F.col("size") * times).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    )
