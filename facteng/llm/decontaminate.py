"""Benchmark decontamination by SimHash of item-sized windows, in built-in expressions only.

A window of a document has as many words as an item. Windows and items are fingerprinted by SimHash over their word
shingles, and candidates are all pairs within a Hamming radius: eight blocks of eight bits cannot all
differ by more than an eighth of the radius, so each item is indexed under all near values of each block and a
window looks up its own values; nothing within the radius is missed. Candidates are verified by the exact
weighted Jaccard similarity of their shingles (shingles weigh as often as they occur).

Windows that share no shingle with any item of their size have similarity zero and aren't fingerprinted. Repeated shingles
are numbered by occurrence before they are fingerprinted, which turns the weighted similarity into that of plain sets: so with five
words, a similarity of 0.8 leaves an angle of at most 27 degrees between the two sums behind the fingerprints, that is
9.7 differing bits expected with a deviation of 2.9; the default radius of 24 lies five deviations above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, documents, maybe_broadcast
from .native_text import hashes, numbered, overlap, repeats, shingles, simhash, words

BLOCKS = 8


def _byte(fp, k):
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _items(bench: DataFrame, width: int) -> DataFrame:
    """(item_id, w, m, sh): words of a shingle (fewer if the item has fewer), shingles and their number."""
    base = bench.select(F.col("item_id"), hashes(words(F.col("text"))).alias("_h")).where(F.size("_h") > 0)
    w = F.least(F.size("_h"), F.lit(width))
    sh = F.coalesce(*[F.when(w == k, shingles(F.col("_h"), k)) for k in range(1, width + 1)])
    return base.select("item_id", w.alias("w"), sh.alias("sh")).withColumn("m", F.size("sh"))


def contaminated(docs: DataFrame, bench: DataFrame, spark: SparkSession, width: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start, windows): every pair of a document and an item with a window of at
    least the given similarity: the best similarity, the word at which the first best window starts, and the number of
    such windows. A document shorter than an item is compared whole.

    Null and empty texts, documents or items, match nothing. Items with fewer than width words have one
    shingle, the whole item. Repeated rows of a document give one row; a null doc_id is a value like any other. Empty
    tables give an empty result. Other columns aren't read."""
    scratch = Scratch(spark, "leaks")
    items = scratch.save(_items(bench, width), "items")
    n_items, n_sh, longest = items.agg(F.count(F.lit(1)), F.sum("m"), F.max("m")).first()
    n_sh, planes = int(n_sh or 0), max(1, int(longest or 0).bit_length())
    widths = [r.w for r in items.select("w").distinct().collect()]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = [_for_width(own, items.where(F.col("w") == w), scratch, w, n_items, n_sh, planes, similarity, radius) for w in sorted(widths)]
    if not found:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, similarity double, start long, windows long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _for_width(own: DataFrame, items: DataFrame, scratch: Scratch, w: int, n_items: int, n_sh: int, planes: int, similarity: float, radius: int) -> DataFrame:
    # Places where a document has a shingle of an item, for each size of item that has it.
    marks = maybe_broadcast(items.select(F.explode("sh").alias("h"), "m").distinct(), n_sh, 32)
    sh = shingles(F.col("_w"), w)
    placed = own.select("doc_id", "text_hash", hashes(words(F.col("text"))).alias("_w")).select("doc_id", "text_hash", F.size("_w").alias("n"), F.posexplode(sh).alias("p", "h"))
    hits = placed.join(marks, "h").select("doc_id", "text_hash", (F.col("n") - w + 1).alias("s"), "m", "p").distinct()
    # A hit at p lies in the windows that start at p - m + 1 to p; the hit before has dealt with some of them.
    before = F.lag("p").over(Window.partitionBy("doc_id", "text_hash", "m").orderBy("p"))
    low = F.greatest(F.col("p") - F.col("m") + 1, F.coalesce(before + 1, F.lit(0)), F.lit(0))
    high = F.least(F.col("p"), F.greatest(F.col("s") - F.col("m"), F.lit(0)))
    # A text shorter than the item has one window, whole; only its first hit may name it.
    ranges = hits.select("doc_id", "text_hash", "m", F.when(F.col("s") <= F.col("m"), F.when(before.isNull(), 0)).otherwise(low).alias("low"), high.alias("high"))
    ranges = ranges.where("low <= high").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("m", "low", "high")).alias("ranges"))
    ranges = scratch.save(ranges, "ranges")
    n_docs, n_ranges = ranges.agg(F.count(F.lit(1)), F.sum(F.size("ranges"))).first()
    few = maybe_broadcast(ranges.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_hash", "_t"), int(n_docs) + int(n_ranges or 0), 48)

    inside = own.join(few, own["doc_id"].eqNullSafe(few["_d"]) & (own["text_hash"] == few["_t"])).select("doc_id", "text_hash", "ranges", hashes(words(F.col("text"))).alias("_w"))
    inside = inside.select("doc_id", "text_hash", "ranges", sh.alias("sh")).withColumn("rep", repeats(F.col("sh")))
    cut = lambda r: F.transform(F.sequence(r["low"], r["high"]), lambda s: F.struct(r["m"].alias("m"), s.alias("s"), F.slice(F.col("sh"), s + 1, r["m"]).alias("ws")))
    windows = inside.select("doc_id", "text_hash", "rep", F.inline(F.flatten(F.transform("ranges", cut))))
    again = F.col("rep") & repeats(F.col("ws"))  # hardly any text repeats a shingle, and the others need no look at each window
    windows = windows.select("doc_id", "text_hash", "m", "s", "ws", simhash(F.when(again, numbered(F.col("ws"))).otherwise(F.col("ws")), planes).alias("fp"))

    # Items under every value of each block that is near enough; windows under their own.
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), lambda v: F.bit_count(v) <= radius // BLOCKS)
    coded = items.select("item_id", "m", simhash(numbered(F.col("sh")), planes).alias("ifp"))
    at = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    coded = coded.select("*", at.alias("b")).select("item_id", "m", "ifp", "b", F.explode(F.transform(near, lambda v: v.bitwiseXOR(F.element_at(F.array(*[_byte(F.col("ifp"), k) for k in range(BLOCKS)]), F.col("b") + 1)))).alias("value"))
    coded = maybe_broadcast(coded, n_items * BLOCKS * 93, 56)
    keyed = windows.select("*", F.posexplode(F.array(*[_byte(F.col("fp"), k) for k in range(BLOCKS)])).alias("b", "value"))
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = F.lit(True)  # a pair counts in the first block that finds it
    for k in range(BLOCKS - 1):
        first = first & ((F.col("b") <= k) | (F.bit_count(_byte(differ, k)) > radius // BLOCKS))
    pairs = keyed.join(coded, ["m", "b", "value"]).where((F.bit_count(differ) <= radius) & first)
    exact = maybe_broadcast(items.select("item_id", F.col("sh").alias("ish")), n_items + n_sh, 24)
    shared = overlap(F.col("ws"), F.col("ish"))
    scored = pairs.join(exact, "item_id").withColumn("_o", shared).withColumn("similarity", F.col("_o") / (F.size("ws") + F.size("ish") - F.col("_o")))
    hit = scored.where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("s")).alias("back")))
    return (
        hit.groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("_b"), F.countDistinct("s").alias("windows"))
        .select("doc_id", "text_hash", "item_id", F.col("_b.similarity").alias("similarity"), (-F.col("_b.back")).cast("long").alias("start"), "windows")
    )


def keep_clean(docs: DataFrame, bench: DataFrame, spark: SparkSession, **parameters) -> DataFrame:
    """The rows of docs without any contaminated window, columns and values unchanged; repeated rows share their fate."""
    found = Scratch(spark, "leaked").save(contaminated(docs, bench, spark, **parameters).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "ids")
    bad = maybe_broadcast(found, found.count(), 24)
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pair of a document and an item with a similar window; null, empty, repeated and missing rows as in
    contaminated()."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "windows")


#: The same by brute force: every window of an item's size, multisets of shingles compared.
OP9_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), bs AS (
  SELECT item_id, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS sh
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i FROM b WHERE len(w) > 0)
), bc AS (SELECT item_id, k, m, sh, count(*) AS c FROM bs GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (
  SELECT doc_id, k, len(w) - k + 1 AS s_max, i - 1 AS p, array_to_string(w[i : i + k - 1], ' ') AS sh
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)
), hits AS (SELECT ds.doc_id, ds.k, s_max, p, item_id, m, ds.sh, c FROM ds JOIN bc ON ds.k = bc.k AND ds.sh = bc.sh),
placed AS (
  SELECT doc_id, item_id, m, least(m, s_max) AS size, sh, c, unnest(generate_series(greatest(p - m + 1, 0), least(p, greatest(s_max - m, 0)))) AS s FROM hits
), common AS (SELECT doc_id, item_id, m, size, s, sh, least(count(*), any_value(c)) AS o FROM placed GROUP BY ALL),
scored AS (SELECT doc_id, item_id, s, sum(o) / (size + m - sum(o)) AS sim FROM common GROUP BY doc_id, item_id, m, size, s)
SELECT doc_id, item_id, round(max(sim), 6) AS similarity, CAST(arg_max(s, struct_pack(a := sim, b := -s)) AS BIGINT) AS start, count(*) AS windows
FROM scored WHERE sim >= 0.8 GROUP BY doc_id, item_id
"""
