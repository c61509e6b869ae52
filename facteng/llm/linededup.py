"""Line dedup by an exact set-similarity join over all lines, in built-in expressions only.

A line is the set of its words. Words are ordered by rarity, counted over the corpus in 2**17 hash buckets: any
global order keeps the join exact, rarity makes it fast, and the bucketed counts have a fixed size. Two lines of
Jaccard similarity t share a word among their first n - ceil(t n) + 1 (prefix filter), the smaller one among its first
n - ceil(2 t n / (1 + t)) + 1. Candidates must also fit in length, in the number of words that can still follow the shared
one (positional filter), and in a parity signature of 64 or 128 bits, whose differing bits bound the overlap. The join's key is a word and
a class of sizes, so that sets of one word but far apart in size don't meet at all. What is left is verified on the whole sets.

Equal sets are merged first, by 128 bits of their hash, so copies of a line are one entry of the join whatever their number. A
line goes if some earlier line (by doc_id, then place) has similarity t or more, whether that one is kept or not. So
all that counts of a set is whether any earlier one is similar: one witness settles it. Witnesses are sought first among the few
sets just before it that share the least hash of a prefix word; the join then looks for partners of the sets that have none
yet, and only among pairs whose later set is such a one. Sets that share words without being similar still meet; no decision is lost.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, documents, maybe_broadcast, text_or_empty
from .native_text import hashes, words

#: Hash buckets in which words are counted.
BUCKETS = 1 << 17
#: Sets with one key that are looked through together for witnesses; larger groups are dealt out.
GROUP = 4096
#: Hash buckets in which these keys are counted.
SKETCH = 1 << 12
#: Earlier sets that are tried as witnesses, for each key.
BACK = 6
#: Steps in which the prefix join is made.
TURNS = 2
#: Ranks of places in packed postings.
RANKS = 1 << 30
#: In packed postings larger sets have this size, which the filters let pass.
WIDE = (1 << 16) - 1
#: Sets of more words than this have 128 bits of parities, others 64.
FEW = 48


def _plain(text: Column) -> Column:
    """Lower-cased, with plain spaces between the words of a line: its words are then a split at one character."""
    text = F.lower(text)
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(docs: DataFrame) -> bytes:
    """One byte for each hash bucket: a logarithmic class of how many words of the corpus fall into it."""
    flat = F.replace(_plain(text_or_empty().cast("string")), F.lit("\n"), F.lit(" "))
    tokens = docs.select(F.explode(F.split(flat, " ")).alias("w"))
    hashed = tokens.where(F.col("w") != "").select(_bucket(F.xxhash64("w")).alias("b"))
    out = bytearray(BUCKETS)
    counted = hashed.groupBy("b").agg(F.least(F.lit(126), F.floor(F.log2(F.count(F.lit(1))) * 3) + 1).cast("int").alias("c"))
    for r in counted.collect():  # at most BUCKETS rows
        out[r.b] = r.c
    return bytes(out)


def codes(line: Column, classes: bytes) -> Column:
    """The set of words of a line of _plain text as an ascending array of longs: class of rarity in the top byte, hash below."""
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # folded to a constant; equal small numbers are one object
    hashed = F.array_remove(F.array_distinct(hashes(F.split(line, " "))), F.xxhash64(F.lit("")))

    # Never null, so that plain longs are sorted and not objects.
    code = lambda h: F.shiftleft(F.coalesce(F.get(table, _bucket(h)), F.lit(0).cast("long")), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(hashed, code))


def _once(c: Column) -> Column:
    """A generator of one row with the value: what reads the column afterwards doesn't evaluate the expression again."""
    return F.explode(F.array(c))


def _parities(array: Column, parts: int) -> list[Column]:
    """64 * parts bits in longs s0, s1, .. (parts: 2 or 4), each bit the parity of how many elements have it as their lowest
    bits: two sets differ in at least as many elements as their parities in bits. Of two parts the first holds the parities of all
    elements, the second, for sets of more than FEW, those with a further bit set (0 for others)."""
    place = lambda c: c.bitwiseAND(F.lit(63)).cast("int")

    def those(mark) -> Column:  # of the elements whose mark is 1
        return F.aggregate(array, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", mark(c), place(c))))

    one = F.lit(1).cast("long")
    every, low = those(lambda c: one), those(lambda c: F.shiftright(c, 6).bitwiseAND(one))
    if parts == 2:
        return [every.alias("s0"), F.when(F.size(array) > FEW, low).otherwise(F.lit(0).cast("long")).alias("s1")]
    high, both = (those(m) for m in (lambda c: F.shiftright(c, 7).bitwiseAND(one), lambda c: F.shiftright(c, 6).bitwiseAND(F.shiftright(c, 7)).bitwiseAND(one)))
    return [every.bitwiseXOR(low).bitwiseXOR(high).bitwiseXOR(both).alias("s0"), low.bitwiseXOR(both).alias("s1"), high.bitwiseXOR(both).alias("s2"), both.alias("s3")]


def _differ(parts: int) -> Column:
    """Differing bits of the columns s0, s1, .. and s0_, s1_, .."""
    one = lambda x: F.bit_count(F.col(f"s{x}").bitwiseXOR(F.col(f"s{x}_")))
    return sum((one(x) for x in range(1, parts)), one(0))


def _ceil_share(n: Column, t: Fraction) -> Column:
    """ceil(t n) in integers."""
    return F.floor((n * t.numerator + (t.denominator - 1)) / t.denominator).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_or_empty().cast("string").alias("text"))


def _plain_texts(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "th", _plain(F.col("text")).alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))


PLACE = ("doc_id", "th", "line")


def _fits(t: Fraction, n: Column, m: Column, parts: int = 2) -> Column:
    """Whether sets of n and m words with these parities can be similar: overlap o is enough if o (a + b) >= a (n + m)."""
    a, b = t.numerator, t.denominator
    near = lambda differ: (n + m - differ) * (a + b) >= a * (n + m) * 2
    size = F.least(n, m) * b >= F.greatest(n, m) * a
    if parts == 4:
        return size & near(_differ(4))
    every, low = F.col("s0").bitwiseXOR(F.col("s0_")), F.col("s1").bitwiseXOR(F.col("s1_"))
    return size & near(F.bit_count(every)) & ((F.least(n, m) <= FEW) | near(F.bit_count(every.bitwiseXOR(low)) + F.bit_count(low)))


def _neighbours(sets: DataFrame, scratch: Scratch, t: Fraction) -> DataFrame:
    """(k, k_): for every set the possible witnesses among the few before it in its groups of one key."""
    other = F.array_min(F.transform("prefix", lambda c: F.hash(c, F.lit(1))))
    keys = F.array_distinct(F.array(F.xxhash64(F.array_min("prefix"), F.lit(0)), F.xxhash64(F.array_max("prefix"), F.lit(1)), F.xxhash64(other, F.lit(2))))
    keyed = sets.select(F.explode(keys).alias("key"), "k", "n", "s0", "s1", *PLACE)
    # Keys are counted in SKETCH buckets; any earlier partner serves, so what is in a large bucket may be dealt out.
    bucket = lambda: F.pmod("key", F.lit(SKETCH)).alias("bucket")
    counted = keyed.groupBy(bucket()).count()
    large = {r.bucket: -(-r["count"] // GROUP) for r in counted.where(F.col("count") > F.lit(GROUP)).collect()}  # at most SKETCH rows
    usual = 8 * sum(large.values()) / SKETCH
    large = {x: parts for x, parts in large.items() if parts > usual}
    part = F.lit(0).cast("long")
    if large:
        dealt = sets.sparkSession.createDataFrame(list(large.items()), "bucket long, parts long")
        keyed = keyed.withColumn("bucket", bucket()).join(F.broadcast(dealt), "bucket", "left")
        part = F.coalesce(F.pmod(F.xxhash64("k"), "parts"), part)
    before = Window.partitionBy("key", "part").orderBy(*PLACE)
    held = ("k", "n", "s0", "s1")
    tried = F.array(*[F.lag(F.struct(*[F.col(c).alias(f"{c}_") for c in held]), d).over(before) for d in range(1, BACK + 1)])
    found = keyed.withColumn("part", part).select(*held, tried.alias("tried")).select(*held, F.inline("tried"))
    found = found.where(F.col("k_").isNotNull() & (F.col("k") != F.col("k_")) & _fits(t, F.col("n"), F.col("n_")))
    return found.select("k", "k_").distinct()


def _ranked(sets: DataFrame) -> DataFrame:
    """With rank, an int below RANKS: sets of lesser rank have earlier places. Of equal ranks, as of one doc_id, nothing is known."""
    low, high = sets.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return sets.withColumn("rank", F.lit(0))
    # Each step keeps the order, whatever it rounds. A null doc_id comes before all others.
    share = (F.col("doc_id").cast("double") - float(low)) / max(float(high) - float(low), 1.0)
    return sets.withColumn("rank", F.coalesce(F.floor(share * (RANKS - 2)).cast("int") + 1, F.lit(0)))


def _class(n: Column, t: Fraction) -> Column:
    """A class of sizes, at most 31. Similar sets are of one class or of adjacent ones: a class spans more than a factor of 1 / t."""
    span = max(1.5, 1.01 / float(t))
    return F.least(F.floor(F.log(n.cast("double")) / math.log(span)), F.lit(31)).cast("int")


def _partners(sets: DataFrame, t: Fraction, settled: int, turn: int) -> DataFrame:
    """(k, k_): candidates of the prefix join whose later set isn't late yet, by the sets' ranks (if they have any); of equal ranks
    one at least isn't. Of the words every TURNS-th is dealt with, so that what is shuffled at once is a part of all postings.
    settled is the number of late sets."""
    a, b = t.numerator, t.denominator
    rank = F.col("rank") if "rank" in sets.columns else F.lit(0)
    packed = F.shiftleft(F.col("rank").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("late").cast("long"), 32)).bitwiseOR(F.shiftleft(F.least("n", F.lit(WIDE)).cast("long"), 16)).bitwiseOR(F.least("pos", F.lit(WIDE)).cast("long"))
    word = lambda c: F.shiftleft(F.col("code").cast("long"), 5).bitwiseOR(c.cast("long")).alias("word")
    own, next_ = _class(F.col("n"), t), _class(F.floor(F.col("n") * b / a), t)
    posts = sets.select("k", "s0", "s1", "n", "late", rank.alias("rank"), own.alias("own"), next_.alias("next"), F.posexplode("prefix").alias("pos", "code"))
    posts = posts.where(F.pmod("code", F.lit(TURNS)) == turn).select("k", "s0", "s1", packed.alias("p"), "n", "pos", "code", "own", "next")
    short = (F.col("n") >= WIDE) | (F.col("pos") <= F.col("n") - _ceil_share(F.col("n"), 2 * t / (1 + t)))
    size = lambda p: F.shiftright(p, 16).bitwiseAND(F.lit(WIDE)).cast("int")
    at = lambda p: p.bitwiseAND(F.lit(WIDE)).cast("int")
    n, m, i, j = size(F.col("p")), size(F.col("p_")), at(F.col("p")), at(F.col("p_"))
    wide = (m == WIDE) & (n * b >= WIDE * a)
    fits = wide | ((F.least(n - i, m - j) * (a + b) >= a * (n + m)) & _fits(t, n, m))
    # The smaller set of a pair needs a shorter prefix (its share of the overlap is larger).
    same = (F.col("word") == F.col("word_")) & ((n < m) | ((n == m) & (F.col("k") != F.col("k_")))) & fits
    held = ("k", "s0", "s1", "p", "word")
    long_ = lambda df: df.select(*held[:-1], word(F.col("own"))).select(*[F.col(c).alias(f"{c}_") for c in held])
    # The larger set is of the smaller one's class or of the next, where that can be.
    low = posts.where(short).select("k", "s0", "s1", "p", "code", F.explode(F.when(F.col("own") == F.col("next"), F.array("own")).otherwise(F.array("own", "next"))).alias("class"))
    if settled:
        ranks = [F.shiftright(p, 33) for p in ("p", "p_")]
        open_ = [F.shiftright(p, 32).bitwiseAND(F.lit(1)) == 0 for p in ("p", "p_")]
        same = same & ((open_[0] & (ranks[0] >= ranks[1])) | (open_[1] & (ranks[1] >= ranks[0])))
    # A hash join, as neither side need be sorted for one look at each key.
    found = low.select("k", "s0", "s1", "p", word(F.col("class"))).hint("shuffle_hash").join(long_(posts), same)
    return found.select("k", "k_").distinct()


def _late(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: Scratch, t: Fraction) -> DataFrame:
    """(k, j): the sets not late yet that are similar to an earlier one, of the given candidates. Each pair is taken from the
    later set's side; only its two lines are read again from the texts. Words are compared by 64-bit hashes, first by 256 parities
    of them, so only what is hardly ever not similar carries its words."""
    a, b = t.numerator, t.denominator
    asked = pairs.select("k").union(pairs.select("k_")).distinct()
    firsts = scratch.save(sets.select("k", "j", "late", F.struct(*PLACE).alias("first")).join(asked, "k", "left_semi"), "firsts")
    n = firsts.count()
    rename = lambda df, x: df.select(*[F.col(c).alias(c + x) for c in df.columns])
    # The lines of these sets.
    wanted = maybe_broadcast(firsts.select("k", "j", *[F.col(f"first.{c}").alias(f"_{c}") for c in PLACE]), n, 64)
    held = maybe_broadcast(firsts.select(F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t")).distinct(), n, 40)
    few = texts.join(held, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")) & (F.col("line") == F.col("_line"))
    hashed = _lines(few).join(wanted, same).dropDuplicates(["k", "j"]).select("k", "j", _once(F.array_distinct(hashes(words(F.col("content"))))).alias("w"))
    whole = scratch.save(hashed.select("k", "j", "w", F.size("w").alias("n"), *_parities(F.col("w"), 4)), "whole")

    known = firsts.join(whole.drop("w"), ["k", "j"])
    one, two = (maybe_broadcast(rename(known, x), n, 128) for x in ("", "_"))
    both = pairs.join(one, "k").join(two, "k_").where(_fits(t, F.col("n"), F.col("n_"), 4))
    ahead = F.col("first") > F.col("first_")
    turned = [F.when(ahead, F.col(c)).otherwise(F.col(f"{c}_")).alias(c) for c in ("k", "j", "late")]
    back = [F.when(ahead, F.col(f"{c}_")).otherwise(F.col(c)).alias(f"{c}_") for c in ("k", "j")]
    useful = both.select(*turned, *back, (_differ(4) / (F.col("n") + F.col("n_"))).alias("apart")).where(~F.col("late")).drop("late")
    useful = scratch.save(useful.distinct(), "useful")

    def met(few: DataFrame) -> DataFrame:
        mine, its = (rename(whole.select("k", "j", "w"), x) for x in ("", "_"))
        o = F.size(F.array_intersect("w", "w_"))
        return few.join(mine, ["k", "j"]).join(its, ["k_", "j_"]).where(o * (a + b) >= (F.size("w") + F.size("w_")) * a).select("k", "j").distinct()

    # One witness settles a set: the likeliest is tried first, then the others of what it hasn't settled.
    likeliest = useful.groupBy("k", "j").agg(F.min(F.struct("apart", "k_", "j_")).alias("best")).select("k", "j", "best.k_", "best.j_")
    late = scratch.save(met(likeliest), "late")
    rest = scratch.save(useful.join(late, ["k", "j"], "left_anti").join(likeliest, ["k", "j", "k_", "j_"], "left_anti").drop("apart"), "rest")
    out = scratch.save(late.union(met(rest)), "late") if not rest.isEmpty() else late
    for table in (firsts, useful, whole, rest):
        scratch.drop(table)
    return out


def removed_lines(docs: DataFrame, spark: SparkSession, similarity: float = 0.8, least_words: int = 5) -> DataFrame:
    """(doc_id, th, lines array<int>): places (from 0) of the lines that go, for each document that loses some; th is
    xxhash64 of the text, which tells apart different texts of one doc_id.

    Lines with fewer than least_words different words are neither removed nor compared. Null texts are empty; a null
    doc_id comes before all others; repeated rows (same id and text) share their places, so neither is later than the
    other. No rows: no rows."""
    t = Fraction(similarity).limit_denominator(1000)
    scratch = Scratch(spark, "lines")
    classes, texts = rarity(docs), _texts(docs)
    coded = _lines(_plain_texts(texts)).select(*PLACE, _once(codes(F.col("content"), classes)).alias("codes")).withColumn("n", F.size("codes")).where(F.col("n") >= least_words)
    # Of a line only the short hashes of its prefix, a parity signature and a key of the set are kept.
    prefix = F.transform(F.slice("codes", 1, F.col("n") - _ceil_share(F.col("n"), t) + 1), lambda c: F.hash(c))
    key = [F.xxhash64("codes").alias("k"), F.xxhash64(F.lit(1), "codes").alias("j")]
    coded = scratch.save(coded.select(*PLACE, *key, "n", *_parities(F.col("codes"), 2), prefix.alias("prefix")), "coded")

    # Every set once, with its first place.
    merged = coded.groupBy("k", "j").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "prefix")])
    sets = scratch.save(merged.select("k", "j", "n", "s0", "s1", "prefix", "first.*", "times"), "sets")
    lines = scratch.save(coded.select(*PLACE, "k", "j"), "lines")
    scratch.drop(coded)

    near = scratch.save(_neighbours(sets, scratch, t), "near")
    early = _late(near, sets.withColumn("late", F.lit(False)), texts, scratch, t)
    settled = early.count()
    mark = maybe_broadcast(early.withColumn("late", F.lit(True)), settled, 32)
    marked = sets.join(mark, ["k", "j"], "left").withColumn("late", F.coalesce("late", F.lit(False)))
    turns = []
    ranked = _ranked(marked) if settled else marked
    for turn in range(TURNS):
        turns.append(scratch.save(_partners(ranked, t, settled, turn), "pairs"))
        scratch.settle()  # so that the next turn's shuffle files don't come on top
    pairs = scratch.save(reduce(DataFrame.union, turns).distinct(), "pairs")
    late = early.union(_late(pairs, marked, texts, scratch, t))

    # A line goes if its set is late or has an earlier place.
    late = maybe_broadcast(late.withColumn("late", F.lit(True)), late.count(), 32)
    limits = sets.join(late, ["k", "j"], "left").where(F.col("late") | (F.col("times") > 1))
    limits = scratch.save(limits.select("k", "j", F.coalesce("late", F.lit(False)).alias("late"), F.struct(*PLACE).alias("first")), "limits")
    scratch.drop(sets)
    gone = lines.select(*PLACE, "k", "j").join(maybe_broadcast(limits, limits.count(), 72), ["k", "j"]).where(F.col("late") | (F.struct(*PLACE) > F.col("first")))
    out = scratch.save(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines")), "gone")
    for table in (lines, near, *turns, pairs, limits):
        scratch.drop(table)
    return out


def dedup_lines(docs: DataFrame, spark: SparkSession, similarity: float = 0.8, least_words: int = 5) -> DataFrame:
    """docs with the text of every document less its removed lines, and a column n_chars (if there is one) brought up to
    date. All rows stay; a document whose lines all go has an empty text. A text that loses nothing is unchanged, so a null
    stays null. Other columns and values are as in docs."""
    gone = removed_lines(docs, spark, similarity, least_words)
    n, total = gone.agg(F.count(F.lit(1)), F.sum(F.size("lines"))).first()
    bad = maybe_broadcast(gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("lines").alias("_gone")), int(n) * 8 + int(total or 0), 8)
    joined = docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): name for c, name in zip(docs.columns, names, strict=True)}
    plain = [docs[f"`{c}`"].alias(name) for c, name in zip(docs.columns, names, strict=True)]
    lines = F.when(bad["_gone"].isNotNull(), F.split(docs["text"], "\n", -1))
    cut = joined.select(*plain, bad["_gone"].alias("_gone"), _once(lines).alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col(at["text"])).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    cut = cut.select(*names, "_gone", _once(text).alias("_text"))
    out = dict(zip(names, [F.col(x) for x in names], strict=True))
    out[at["text"]] = F.col("_text")
    if "n_chars" in at:
        out[at["n_chars"]] = F.when(F.col("_gone").isNull(), F.col(at["n_chars"])).otherwise(F.length("_text").cast(docs.schema[docs.columns[names.index(at["n_chars"])]].dataType))
    return cut.select(*[out[x].alias(c) for c, x in zip(docs.columns, names, strict=True)])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents. Null texts are one empty line and keep nothing; repeated rows share their places; a
    null doc_id comes before all others. Further columns aren't read."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(F.split(text_or_empty(), "\n", -1)).cast("long").alias("n_lines"))
    cut = dedup_lines(docs.withColumn("before", F.length(text_or_empty()).cast("long")), spark)
    return cut.select("doc_id", "n_lines", (F.col("before") - F.length(text_or_empty())).cast("long").alias("chars_removed"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))


#: The same over all pairs of different line sets.
OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, no, line, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), s AS (SELECT w, len(w) AS n, min((doc_id, no)) AS first, row_number() OVER () AS k FROM l WHERE len(w) >= 5 GROUP BY w),
e AS (SELECT k, n, unnest(w) AS t FROM s),
p AS (SELECT a.k AS k1, b.k AS k2, count(*) AS o FROM e a JOIN e b ON a.t = b.t AND a.k < b.k AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4 GROUP BY ALL),
m AS (SELECT k1, k2 FROM p JOIN s x ON x.k = k1 JOIN s y ON y.k = k2 WHERE o * 9 >= 4 * (x.n + y.n)),
near AS (SELECT k, min(f) AS f FROM (SELECT k1 AS k, s.first AS f FROM m JOIN s ON s.k = k2 UNION ALL SELECT k2, s.first FROM m JOIN s ON s.k = k1 UNION ALL SELECT k, first FROM s) GROUP BY k),
g AS (SELECT l.doc_id, l.no, l.line, (near.f IS NOT NULL AND (l.doc_id, l.no) > near.f) AS gone FROM l LEFT JOIN s ON l.w = s.w LEFT JOIN near ON near.k = s.k),
k AS (SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT k.doc_id, n_lines, length(coalesce(text, '')) - length(kept) AS chars_removed, sha256(kept) AS kept_sha256 FROM k JOIN documents d ON d.doc_id = k.doc_id
"""
