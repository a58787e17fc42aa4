"""Audit of filters that interact: what each removes, in every order, per part of the corpus.

Which conditions a document fails is a mask of five bits; all figures follow from the number of documents of each mask,
so the documents are read for their masks alone, and the orders are told from the few counts.

Conditions A to D look at one text. E, being the same as the text of a smaller id, is found by partition refinement:

1. Documents are split by their length in code points; a class of one document is dropped.
2. Classes are split by the hashes of one block of the text after another, dropping those of one document each time.
   The blocks grow by GROWTH, so a text of n characters has log(n) of them; one pass over the texts hashes them all.
3. The full texts of the survivors are compared, by grouping: each task first tells equal texts once, so that many copies
   of one text don't meet in one place. Of equal texts the smallest id stays, and every other one fails E. Only texts move
   whose hash is likely a survivor's.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.common import cut, discard, table

FILTERS = "ABCDE"
#: Characters of the first block, and how much longer each next one is.
BLOCK, GROWTH = 256, 8
#: Blocks after these cover texts of 2^31 characters, more than a column's value can have.
BLOCKS = 8
#: Words of 64 bits by which texts are told that may have a copy (8 MB).
MOST_WORDS = 1 << 20
MIN_WORDS, MIN_DISTINCT, MOST_UPPER = 200, 50, 2  # words; distinct and upper-case shares in per cent


def text_mask(text: Column) -> Column:
    """Bits of A to D that a text fails; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bits(w: Column) -> Column:
        fails = [
            F.size(w) < MIN_WORDS,
            100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * F.size(w),
            100 * upper.cast("long") > MOST_UPPER * F.length(text),
            text.rlike(r"[#$%&*|]"),
        ]
        return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)))

    return F.get(F.transform(F.array(words), bits), F.lit(0))  # so that the words are made once


def block_hashes(text: Column) -> Column:
    """Hashes of the successive blocks of a text; null behind its end."""
    starts = [0, *itertools.accumulate(BLOCK * GROWTH**k for k in range(BLOCKS))]
    one = lambda a, b: F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, b - a)))
    return F.array(*(one(a, b) for a, b in itertools.pairwise(starts)))


def duplicates(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, th) of the rows whose text is that of a row with a smaller id.

    rows: id, th (a hash that tells the texts of one id apart), length and blocks; texts: id, th, text. Rows with a null
    id are no one's copies. Several rows of one id and text are one.
    """
    left = rows.where("id is not null").select("id", "th", F.col("length").cast("long").alias("class"), "blocks").distinct()
    for k in range(BLOCKS + 1):
        if k:  # a class is one length, so its texts end in the same block
            left = left.withColumn("class", F.xxhash64("class", F.get("blocks", F.lit(k - 1))))
        shared = left.groupBy("class").agg(F.count("*").alias("c")).where("c > 1").select("class")
        before, left = left, cut(left.join(shared, "class", "left_semi"))
        if k:
            discard(before)
        if k and not left.where(F.get("blocks", F.lit(k)).isNotNull() if k < BLOCKS else F.lit(False)).head(1):
            break
    survivors = left.select("id", "th")
    # equal texts are told once by each task, so their number doesn't count; a text that no other equals is its own first
    same = _maybe(texts, survivors).groupBy("text").agg(F.min(F.struct("id", "th")).alias("first"))
    found = cut(survivors.join(same.select("first.*"), ["id", "th"], "left_anti"))
    discard(left)
    return found


def _maybe(texts: DataFrame, survivors: DataFrame) -> DataFrame:
    """All texts whose hash is a survivor's, and a few others, told by one bit of their hashes; none moves for this.

    The bits are one row of MOST_WORDS words at most. Where that is too few, more other texts stay.
    """
    spark = texts.sparkSession
    hashes = survivors.select("th").distinct()
    words = min(MOST_WORDS, 1 << max(10, (hashes.count() // 4).bit_length()))
    word = lambda th: F.pmod(th, F.lit(words))
    bit = lambda th: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(th, 32), F.lit(64)).cast("int"))
    filled = hashes.groupBy(word(F.col("th")).alias("word")).agg(F.bit_or(bit(F.col("th"))).alias("bits"))
    each = spark.range(words).join(filled, F.col("id") == F.col("word"), "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    row = each.agg(F.array_sort(F.collect_list("x")).alias("all")).select(F.col("all.bits").alias("bits"))
    return texts.where("id is not null").join(F.broadcast(row), F.get(F.col("bits"), word(F.col("th")).cast("int")).bitwiseAND(bit(F.col("th"))) != 0, "left_semi")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask of every row: the bits of the filters that it fails. A null part is the empty string."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    texts = keyed.select("id", F.xxhash64("text").alias("th"), "text")
    rows = cut(keyed.select("id", "part", F.xxhash64("text").alias("th"), text_mask(F.col("text")).alias("own"), F.length("text").alias("length"), block_hashes(F.col("text")).alias("blocks")))
    copies = duplicates(rows, texts).withColumn("copy", F.lit(1 << 4))
    return rows.join(copies, ["id", "th"], "left").select("id", "part", (F.col("own") + F.coalesce("copy", F.lit(0))).alias("mask"))


def orders(letters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, bit, earlier): every step of every order, the bit of its filter and those before it."""
    out = []
    for order in itertools.permutations(letters):
        earlier = 0
        for step, x in enumerate(order, 1):
            bit = 1 << letters.index(x)
            out.append(("".join(order), step, bit, earlier))
            earlier |= bit
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from counts (part, mask, n, good, toxic) of documents by mask."""
    n_orders = len(orders()) // len(FILTERS)
    told = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, s, b, e in orders()))
    rows = told.select("part", "masks", F.inline(steps))
    bit, earlier = F.col("bit"), F.col("earlier")
    total = lambda where, what="n": F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(where(m["mask"]), m[what]).otherwise(0))
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    # of the orders of a document that fails k filters, each of these k is the first in one of k
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m["mask"]), m["n"] * (n_orders / F.bit_count(m["mask"])).cast("long")).otherwise(0))
    removed = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(earlier.bitwiseOR(bit)) == 0).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, each of the 120 orders and each step, zeros included. A null text is empty, a null part the
    empty string; without documents there are no rows. Every row counts as a document; one with a null id is no copy,
    nor is it the original of any, and has no labels. A document is good (quality = 1) or toxic (toxic = 1) if any label
    row of its id says so.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = masks(docs, id_col, text_col, part_col).join(known.where("good = 1 or toxic = 1"), "id", "left")
    sums = (F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))
    return audit(cut(rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) good, max((toxic = 1)::INTEGER) toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, map {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} f FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) n, sum(good) good, sum(toxic) toxic FROM m GROUP BY part, f),
o AS (SELECT '' p UNION ALL SELECT p || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x) WHERE NOT contains(p, x)),
s AS (SELECT p AS filter_order, unnest(range(1, 6)) step FROM o WHERE length(p) = 5),
e AS (SELECT part, filter_order, step, n, good, toxic, f[filter_order[step]] fails, list_any_value(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND f[x])) IS NOT NULL gone,
    len(list_filter(map_values(f), lambda x: x)) k FROM c, s),
r AS (SELECT part, filter_order, step,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT redundant, sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END)::BIGINT unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT toxic_lost
    FROM e GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT shapley FROM r
"""
