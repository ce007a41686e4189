"""How filters interact: what each removes, in every order, and which documents it alone would remove."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole, written

#: Characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
#: Counters of a segment of the sketch, which is one bitmap of Spark, and counters that a text raises.
SLOTS, RAISED = 1 << 15, 4
#: Counters for each row, which leaves about 0.3 % of the unique texts uncleared.
COUNTERS_PER_ROW = 16
#: Bytes of merged sketch that are sent to every task; beyond it hashes are dealt to their segments.
SENT_BYTES = 64 << 20


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


#: Failure conditions by letter, of a text without nulls and its words.
CHECKS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", "")))
    > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}


def places(h: Column, segments: int) -> tuple[Column, list[Column]]:
    """Segment of a 64-bit hash and its counters there, all different since the step is odd."""
    first, step = h.bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(SLOTS - 1)).bitwiseOR(F.lit(1))
    return (F.pmod(F.shiftrightunsigned(h, 30), F.lit(segments)),
            [(first + F.lit(i) * step).bitwiseAND(F.lit(SLOTS - 1)) for i in range(RAISED)])


def sketch(hashes: DataFrame, segments: int) -> DataFrame:
    """Counting Bloom filter of the column ``h``: a bitmap of each segment's counters that were raised twice or more.

    A task adds up its own increments before the shuffle, so a hash that holds a third of all rows is four rows a task,
    and the sketches merge by addition."""
    segment, slots = places(F.col("h"), segments)
    raised = hashes.select(segment.alias("segment"), F.explode(F.array(*slots)).alias("slot"))
    counted = raised.groupBy("segment", "slot").agg(F.count("*").alias("n")).where("n >= 2")
    return counted.groupBy("segment").agg(F.bitmap_construct_agg("slot").alias("bits"))


def uncleared(h: Column, bits: Column, segments: int) -> Column:
    """Whether all counters of the hash were raised twice: only then can its text occur again."""
    def bit(slot: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, slot.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    every = F.lit(True)
    for slot in places(h, segments)[1]:
        every = every & bit(slot)
    return F.coalesce(every, F.lit(False))


def possible_repeats(rows: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``rows`` with ``maybe``: false only where no other row can have the same ``h``.

    The sketch grows with the rows, in segments of 4 KB. Up to ``sent_bytes`` of it go to every task and no row moves;
    a larger one meets the distinct hashes in a shuffle by segment, and the hashes left meet the rows in a join."""
    segments = max(1, -(-rows.count() * COUNTERS_PER_ROW // SLOTS))
    merged = written(sketch(rows.select("h"), segments), "sketch")
    segment = places(F.col("h"), segments)[0]
    if segments * SLOTS // 8 <= sent_bytes:
        met = rows.withColumn("segment", segment).join(F.broadcast(merged), "segment", "left")
        return met.withColumn("maybe", uncleared(F.col("h"), F.col("bits"), segments)).drop("segment", "bits")
    distinct = rows.select("h").distinct().withColumn("segment", segment)
    left = distinct.join(merged, "segment").where(uncleared(F.col("h"), F.col("bits"), segments)).select("h", F.lit(True).alias("maybe"))
    return rows.join(left, "h", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def flags(docs: DataFrame, labels: DataFrame, checks: Mapping[str, Callable[[Column, Column], Column]] = CHECKS,
          duplicate: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          sent_bytes: int = SENT_BYTES) -> DataFrame:
    """One row for each document: ``part``, ``mask`` (bit i: fails the i-th letter in alphabetical order), ``good`` and ``toxic``.

    ``duplicate`` fails where a smaller id has the same text, in the whole table. Texts are compared whole: the sketch
    clears most unique ones, and what may repeat is reduced to one row a task and text before it is shuffled.
    Null text is empty, a null part too; a document without an id fails no duplicate test, makes none fail and has no label;
    rows that share an id do not make each other fail; several labels of an id count as one that holds what any says.
    """
    letters = sorted([*checks, duplicate])
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.xxhash64(text).alias("h"))
    rows = possible_repeats(rows, sent_bytes).withColumn("words", _words(F.col("text")))
    mask = F.lit(0)
    for i, letter in enumerate(letters):
        if letter != duplicate:
            mask = mask + F.when(checks[letter](F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(F.lit(0))
    kept = written(rows.select("id", "part", mask.alias("mask"), F.when(F.col("maybe"), F.col("text")).alias("text")), "flags")
    # The hash tells texts of one id apart; the least id of a text is found by the text itself.
    named = kept.where("id IS NOT NULL").withColumn("sha", F.when(F.col("text").isNotNull(), F.sha2("text", 256)))
    firsts = named.where("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id")) \
        .select("id", F.sha2("text", 256).alias("sha"), F.lit(True).alias("first"))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    again = F.when(F.col("sha").isNotNull() & F.col("first").isNull(), F.lit(1 << letters.index(duplicate))).otherwise(F.lit(0))
    out = named.drop("text").join(told, "id", "left").join(firsts, ["id", "sha"], "left").select(
        "part", (F.col("mask") + again).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return out.union(kept.where("id IS NULL").select("part", "mask", F.lit(0), F.lit(0)))


def audit(marked: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """All orders of the filters, step by step, from ``flags``: one row for each part, order and step, zeros included.

    Only the counts of each part and mask are used; they add up, so every document is seen once whatever the number of
    orders. ``shapley`` is the number of documents the filter removes, summed over all orders: a document that fails k
    filters meets each of them first in one k-th of the orders. An empty table has no parts and no rows.
    """
    n = len(letters)
    orders = list(permutations(range(n)))
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    pairs = [(sum(1 << i for i in others), 1 << f) for f in range(n)
             for k in range(n) for others in combinations([i for i in range(n) if i != f], k)]
    pair = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("own")) for b, f in pairs)))
    wide = counts.withColumn("pair", pair).select("part", "mask", "n", "good", "toxic", "pair.before", "pair.own")
    mask, before, own = F.col("mask"), F.col("before"), F.col("own")
    fails, reached = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) == 0
    added = lambda when, of=F.col("n"): F.sum(F.when(when, of).otherwise(F.lit(0))).cast("long")
    steps = wide.groupBy("part", "before", "own").agg(
        added(reached & ~fails).alias("kept"), added(reached & fails).alias("removed"), added(~reached & fails).alias("redundant"),
        added(mask == own).alias("unique_fails"), added(reached & fails, F.col("good")).alias("good_lost"),
        added(reached & fails, F.col("toxic")).alias("toxic_lost"),
        added(fails, F.col("n") * (F.lit(len(orders)) / F.bit_count("mask")).cast("long")).alias("shapley"))
    named = [("".join(letters[i] for i in order), s + 1, sum(1 << i for i in order[:s]), 1 << order[s])
             for order in orders for s in range(n)]
    shown = marked.sparkSession.createDataFrame(named, "filter_order string, step int, before int, own int")
    return steps.join(F.broadcast(shown), ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
