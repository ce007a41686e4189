"""Benchmark decontamination: spaced seeds find candidate overlaps, aligned tokens decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, digest, whole

#: Offsets of the tokens that a seed reads; it ignores the others. Any 11 tokens with two substitutions, and any 8
#: with one, still hold a seed of one of the two masks (tested).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: An overlap is a run of so many aligned tokens, of which at least this share is equal. A shorter item must be held as
#: a whole, with no more substitutions than the masks are proven for: one, or two from 11 tokens on; below ``LEAST`` not even one.
OVERLAP, SHARE, LEAST = 13, 0.8, 8
#: Seeds of the test side that may be broadcast (about 100 bytes each); beyond it the seeds are joined by a shuffle.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the words, in order."""
    return F.transform(F.array_remove(F.split(F.lower(whole(text)), NOT_WORD), ""), lambda w: F.xxhash64(w))


def seed(words: str, start: Column) -> Column:
    """Hash of the tokens that ``mask`` reads from ``start`` (from 0) on. One expression for all masks: generated
    code of this size is still compiled by the JVM."""
    at = []
    for offsets in zip(*MASKS):
        offset = F.lit(offsets[-1])
        for m in range(len(MASKS) - 1):
            offset = F.when(F.col("mask") == m, offsets[m]).otherwise(offset)
        at.append(F.get(words, start + (F.lit(offsets[0]) if len(set(offsets)) == 1 else offset)))
    return F.xxhash64("mask", *at)


def seeded(rows: DataFrame, words: str) -> DataFrame:
    """A row for each token position and mask, with ``pos``, ``mask`` and ``seed``."""
    n, k = F.size(words), len(MASKS)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n * k - 1))).alias("at")
    out = rows.select("*", at).select("*", F.expr(f"int(at div {k})").alias("pos"), (F.col("at") % k).alias("mask"))
    return out.withColumn("seed", seed(words, F.col("pos"))).drop("at")


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: ``id``, ``digest`` (of the text), ``item``, ``shift`` (document position of the item's first
    token) and ``n_equal`` (equal tokens of the whole alignment), one row each.

    Tokens are runs of letters and digits in lower case. Every position of every text is hashed under each mask and
    joined with the hashed test items; around a hit the item is laid on the document without gaps, and the overlap
    counts if some run of ``OVERLAP`` aligned tokens has at least ``SHARE`` of them equal. An item of ``LEAST`` to
    ``OVERLAP`` - 1 tokens counts if the run of its length does, with at most one substitution below 11 tokens. A chain
    of hits on one alignment is verified at its first hit only. Items of fewer than ``LEAST`` tokens are no evidence and
    take no part, as do null or empty texts and items; repeated rows give their overlaps once.
    """
    items = (bench.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("words"))
             .where(F.size("words") >= LEAST).distinct())
    span = F.when(F.col("mask") == 0, MASKS[0][-1])
    for m in range(1, len(MASKS)):
        span = span.when(F.col("mask") == m, MASKS[m][-1])
    test = (seeded(items, "words").where(F.col("pos") + span < F.size("words"))
            .select("item", "words", F.col("pos").alias("ipos"), "mask", "seed",
                    F.when(F.col("pos") > 0, seed("words", F.col("pos") - 1)).alias("iseed")))
    test = test.drop("mask")
    if test.count() <= BROADCAST_SEEDS:
        test = F.broadcast(test)
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"),
                       tokens(F.col(text_col)).alias("doc_words"))
    hits = seeded(rows, "doc_words").join(test, "seed")
    chained = (F.col("pos") > 0) & (seed("doc_words", F.col("pos") - 1) == F.col("iseed"))
    hits = hits.where(~F.coalesce(chained, F.lit(False)))
    shift = F.col("pos") - F.col("ipos")
    first = F.greatest(F.lit(0), -shift)
    length = F.least(F.size("words"), F.size("doc_words") - shift) - first
    run = F.least(F.lit(OVERLAP), F.size("words"))
    # one row for an alignment before any lambda: up to here the plan stays in generated code, row by row
    laid = hits.where(length >= run).select(
        "id", "digest", "item", shift.alias("shift"), run.alias("run"), F.slice("words", first + 1, length).alias("i"),
        F.slice("doc_words", first + shift + 1, length).alias("d")).dropDuplicates(["id", "digest", "item", "shift"])
    same = F.zip_with("i", "d", lambda a, b: F.when(a == b, 1).otherwise(0))
    need = F.greatest(F.ceil(SHARE * F.col("run")), F.col("run") - F.when(F.col("run") < 11, 1).otherwise(2))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    marked = laid.select("id", "digest", "item", "shift", "run", same.alias("same"))
    place = F.sequence(F.lit(0), F.size("same") - 1)

    def step(acc, i):
        now = acc["now"] + F.get("same", i) - F.coalesce(F.get("same", i - F.col("run")), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return (marked.where(F.aggregate(place, state, step)["most"] >= need)
            .select("id", "digest", "item", "shift",
                    F.aggregate("same", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_equal")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item."""
    found = overlaps(docs, bench, id_col, text_col, **names).select(
        F.col("id").alias("_fid"), F.col("digest").alias("_fdigest")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col("_fid")) & (digest(docs[text_col]) == F.col("_fdigest")), "left_anti")
