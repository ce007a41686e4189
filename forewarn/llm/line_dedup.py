"""Line dedup: repeated lines go, all but those of the document with the largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, whole

#: The white space stripped at both ends of a line, and the letters lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key's documents are dealt to so many slices, so that no task holds all rows of a frequent line.
SLICES = 64


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                 min_docs: int = 3) -> DataFrame:
    """The lines that each document loses, as bitmaps.

    A line of at least ``min_chars`` code points (stripped, A-Z in lower case) found in at least ``min_docs``
    documents is kept in the largest id only. Hashes are range-partitioned with the documents' slices and sorted by
    document (largest first) and position; the first row of each slice states how many documents the slice has and
    which is the largest. Only these rows are added up over a key, so a line that a third of all documents hold is
    spread over ``SLICES`` places.

    Returns ``id``, ``digest`` (of the text) and ``dropped``: a map from word number to 64 bits, one bit a line,
    without words that are all zero; documents that lose nothing are absent. A null id is a document smaller than all
    others; rows with one id count as one document; null and empty texts have one empty line; an empty table gives
    an empty result.
    """
    lines = (docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"),
                         F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
             .withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
             .select("id", "digest", "pos", F.unhex(F.md5("key")).alias("key"),
                     F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int").alias("slice")))
    ranged = lines.repartitionByRange("key", "slice")
    order = Window.partitionBy("key", "slice").orderBy(F.desc_nulls_last("id"), "pos", "digest")
    heads = (ranged.withColumn("row", F.row_number().over(order)).withColumn("before", F.lag("id").over(order))
             .where((F.col("row") == 1) | ~F.col("id").eqNullSafe(F.col("before"))))
    repeated = (heads.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))
                .where(F.col("n_docs") >= min_docs).select("key", "last"))
    lost = ranged.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("last")))
    words = lost.groupBy("id", "digest", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % 64)).alias("bits"))
    return words.groupBy("id", "digest").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines`` (before) and ``n_dropped`` added (existing columns of
    these names are replaced). A text without losses, null included, stays as it is."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    d = docs.select(F.struct(*columns).alias("d"), F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest"))
    joined = d.join(bitmaps.select(F.col("id").alias("_bid"), F.col("digest").alias("_bdigest"), "dropped"),
                    F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_digest") == F.col("_bdigest")), "left")
    text, dropped = F.col("d").getField(text_col), F.col("dropped")
    lines = lines_of(text)

    def stays(_, i):
        bits = F.coalesce(F.element_at(dropped, F.shiftright(i, 6)), F.lit(0).cast("bigint"))
        return F.call_function("getbit", bits, i % 64) == 0

    kept = joined.withColumn("kept", F.when(dropped.isNotNull(), F.filter(lines, stays)))
    return kept.select(
        *[F.coalesce(F.array_join("kept", "\n"), text).alias(c) if c == text_col else F.col("d").getField(c).alias(c)
          for c in columns],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without their repeated lines; see ``line_bitmaps`` and ``apply_bitmaps``."""
    names = {k: options[k] for k in ("id_col", "text_col") if k in options}
    return apply_bitmaps(docs, line_bitmaps(docs, **options), **names)
