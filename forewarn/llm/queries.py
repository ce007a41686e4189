"""The registered queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, filter_audit, forest_join, langid, line_dedup, suffix_dedup, topk, turn_trie, warc, word_bpe, wrappers
from .common import table
from forewarn.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return wrap


@query("op2_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each document and item that it holds; clean documents have none."""
    found = decontam.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.count("*").alias("n_overlaps"), F.max("n_equal").alias("n_equal"))


@query("op1_chat_formatting", r"""
WITH extra(conv_id, turn, role, text) AS (
  VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM extra)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
              + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    told = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.threads(turns.unionByName(extra)))
    read = out.withColumn("said", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask")))
    lines = F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op4_exact_top_k", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return topk.search(v, v.where("vec_id % 50 = 0"), 5)


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf, "documents")
    model = langid.fit(docs, langid.public_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op8_warc", r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "archives")
    warc.write(table(spark, sf, "pages"), path)
    return warc.read(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, bpe.public_vocabulary(), packed=True, decoded_col="decoded"))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each document: its class, and its number of links."""
    out = forest_join.similar(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    out = wrappers.main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_filter_interaction_audit", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
told AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN told ON d.doc_id = told.doc_id),
orders(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(filter_order, x)),
steps AS (
  SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS own, substr(filter_order, 1, s - 1) AS before
  FROM orders, range(1, 6) r(s) WHERE length(filter_order) = 5),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
seen AS (
  SELECT *, contains(fails, own) AS bad, translate(fails, before, '') = fails AS reached FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE reached AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE reached AND bad), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE NOT reached AND bad), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE reached AND bad), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE reached AND bad), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flags(table(spark, sf, "documents"), table(spark, sf, "labels")))


@query("op12_conversation_prefix_trie", r"""
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars,
         substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM t),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.pos, d, chars FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.pos <= h
  UNION ALL SELECT i.conv_id, 1, t.pos, d, chars FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.pos > h),
seqs AS (
  SELECT i.conv_id, coalesce(list(d ORDER BY part, pos) FILTER (WHERE d IS NOT NULL), []) AS ds,
         coalesce(list(chars ORDER BY part, pos) FILTER (WHERE d IS NOT NULL), []) AS cs
  FROM ids i LEFT JOIN rebuilt r ON i.conv_id = r.conv_id GROUP BY i.conv_id),
prefixes AS (SELECT conv_id, ds, cs, unnest(range(0, len(ds) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT ds[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(cs[depth], 0)) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ds) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ds[1:depth], depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
ways AS (SELECT path, chars, n_convs, n_children, unnest(range(0, depth + 1)) AS up FROM known),
below AS (
  SELECT path[1:up] AS path, (count(*) FILTER (WHERE n_children = 0))::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM ways GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM known n JOIN below b ON n.path = b.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return turn_trie.trie(turn_trie.rebuilt(turn_trie.sequences(table(spark, sf, "conversations"))))


@query("op13_bpe")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digests(word_bpe.encode(docs, word_bpe.public_vocabulary(), packed=True, decoded_col="decoded"))
