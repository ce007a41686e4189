"""Suffix-array dedup: repeated byte strings go, found by prefix-free parsing of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import whole, written
from .forest_join import grouped

#: Bytes of a repeated string, and of the rolling hash that triggers a phrase.
LENGTH, GRAM = 100, 32
#: Distinct phrases around one trigger whose suffixes are sorted in one task; the suffixes of more are sorted by Spark.
TOGETHER = 4096
#: Stands for a null id: smaller than all others.
NO_ID = -(2 ** 63)
_B = np.uint64(0xD6E8FEB86659FD93)


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def rolling(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hash of the string of each length at each place, built from strings of doubled lengths; places whose string
    leaves the data hold nothing of use."""
    h = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
    h[1] ^= h[1] >> np.uint64(31)
    top = 1
    while top * 2 <= max(lengths):
        h[top * 2] = joined(h[top], h[top], top, top)
        top *= 2
    out = []
    for n in lengths:
        size = 1 << (n.bit_length() - 1)
        got, done = h[size], size
        while done < n:
            size = 1 << ((n - done).bit_length() - 1)
            got, done = joined(got, h[size], done, size), done + size
        got = got ^ (got >> np.uint64(32))
        got *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(got ^ (got >> np.uint64(29)))
    return out


def joined(a: np.ndarray, b: np.ndarray, gap: int, size: int) -> np.ndarray:
    out = a * power(size)
    out[:-gap] += b[gap:]
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each place and the width - 1 after it (fewer at the end)."""
    got, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        got[:-step] = np.minimum(got[:-step], got[step:])
        done += step
    return got


def phrases(data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Parses texts that lie side by side: the phrase of each run of strings with one trigger.

    The trigger of a string of ``LENGTH`` bytes is the least rolling hash in it, the first of equals, so equal strings
    have it at the same place, wherever they stand. A phrase is a run of starts with the same trigger, with all bytes
    of its strings. Returns, for each, its document, start and number of starts, the trigger's hash, and the hash of
    the phrase.
    """
    gram, string = rolling(data, (GRAM, LENGTH))
    places = len(data)
    bits = np.uint64(max(1, places.bit_length()))
    ranked = (gram >> bits << bits) | np.arange(places, dtype=np.uint64)
    trigger = (least(ranked, LENGTH - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(ends - begins - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(begins)), counts)
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[doc]
    if not len(p):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    at = trigger[p]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(new, len(p)))
    s, e = p[new], p[new + n - 1]
    key = gram[at[new]].view(np.int64)
    # the first and the last string of a phrase cover it
    inside = (string[s] * np.uint64(3) + (string[e] ^ (string[e] >> np.uint64(17))) * power(7)
              + (n * 256 + at[new] - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc[new], s - begins[doc[new]], n, key, (inside ^ (inside >> np.uint64(30))).view(np.int64)


def instances(docs: DataFrame) -> DataFrame:
    """``g``, ``h``, ``id``, ``mark``, ``start``, ``n``, ``again``: the phrases of about 2 MB of texts, the first of
    each kind only; the others are surely repeated (``again``), in rows of their own."""
    def run(batches):
        for whole_batch in batches:
            for b in slices(whole_batch, "text", 2 << 20):
                ids, marks = b.column("id").to_numpy(), b.column("mark").to_numpy()
                text = b.column("text").cast(pa.binary())
                ends_all = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends_all[0]:ends_all[-1]]
                begins, ends = ends_all[:-1] - ends_all[0], ends_all[1:] - ends_all[0]
                if len(data) < LENGTH:
                    continue
                doc, start, n, g, h = phrases(data, begins, ends)
                order = np.lexsort((start, marks[doc], ids[doc], h, g))
                doc, start, n, g, h = (x[order] for x in (doc, start, n, g, h))
                same = np.concatenate([[False], (g[1:] == g[:-1]) & (h[1:] == h[:-1])])
                # a row given twice is not a repetition of itself
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
                own = (ids[doc] == ids[doc[head]]) & (marks[doc] == marks[doc[head]]) & (start == start[head])
                again = same & ~own
                keep = ~same | again
                doc, start, n, g, h, again = (x[keep] for x in (doc, start, n, g, h, again))
                g = np.where(again, ids[doc] * 31 + start, g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array(ids[doc], pa.int64()), pa.array(marks[doc], pa.int32()),
                     pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(again)],
                    ["g", "h", "id", "mark", "start", "n", "again"])

    return docs.mapInArrow(run, "g long, h long, id long, mark int, start int, n int, again boolean")


def contexts(rows: DataFrame) -> DataFrame:
    """The bytes of each listed phrase (``phrases`` of a text), as the dictionary: ``g``, ``members``, ``id``, ``mark``,
    ``start``, ``bytes``."""
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                g, members, ids, marks, starts, data = [], [], [], [], [], []
                for row in part.to_pylist():
                    text = row["text"].encode()
                    for x in row["phrases"]:
                        g.append(x["g"])
                        members.append(x["members"])
                        ids.append(row["id"])
                        marks.append(row["mark"])
                        starts.append(x["start"])
                        data.append(text[x["start"]:x["start"] + x["n"] - 1 + LENGTH])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.int64()), pa.array(members, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.int32()),
                     pa.array(starts, pa.int32()), pa.array(data, pa.binary())], ["g", "members", "id", "mark", "start", "bytes"])

    return rows.mapInArrow(run, "g long, members long, id long, mark int, start int, bytes binary")


def ordered(dictionary: DataFrame) -> DataFrame:
    """Strings of the dictionary that are not the first of their kind: ``id``, ``mark``, ``start``, ``stop``.

    ``dictionary`` comes sorted by trigger. The suffixes of all phrases around a trigger are put in order by their
    first ``LENGTH`` bytes, equal ones in the order of the corpus, which the parse gives as document and start.
    """
    def run(batches):
        for g in grouped(batches, 1):
            sizes = np.array([len(x.as_py()) for x in g.column("bytes")])
            flat = np.frombuffer(b"".join(g.column("bytes").to_pylist()), np.uint8)
            counts = sizes - LENGTH + 1
            member = np.repeat(np.arange(len(sizes)), counts)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            place = offset + np.repeat(np.cumsum(sizes) - sizes, counts)
            suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[place]).view(f"V{LENGTH}").ravel()
            kind = np.unique(suffix, return_inverse=True)[1]
            ids, marks, start = (g.column(c).to_numpy()[member] for c in ("id", "mark", "start"))
            start = start + offset
            order = np.lexsort((start, marks, ids, kind))
            first = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            own = (ids[order] == ids[order[head]]) & (marks[order] == marks[order[head]]) & (start[order] == start[order[head]])
            late = order[~own]
            late = late[np.lexsort((start[late], member[late]))]
            if not len(late):
                continue
            new = np.flatnonzero(np.concatenate([[True], (member[late][1:] != member[late][:-1]) | (start[late][1:] != start[late][:-1] + 1)]))
            last = np.append(new[1:], len(late)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[late[new]], pa.int64()), pa.array(marks[late[new]], pa.int32()), pa.array(start[late[new]], pa.int32()),
                 pa.array(start[late[last]] + LENGTH, pa.int32())], ["id", "mark", "start", "stop"])

    return dictionary.mapInArrow(run, "id long, mark int, start int, stop int")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Byte spans that repeat an earlier string of ``LENGTH`` bytes: ``id``, ``mark``, ``start``, ``stop``."""
    corpus = Window.partitionBy("g", "h").orderBy("id", "mark", "start")
    around = Window.partitionBy("g")
    place = F.struct("id", "mark", "start")
    marked = (instances(rows).repartition("g")
              .withColumn("first", F.first(place).over(corpus)).withColumn("row", F.row_number().over(corpus))
              .withColumn("low", F.min(F.when(~F.col("again"), F.col("h"))).over(around))
              .withColumn("high", F.max(F.when(~F.col("again"), F.col("h"))).over(around))
              .withColumn("late", F.col("again") | (place != F.col("first")))
              .withColumn("open", (F.col("row") == 1) & ~F.col("again") & (F.col("low") != F.col("high")))
              .where("late OR open").select("g", "id", "mark", "start", "n", "late"))
    marked = written(marked, "phrases")
    known = marked.where("late").select("id", "mark", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop"))
    heads = marked.where("NOT late")
    sizes = heads.groupBy("g").agg(F.count("*").alias("members"))
    lists = (heads.join(sizes, "g").groupBy("id", "mark")
             .agg(F.collect_list(F.struct("g", "members", "start", "n")).alias("phrases")))
    dictionary = written(contexts(rows.join(lists, ["id", "mark"])), "dictionary")
    few = dictionary.where(F.col("members") <= TOGETHER).drop("members").repartition("g").sortWithinPartitions("g")
    # a trigger with very many phrases: one row for each suffix, in order by Spark, spread by the suffix itself
    many = (dictionary.where(F.col("members") > TOGETHER)
            .select("id", "mark", "start", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)).alias("i"))
            .select("id", "mark", (F.col("start") + F.col("i")).alias("start"), F.substring("bytes", F.col("i") + 1, F.lit(LENGTH)).alias("suffix")))
    head = many.groupBy("suffix").agg(F.min(place).alias("first"))
    late = many.join(head, "suffix").where(place != F.col("first")).select("id", "mark", "start", (F.col("start") + LENGTH).alias("stop"))
    return known.union(ordered(few)).union(late)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans`` (columns of these names
    are replaced).

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller id, or in the same
    document before. Strings are judged on the input, overlaps count, and none crosses a text. Phrases that occur as a
    whole before are settled by the minimum over their hash (two hashes of 64 bits in all); only the first of each
    kind, around triggers that have several kinds, has its suffixes sorted, by their bytes. A null or empty text, and
    one shorter than ``LENGTH`` bytes, stays as it is; a null id is smaller than all others; rows that repeat an id
    and a text share one result and are no repetitions of each other; rows with one id and different texts are in the
    order of a hash of the text.
    """
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    columns = [c for c in docs.columns if c not in added]
    identity = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.hash(whole(F.col(text_col))).alias("mark")]
    rows = docs.select(*identity, whole(F.col(text_col)).alias("text"))
    spans = repeated_spans(rows).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    keyed = docs.select(F.struct(*columns).alias("_row"), *identity).join(spans, ["id", "mark"], "left")
    flat = keyed.select(*[F.col("_row").getField(c).alias(c) for c in columns], F.col("spans").alias("_spans"))
    schema = T.StructType([docs.schema[c] for c in columns]).add("kept", "binary").add("n_bytes", "long") \
        .add("n_removed", "long").add("n_spans", "long")

    def run(batches):
        for whole_batch in batches:
            for b in slices(whole_batch, text_col):
                kept, counts = [], []
                for text, spans in zip(b.column(text_col), b.column("_spans")):
                    data = (text.as_py() or "").encode()
                    n, removed, runs = len(data), 0, 0
                    if spans.is_valid:
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, spans.values.field("start").to_numpy(), 1)
                        np.add.at(edge, spans.values.field("stop").to_numpy(), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed = int(gone.sum())
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    kept.append(data)
                    counts.append((n, removed, runs))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in columns), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in zip(*counts))],
                    [*columns, *added])

    return flat.mapInArrow(run, schema)
