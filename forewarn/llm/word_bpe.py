"""BPE with word ends over a table of distinct words: each is encoded once, ids go back to their positions by joins."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import slices
from forewarn.session import work_path

#: Text whose distinct words are numbered together, in bytes; one text at least.
AT_ONCE = 12 << 20
#: Runs of a text without these characters; no step before the split joins what they part.
RUN = re.compile(r"[^ \n\t\r]+")
#: Letters that every Unicode version composes, lowers and classes alike.
COMMON = re.compile(r"[!-~\xA1-\u017F]*")
END = "</w>"
#: Entries of a part of the distinct-word table: a word counts once for each batch that has it.
PART_WORDS = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Pieces, merges, special tokens and the word pattern of a tokenizer file."""

    def __init__(self, text: str):
        self.text, self.merges = text, None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Tasks get the file's content with the broadcast, so only the driver needs the file."""
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def load(self) -> Vocabulary:
        if self.merges is None:
            held = json.loads(self.text)
            model, ids = held["model"], held["model"]["vocab"]
            self.special = {a["content"]: a["id"] for a in held["added_tokens"]}
            self.pieces: list[str | None] = [None] * (1 + max(chain(ids.values(), self.special.values())))
            for piece, i in chain(ids.items(), self.special.items()):
                self.pieces[i] = piece
            self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
            pattern = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.split = regex.compile(pattern).findall
            letters = byte_letters()
            letters_of = {c: b for b, c in enumerate(letters)}
            self.bytes_of = letters_of.__getitem__
            # The library composes and splits runs of other letters as its own Unicode tables say; no model is needed for it.
            self.rare = Tokenizer.from_str(json.dumps(held | {"model": model | {"vocab": {}, "merges": []}}))
            self.inner, self.last = [ids.get(c) for c in letters], [ids.get(c + END) for c in letters]
            self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        return self

    def __getstate__(self):
        return {"text": self.text, "merges": None}

    def words(self, run: str) -> list[str]:
        """Words of a run as they are encoded: special tokens whole, the rest composed, in lower case and split."""
        if "<|" not in run:
            return self.plain(run)
        return list(chain.from_iterable([p] if p in self.special else self.plain(p) for p in self.parts(run)))

    def plain(self, run: str) -> list[str]:
        if COMMON.fullmatch(run):
            return self.split(run.lower())
        cut = self.rare.pre_tokenizer.pre_tokenize_str(self.rare.normalizer.normalize_str(run))
        return [bytes(map(self.bytes_of, w)).decode() for w, _ in cut]

    def encode(self, word: str) -> list[int]:
        """Ids of one word. The merge of least rank, the leftmost of them, comes first; only its neighbours are looked up
        again, so a word of n bytes takes n log n steps."""
        if word in self.special:
            return [self.special[word]]
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[b] for b in raw[-1:]]
        ids = [i for i in ids if i is not None]
        merges, n = self.merges, len(ids)
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        if not heap:
            return ids
        heap = [(rank, i, new) for rank, new, i in heap]
        heapify(heap)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        while heap:
            rank, i, new = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # a neighbour has been merged since
            ids[i], ids[j] = new, -1
            after[i] = j = after[j]
            if j >= 0:
                before[j] = i
                if m := merges.get((new, ids[j])):
                    heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heappush(heap, (m[0], h, m[1]))
        return [i for i in ids if i >= 0]


def packed_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the top bit set on all but the last; and the bytes of each number."""
    x = x.astype(np.uint32)
    size = 1 + sum((x >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        m = size > k
        out[start[m] + k] = (x[m] >> np.uint32(7 * k)) & 127 | ((size[m] > k + 1).astype(np.uint8) << 7)
    return out, size


def unpacked_numbers(packed: bytes) -> np.ndarray:
    b = np.frombuffer(packed, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * shift), starts)


def numbered(texts: Iterable[str | None], words: Callable[[str], list[str]]) -> tuple[list[bytes], list[str]]:
    """The number of the word at each position of each text, packed, and the distinct words by number, frequent ones first."""
    number: dict[str, int] = {}
    runs: dict[str, tuple[int, ...]] = {}
    flat, sizes = [], []
    for text in texts:
        cut = RUN.findall(text) if text else []
        for r in set(cut).difference(runs):
            runs[r] = tuple(number.setdefault(w, len(number)) for w in words(r))
        flat.append(np.fromiter(chain.from_iterable(map(runs.__getitem__, cut)), np.int32))
        sizes.append(len(flat[-1]))
    every = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    order = np.argsort(-np.bincount(every, minlength=len(number)), kind="stable")
    rank = np.empty(len(number), np.int64)
    rank[order] = np.arange(len(number))
    out, size = packed_numbers(rank[every])
    cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
    known = list(number)
    return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [known[i] for i in order.tolist()]


def coded(docs: DataFrame, vocabulary, row: T.StructType, text_col: str) -> DataFrame:
    """Documents as numbers of their batch's distinct words, and one row of words for each batch, as a table that is bucketed
    by batch: what is joined to it later meets it without moving it."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("row", row), T.StructField("numbers", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value.load().words
        batch = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, "text", AT_ONCE):
                numbers, known = numbered(b.column("text").to_pylist(), words)
                rows, n = b.column("row"), b.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch] * (n + 1), pa.int64()), pa.concat_arrays([rows, pa.nulls(1, rows.type)]),
                    pa.array([*numbers, None], pa.binary()), pa.array([None] * n + [known], pa.list_(pa.string()))], schema.names)
                batch += 1

    kept = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in row.fields)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    name, path = f"coded_{uuid.uuid4().hex}", work_path(spark, "coded")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept.mapInArrow(run, schema).write.bucketBy(buckets, "batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def shares(words: list[str], count: int) -> dict[int, list[str]]:
    """Words by the part of the distinct-word table that holds them, each part's in order."""
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(crc32(w.encode()) % count, []).append(w)
    return {k: sorted(v) for k, v in out.items()}


def dealt(table: DataFrame, parts: int) -> DataFrame:
    """A row for each batch and part of the distinct-word table: the batch's words there, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for home, words in zip(b.column("batch").to_pylist(), b.column("words").to_pylist()):
                cut = shares(words, parts)
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(list(cut), pa.int32()), pa.array([home] * len(cut), pa.int64()),
                                                      pa.array(list(cut.values()), pa.list_(pa.string()))], ["part", "home", "words"])

    return table.where("words IS NOT NULL").select("batch", "words").mapInArrow(run, "part int, home long, words array<string>")


def encoded_parts(entries: DataFrame, vocabulary) -> DataFrame:
    """The distinct words of each part, which no other part has, encoded once; each batch gets the ids of its words back, and how
    many each has."""
    def run(table: pa.Table) -> pa.Table:
        encode = vocabulary.value.load().encode
        lists = table.column("words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        known = [encode(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        known = [np.array(x, "<u4").tobytes() for x in known]
        at, ends = coded.indices.to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
        ids, lengths = [], []
        for x, y in zip(ends, ends[1:]):
            ids.append(packed_numbers(np.frombuffer(b"".join(map(known.__getitem__, at[x:y].tolist())), "<u4"))[0].tobytes())
            lengths.append(packed_numbers(sizes[at[x:y]])[0].tobytes())
        return pa.Table.from_arrays([table.column("home"), table.column("part"), pa.array(ids, pa.binary()), pa.array(lengths, pa.binary())],
                                    ["home", "part", "ids", "sizes"])

    return entries.groupBy("part").applyInArrow(run, "home long, part int, ids binary, sizes binary")


def texts_of(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Id-to-piece join of a batch of token rows, and the pieces of each list joined by a space; unknown ids are passed over."""
    known = pc.and_(pc.less(ids.values, len(pieces)), pc.greater_equal(ids.values, 0))
    found = pieces.take(pc.if_else(known, ids.values, pa.scalar(None, pa.int32())))
    lists = pa.ListArray.from_arrays(ids.offsets, found)
    return pc.binary_join(lists if found.null_count == 0 else pa.array(
        [[p for p in x if p is not None] for x in lists.to_pylist()], lists.type), " ")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", packed: bool = False,
           decoded_col: str | None = None) -> DataFrame:
    """The columns of ``docs`` but its text, with the token ids of ``text_col`` as ``ids_col``: an array, or with ``packed``
    little-endian 32-bit numbers in one binary value. With ``decoded_col`` also the text that ``decode`` gives for them.

    Words are split where the documents are read; a document then is the numbers of its words within a batch of about
    12 MB of text. The batches' distinct words are dealt to the parts of a table of all distinct words, where each is encoded once
    in the whole corpus, and their ids go back to their batches, where positions are looked up. No position and no text is shuffled:
    the numbers lie in a table bucketed by batch. A word that all batches hold is one entry a batch, so no word is hot, and
    the table has as many parts as keep one at about ``PART_WORDS`` entries.

    A null or empty text has no ids; texts are whole whatever their length; repeated rows repeat their ids; columns named
    like ``ids_col`` or ``decoded_col`` are replaced; an empty table gives none. No special tokens are added, but those in
    a text are known, as by the tokenizers library.
    """
    row = T.StructType([f for f in docs.schema.fields if f.name not in (text_col, ids_col, decoded_col)])
    out = [*row.fields, T.StructField(ids_col, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False), False)]
    if decoded_col:
        out.append(T.StructField(decoded_col, T.StringType(), False))
    if not row.fields:
        raise ValueError("documents need a column besides their text to be told apart")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    table = coded(docs, shared, row, text_col)
    total = table.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))
    found = encoded_parts(dealt(table, parts), shared)
    names = [f.name for f in out]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = next((w for w in left.column("words").to_pylist() if w is not None), [])
        cut, ids_of = shares(words, parts), {}
        for part, ids, sizes in zip(*(right.column(c).to_pylist() for c in ("part", "ids", "sizes"))):
            raw = unpacked_numbers(ids).astype("<u4").tobytes()
            ends = np.cumsum(unpacked_numbers(sizes) * 4).tolist()
            ids_of.update(zip(cut[part], (raw[x:y] for x, y in zip([0, *ends], ends))))
        known = [ids_of[w] for w in words]
        docs = left.filter(pc.is_valid(left.column("numbers"))).combine_chunks()
        got = [b"".join(map(known.__getitem__, unpacked_numbers(x).tolist())) for x in docs.column("numbers").to_pylist()]
        rows = docs.column("row").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in got)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(got), "<i4")),
                                         type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
        made = [pa.array(got, pa.binary()) if packed else lists]
        if decoded_col:
            made.append(texts_of(lists, pa.array(shared.value.load().pieces, pa.string())))
        return pa.Table.from_arrays([*rows.flatten(), *made], names)

    return table.groupBy("batch").cogroup(found.groupBy("home")).applyInArrow(run, T.StructType(out))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the array or packed ``ids_col`` as ``out_col``: every id is joined to its piece, in a table
    as large as the vocabulary that all tasks hold, and the pieces of a row are joined by a space, as the library does for a
    tokenizer without a decoder. Word ends stay visible. Null ids give an empty text, ids of no piece are passed over."""
    kept = [f for f in rows.schema.fields if f.name != out_col]
    packed = isinstance(rows.schema[ids_col].dataType, T.BinaryType)
    names = [f.name for f in kept]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value.load().pieces, pa.string())
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                given = b.column(ids_col).to_pylist()
                lists = [np.zeros(0, "<i4") if x is None else np.frombuffer(x, "<i4") if packed else np.array(x, "<i4") for x in given]
                ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                flat = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists) if lists else np.zeros(0, "<i4")))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts_of(flat, pieces)], [*names, out_col])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.StringType(), False)]))


def public_vocabulary(name: str = "word_bpe_49k.json") -> Vocabulary:
    import public_tokenizers
    return Vocabulary.read(public_tokenizers.path(name))
