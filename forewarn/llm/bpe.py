"""Byte-level BPE: merges are replayed over all words of a task's share of the corpus, in rank order."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encoded words, stretches and pairs that a task keeps between batches, at most; beyond it the older half goes. Longer ones than
#: ``KEPT_CHARS`` are encoded where they are met and never kept, so what is kept is bounded in bytes for text without spaces too.
KEPT_WORDS, KEPT_STRETCHES, KEPT_PAIRS, KEPT_CHARS = 400_000, 200_000, 400_000, 48
#: Words whose merges are replayed together: their symbols stay in the processor's cache.
REPLAYED = 16_384
#: Text that is encoded at a time, in bytes: what a task holds of its share of the corpus.
AT_ONCE = 2 << 20
#: Stretches of a text. They end before a single space between two other characters, where the pattern of byte-level
#: BPE always begins a new match, so each can be split on its own.
STRETCH = re.compile(r"(?:\A\s*| )?\S+(?:(?:[^\S ]\s*| \s+)\S+)*(?:\s+\Z)?|\s+")


def younger(known: dict, most: int) -> dict:
    """The dictionary, or once it is full the younger half of what it may hold."""
    return known if len(known) <= most else dict(islice(known.items(), len(known) - most // 2, None))


def kept(known: dict, new: list[str], most: int) -> dict:
    """What may stay until the next batch: nothing long, and at most ``most``."""
    for k in new:
        if len(k) > KEPT_CHARS:
            del known[k]
    return younger(known, most)


class Vocabulary:
    """Ranks of byte strings, and the pattern that splits a text into words."""

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern
        self.ranks: dict[bytes, int] | None = None

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: base64 of a token and its rank in each line. Tasks get its content with the broadcast, so
        only the driver needs the file."""
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def load(self) -> Vocabulary:
        if self.ranks is None:
            pairs = (line.split() for line in self.lines.splitlines() if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
            self.bytes_of: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
            for t, r in self.ranks.items():
                self.bytes_of[r] = t
            self.split = regex.compile(self.pattern).findall
            self.first = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
            self.pairs: dict[int, int] = {}
            self.words: dict[str, bytes] = {}
            self.stretches: dict[str, bytes] = {}
            starts = np.full(65536, -1, np.int64)
            for a in range(256):
                for b in range(256):
                    starts[a << 8 | b] = self.ranks.get(bytes((a, b)), -1)
            self.starts = starts
        return self

    def __getstate__(self):
        return {"lines": self.lines, "pattern": self.pattern, "ranks": None}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word. All words lie in one row of symbols; ``at`` is the inverted index from a pair, named by
        the rank of its merge, to the places of its left symbol. The lowest rank is merged at all its places, left
        to right, and only the two neighbours of a place are looked up again. A merge that opens a lower rank puts
        the rest of its places back, so each word goes through the same merges as it would alone."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(flat)
        tok = self.first[flat].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            if e:
                nxt[e - 1] = -1
                if e < n:
                    prv[e] = -1
        pair = np.full(n, -1, np.int64)
        if n > 1:
            pair[:-1] = self.starts[flat[:-1].astype(np.int64) << 8 | flat[1:]]
            pair[ends[ends > 0] - 1] = -1
        places = np.flatnonzero(pair >= 0)
        places = places[np.argsort(pair[places], kind="stable")]
        found, begin = np.unique(pair[places], return_index=True)
        at: dict[int, list[int]] = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, begin[1:]))} if len(found) else {}
        rank = pair.tolist()  # of the pair that starts at a place now
        heap = list(at)
        heapify(heap)
        pairs, ranks, bytes_of = self.pairs, self.ranks, self.bytes_of
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        while heap:
            r = heappop(heap)
            todo = at.pop(r, None)
            if todo is None:
                continue
            todo.sort()
            for k, i in enumerate(todo):
                if rank[i] != r:
                    continue
                j = nxt[i]
                tok[i], tok[j], rank[j] = r, -1, -1
                right, left, lower = nxt[j], prv[i], False
                nxt[i] = right
                rank[i] = -1
                if right >= 0:
                    prv[right] = i
                    b = tok[right]
                    q = pairs.get(r << 32 | b)
                    if q is None:
                        q = pairs[r << 32 | b] = ranks.get(bytes_of[r] + bytes_of[b], -1)
                    if q >= 0:
                        rank[i] = q
                        lower = q < r
                        if q in at:
                            at[q].append(i)
                        else:
                            at[q] = [i]
                            heappush(heap, q)
                if left >= 0:
                    a = tok[left]
                    q = pairs.get(a << 32 | r)
                    if q is None:
                        q = pairs[a << 32 | r] = ranks.get(bytes_of[a] + bytes_of[r], -1)
                    rank[left] = q
                    if q >= 0:
                        lower = lower or q < r
                        if q in at:
                            at[q].append(left)
                        else:
                            at[q] = [left]
                            heappush(heap, q)
                if lower and k + 1 < len(todo):
                    at[r] = todo[k + 1:]
                    heappush(heap, r)
                    break
        left_over = np.array(tok, np.int64)
        stays = left_over >= 0
        packed = left_over[stays].astype("<u4").tobytes()
        stops = (np.concatenate([[0], np.cumsum(stays)])[ends] * 4).tolist()
        return [packed[x:y] for x, y in zip([0, *stops], stops)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [STRETCH.findall(t) if t else [] for t in texts]
        known = self.stretches
        new = list(set().union(*cut).difference(known))
        parts = [self.split(s) for s in new]
        learnt = self.learn(set().union(*parts))
        word = self.words.__getitem__
        known.update(zip(new, (b"".join(map(word, p)) for p in parts)))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        self.words = kept(self.words, learnt, KEPT_WORDS)
        self.stretches = kept(known, new, KEPT_STRETCHES)
        return out

    def learn(self, words: set[str]) -> list[str]:
        """Replay the words that are not known yet, and name them."""
        new = list(words.difference(self.words))
        for a in range(0, len(new), REPLAYED):
            some = new[a:a + REPLAYED]
            self.words.update(zip(some, self.replay([w.encode() for w in some])))
        return new

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, one row at least."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", packed: bool = False,
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text_col`` as ``ids_col`` (a column of that name is replaced): an array, or
    with ``packed`` the ids as little-endian 32-bit numbers in one binary value.

    Each match of the pattern is encoded separately, as a text without special tokens. Words do not depend on each
    other, so the merges are replayed over the words that a task meets, once for each distinct word of about 2 MB of
    text, and no word is shuffled. A null or empty text has no ids; texts are whole whatever their length; repeated
    rows repeat their ids; ids are those of the rank file, which must hold all single bytes. With ``decoded_col`` the ids are
    decoded by the same task, as by ``decode``, and the text is left out: one process for each task, one vocabulary, no ids
    sent back and forth.
    """
    left_out = (ids_col, decoded_col, text_col) if decoded_col else (ids_col,)
    rows = [f for f in docs.schema.fields if f.name not in left_out]
    fields = [*rows, T.StructField(ids_col, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False), False)]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.BinaryType(), False))
    schema = T.StructType(fields)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f.name for f in rows]

    def run(batches):
        v = shared.value.load()
        for whole in batches:
            for b in slices(whole, text_col, AT_ONCE):
                got = v.encode(b.column(text_col).to_pylist())
                if packed:
                    ids = pa.array(got, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in got)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
                made = [ids]
                if decoded_col:
                    made.append(pa.array([v.decode(np.frombuffer(x, "<i4").tolist()) for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of ``ids_col``, an array or packed, as ``out_col``; null ids give no bytes, an unknown
    id fails."""
    kept = [f for f in rows.schema.fields if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.BinaryType(), False)])
    packed = isinstance(rows.schema[ids_col].dataType, T.BinaryType)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f.name for f in kept]

    def numbers(ids) -> list[int]:
        if not ids.is_valid:
            return []
        return (np.frombuffer(ids.as_py(), "<i4") if packed else ids.values.to_numpy()).tolist()

    def run(batches):
        v = shared.value.load()
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                out = pa.array([v.decode(numbers(ids)) for ids in b.column(ids_col)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), out], [*names, out_col])

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Number of ids, and hexadecimal SHA-256 of the packed ids and of the decoded bytes."""
    return rows.select(id_col, (F.octet_length(ids_col) / 4).cast("long").alias("n_tokens"),
                       F.sha2(ids_col, 256).alias("ids_sha256"), F.sha2(decoded_col, 256).alias("decoded_sha256"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers
    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)
