"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import components, digest, written

#: Words of a shingle, similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Tries of the forest, hashes of a full label, and the recall that bounds how far labels are shortened.
TRIES, DEPTH, RECALL = 16, 8, 0.999
#: Share of equal 8-bit hashes (of all TRIES * DEPTH) below which a pair is no candidate: five standard deviations
#: below the similarity of a link.
LEAST_MATCH = 0.62
#: Members of a bucket, and documents or shingles of a group of candidates, that one task compares at a time.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 2048, 1024, 1_000_000
WORD = regex.compile(r"[\p{L}\p{N}]+")


def depth_for(recall: float, similarity: float, tries: int, depth: int) -> int:
    """Labels start at full depth and are shortened until pairs at the threshold meet in some trie with the target
    probability."""
    while depth > 1 and 1 - (1 - similarity ** depth) ** tries < recall:
        depth -= 1
    return depth


class Shingler:
    """Shingle sets as sorted 64-bit hashes."""

    def __init__(self):
        self.kept: dict[str, int] = {}

    def tokens(self, words: list[str]) -> np.ndarray:
        kept = self.kept
        if len(kept) > 1_000_000:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """Runs of ``WORDS`` words in lower case; a text with fewer words is one shingle, one without words none."""
        h = self.tokens(WORD.findall(text.lower())) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        if len(h) < WORDS:
            return np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64)
        out = np.zeros(len(h) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            out = (out ^ h[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 1 << 63, (TRIES * DEPTH, 1), np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, (TRIES * DEPTH, 1), np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """32-bit minima of the set under each hash function, in pieces of bounded size."""
    out = np.full(TRIES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(shingles), 4096):
        x = shingles[None, a:a + 4096]
        np.minimum(out, (((x * MULTIPLY + ADD) >> np.uint64(32)).astype(np.uint32)).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    """``id``, ``digest``, ``n`` (shingles), ``set`` (128 bits of the set), ``labels`` (a 64-bit hash of the shortened
    label of each trie) and ``bits`` (8 bits of each minimum)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))

    def run(batches):
        shingle = Shingler()
        for whole in batches:
            for b in slices(whole, "text"):
                n, ids, labels, bits = [], [], [], []
                for text in b.column("text").to_pylist():
                    s = shingle(text)
                    n.append(len(s))
                    ids.append(xxhash.xxh128_digest(s.tobytes()))
                    m = minhash(s)
                    heads = np.ascontiguousarray(m.reshape(TRIES, DEPTH)[:, :prefix])
                    labels.append([xxhash.xxh64_intdigest(r.tobytes(), t) - (1 << 63) for t, r in enumerate(heads)])
                    bits.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("digest"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(labels, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["id", "digest", "n", "set", "labels", "bits"])

    return rows.mapInArrow(run, "id long, digest long, n long, set binary, labels array<long>, bits binary")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, by repeated minima over the edges."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def grouped(batches, keys: int):
    """Rows of a sorted stream of batches, one record batch a group; the first ``keys`` columns name the group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in range(keys):
            v = b.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held:
            change[0] = any(held[-1].column(c)[held[-1].num_rows - 1] != b.column(c)[0] for c in range(keys))
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if a < b.num_rows and change[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Splits groups of several blocks: each row goes to every pair of blocks that its own is part of, so any two
    rows of a group meet in some task, and none holds more than two blocks. Adds ``x``, ``y`` and ``own``."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    out = out.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", blocks)
    return out.repartition(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y", "node")


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that span all pairs which share a label in a trie and enough hashes. ``reps``: ``node``,
    ``labels``, ``bits``."""
    named = reps.select("node", F.posexplode("labels").alias("trie", "label"))
    full = (named.groupBy("trie", "label").agg(F.count("*").alias("members")).where("members > 1")
            .withColumn("blocks", F.ceil(F.col("members") / BUCKET_BLOCK).cast("int")).drop("members"))
    rows = named.join(full, ["trie", "label"]).join(reps.select("node", "bits"), "node")
    rows = dealt(rows.select("trie", "label", "node", "bits", "blocks"), ["trie", "label"], "blocks")

    def run(batches):
        for g in grouped(batches, 4):
            if g.num_rows < 2:
                continue
            node = g.column("node").to_numpy()
            own, x, y = g.column("own").to_numpy(), g.column("x")[0].as_py(), g.column("y")[0].as_py()
            m = np.frombuffer(b"".join(g.column("bits").to_pylist()), np.uint8).reshape(len(node), -1)
            left, right = [], []
            for i in range(len(node) - 1):
                same = (m[i + 1:] == m[i]).mean(axis=1) >= LEAST_MATCH
                if x != y:
                    same &= own[i + 1:] != own[i]
                hit = np.flatnonzero(same)
                left.append(np.full(len(hit), i))
                right.append(hit + i + 1)
            a, b = np.concatenate(left), np.concatenate(right)
            root = roots(len(node), a, b)
            far = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    return rows.select("trie", "label", "x", "y", "node", "own", "bits").mapInArrow(run, "a long, b long").distinct()


def verified(rows: DataFrame) -> DataFrame:
    """Exact comparison of all members of each group (``component``, ``blocks``, ``node``, ``copies``, ``text``).

    Returns ``a``, ``b``, ``links``: for each node, its number of linked documents in other sets (``b`` null), and
    edges that span the linked nodes (``links`` null).
    """
    rows = dealt(rows.select("component", "node", "copies", "text", "blocks"), ["component"], "blocks")

    def run(batches):
        shingle = Shingler()
        for g in grouped(batches, 3):
            node, copies = g.column("node").to_numpy(), g.column("copies").to_numpy()
            own, x, y = g.column("own").to_numpy(), g.column("x")[0].as_py(), g.column("y")[0].as_py()
            sets = [shingle(t.as_py()) for t in g.column("text")]
            sizes = np.array([len(s) for s in sets])
            flat, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(place, kind="stable")
            by, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(flat)))])
            links, left, right, at = np.zeros(len(sets), np.int64), [], [], 0
            for i in range(len(sets)):
                mine = place[at:at + sizes[i]]
                at += sizes[i]
                length = starts[mine + 1] - starts[mine]
                ends = np.cumsum(length)
                pick = np.arange(ends[-1]) - np.repeat(ends - length - starts[mine], length)
                common = np.bincount(by[pick], minlength=len(sets))
                # the same set of shingles in integers: |A & B| >= s |A | B|
                near = common * 10 >= SIMILARITY_10 * (sizes + sizes[i] - common)
                near[:i + 1] = False
                if x != y:
                    near &= own != own[i]
                hit = np.flatnonzero(near)
                links[i] += copies[hit].sum()
                links[hit] += copies[i]
                left.append(np.full(len(hit), i))
                right.append(hit)
            root = roots(len(sets), np.concatenate(left), np.concatenate(right))
            far = np.flatnonzero(root != np.arange(len(sets)))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[some], node[far]])),
                 pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[root[far]], pa.int64())]),
                 pa.concat_arrays([pa.array(links[some], pa.int64()), pa.nulls(len(far), pa.int64())])], ["a", "b", "links"])

    return rows.select("component", "x", "y", "node", "own", "copies", "text").mapInArrow(run, "a long, b long, links long")


SIMILARITY_10 = round(SIMILARITY * 10)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least ``SIMILARITY`` of their sets of word shingles.

    One row for each different row of ``docs``: ``id``, ``digest`` (of the text), ``class_id`` (the smallest id that
    links lead to) and ``n_links`` (other documents with a similarity of at least ``SIMILARITY``, counted exactly among
    all that the forest brings into one group of candidates).

    Documents with equal sets are one node with a number of copies, found by a combinable minimum. The forest keeps
    only labels that several nodes share. It is banding of a fixed depth: ``depth_for`` takes it from constants, not from
    the data, and no prefixes are matched. Buckets
    yield spanning edges, not pairs; the groups that these form are compared exactly, all members with all, in blocks,
    and only counts and spanning edges leave a task. A text without words is linked with nothing; a shorter text than
    a shingle is one shingle; rows with one id and different texts are one document; null ids form no link and stay
    alone (``class_id`` null); an empty table gives an empty result.
    """
    prefix = depth_for(RECALL, SIMILARITY, TRIES, DEPTH)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    signed = written(signatures(rows, id_col, text_col, prefix), "signatures")
    useful = signed.where("n > 0 AND id IS NOT NULL")
    sets = useful.groupBy("set").agg(F.min("id").alias("node"), F.countDistinct("id").alias("copies"))
    nodes = written(sets, "sets")
    heads = useful.withColumnRenamed("set", "s").join(nodes, (F.col("s") == nodes["set"]) & (F.col("id") == F.col("node")))
    reps = heads.select("node", "set", "copies", "n", "labels", "bits", "digest").dropDuplicates(["set"])
    reps = written(reps, "nodes")
    # one id may hold several sets (rows with one id and different texts): its sets are then one node of the forest
    groups = written(components(candidates(reps.select("node", "labels", "bits"))), "groups")
    load = (groups.join(reps.select("node", "n"), "node").groupBy("component")
            .agg(F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("blocks")))
    members = reps.select("node", "copies", "digest").join(groups, "node").join(load, "component")
    texts = rows.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")) \
        .withColumn("digest", digest(F.col("text"))).dropDuplicates(["node", "digest"])
    found = written(verified(members.join(texts, ["node", "digest"])), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.where("b IS NOT NULL").select("a", "b"))
    per_set = (nodes.join(links, "node", "left").join(classes, "node", "left")
               .select("set", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    return (signed.dropDuplicates(["id", "digest"]).join(per_set, "set", "left")
            .select("id", "digest",
                    F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("class_id"),
                    F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("copies") - 1 + F.col("links"))
                    .otherwise(F.lit(0)).cast("long").alias("n_links")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id. Rows with null ids stay."""
    keep = similar(docs, id_col, text_col).where("id IS NULL OR id = class_id").select(
        F.col("id").alias("_kid"), F.col("digest").alias("_kdigest"))
    return docs.join(keep, docs[id_col].eqNullSafe(F.col("_kid")) & (digest(docs[text_col]) == F.col("_kdigest")), "left_semi")
