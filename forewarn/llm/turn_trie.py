"""Prefix trie of conversations: rebuilt turn sequences are sorted in range shards, nodes are runs of rows with an equal prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole, written
from forewarn.operators.joining import join_dimension

#: Columns of the padded matrix that are sorted at a time, and turns of a shard.
WIDTH, SHARD_TURNS = 32, 1 << 20
#: Conversations of a block, and how many turns its first one can lend.
BLOCK, LENT = 100, 5


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``seq``, its turns in order as (digest of role and text, code points of the text).

    Rows go by ``turn``, null first; equal turns by their digest. Null role or text is empty. Rows without a ``conv_id``
    belong to no conversation and are left out. A turn is 16 bytes of SHA-256 from here on, so no text is shuffled and
    a conversation takes about 30 bytes a turn in one row.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", digest.alias("d"), F.char_length(text).alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"], t["chars"])).alias("seq"))


def lent_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (LENT + 1)).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation begins with as many turns of its block's first one as its id's checksum says, if there are so many."""
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.slice("seq", 1, LENT).alias("head"))
    h = lent_turns(F.col("conv_id"))
    met = own.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "block", "left")
    head = F.when(F.col("head").isNull(), F.slice("seq", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return met.select("conv_id", F.concat(head, F.slice("seq", h + 1, F.size("seq"))).alias("seq"))


def ends(rows: DataFrame) -> DataFrame:
    """Of each ``key``: how many ids it has, the least, and the digest of all in ascending order.

    The digest is sequential, so the ids of one key are read by one task, as a sorted stream that is never held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # key, count, least id, running digest
        for b in batches:
            keys, ids = b.column("key").to_pylist(), b.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            done = []
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                told = ",".join(map(str, ids[x:y])).encode()
                if now and now[0] == keys[x]:
                    now[1] += y - x
                    now[3].update(b"," + told)
                else:
                    if now:
                        done.append((now[0], now[1], now[2], now[3].hexdigest()))
                    now = [keys[x], y - x, ids[x], hashlib.sha256(told)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "n", "least", "sha"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now[:3], now[3].hexdigest())], ["key", "n", "least", "sha"])

    return rows.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, n long, least long, sha string")


def sorted_rows(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their turn codes (above 0), a shorter row before its extensions, and the turns each has in common with
    the row before it. Rows differ.

    Rows are padded with 0 to a matrix of ``WIDTH`` columns and sorted; only rows that go on are padded and sorted again, within
    the rows that were equal so far, so a long row does not widen the others."""
    n = len(sizes)
    order, common, group = np.argsort(sizes > 0, kind="stable"), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for base in range(0, int(sizes.max(initial=0)), WIDTH):
        pos = np.flatnonzero(sizes[order] > base)
        rows = order[pos]
        wide = np.zeros((len(rows), WIDTH), np.int64)
        for k in range(WIDTH):
            longer = np.flatnonzero(sizes[rows] > base + k)
            if not len(longer):
                break
            wide[longer, k] = codes[starts[rows[longer]] + base + k]
        by = np.lexsort((sizes[rows] > base + WIDTH, *wide.T[::-1], group[pos]))  # one that ends here before those that go on
        wide, order[pos] = wide[by], rows[by]
        changed = np.logical_or.accumulate(wide[1:] != wide[:-1], axis=1)
        same = (group[pos[1:]] == group[pos[:-1]])
        common[pos[1:][same]] = base + WIDTH - changed.sum(axis=1)[same]
        group[pos] = np.concatenate([[0], np.cumsum(~same | changed[:, -1])])
    return order, common


def shard_nodes(digests: np.ndarray, chars: np.ndarray, sizes: np.ndarray, n: np.ndarray, least: np.ndarray, sha: np.ndarray) -> Iterator[dict]:
    """Nodes of a shard by depth, deepest first, as columns. Those on the path of its first or last row may go on in a neighbour:
    they are told by ``key``, the digest of their prefix, and hold only what lies off these paths."""
    hi, lo = digests[:, 0], digests[:, 1]
    by = np.lexsort((lo, hi))
    codes = np.empty(len(hi), np.int64)
    codes[by] = 1 + np.concatenate([[0], np.cumsum((hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1]))])[:len(by)]
    starts = np.cumsum(sizes) - sizes
    order, common = sorted_rows(codes, starts, sizes)
    sizes, starts, n, least, sha = sizes[order], starts[order], n[order], least[order], sha[order]
    last = len(order) - 1

    def keys(row: int) -> list[bytes]:
        state, out = hashlib.sha256(), []
        for d in digests[starts[row]:starts[row] + sizes[row]]:
            out.append(state.copy().digest()[:16])
            state.update(d.astype(">u8").tobytes())
        return [*out, state.digest()[:16]]

    first_keys, last_keys = keys(0), keys(last)
    by_size = np.argsort(sizes, kind="stable")
    at_least = np.searchsorted(sizes[by_size], np.arange(int(sizes.max()) + 2))
    below = None  # the nodes one deeper
    for depth in range(int(sizes.max()), -1, -1):
        rows = np.sort(by_size[at_least[depth]:])
        begin = np.flatnonzero(common[rows] < depth) if depth else np.array([0])
        top = rows[begin]
        node = {"pos": top, "n_convs": np.add.reduceat(n[rows], begin), "conv_id": np.minimum.reduceat(least[rows], begin)}
        node["chars"] = chars[starts[top] + depth - 1] if depth else np.zeros(1, np.int64)
        node["sha"] = np.where(sizes[top] == depth, sha[top], None)
        on_first, on_last = top == 0, np.zeros(len(top), bool)
        on_last[-1] = sizes[last] >= depth
        node["shared"] = on_first | on_last
        node["key"] = [first_keys[depth] if f else last_keys[depth] if e else None for f, e in zip(on_first, on_last)] if node["shared"].any() else [None] * len(top)
        for c in ("n_children", "n_leaves", "saved"):
            node[c] = np.zeros(len(top), np.int64)
        if below is not None:
            parent = np.searchsorted(top, below["pos"], "right") - 1
            own = ~below["shared"]
            np.add.at(node["n_children"], parent[own], 1)
            np.add.at(node["n_leaves"], parent[own], below["n_leaves"][own])
            np.add.at(node["saved"], parent[own], below["saved"][own])
            yield below | {"depth": depth + 1, "parent": np.where(node["shared"][parent], None, node["conv_id"][parent]),
                           "parent_key": [node["key"][p] for p in parent.tolist()]}
        whole_node = ~node["shared"]
        node["n_leaves"] += whole_node & (node["n_children"] == 0)
        node["saved"] += np.where(whole_node, (node["n_convs"] - 1) * node["chars"], 0)
        below = node
    yield below | {"depth": 0, "parent": np.full(1, None), "parent_key": [None]}


PART = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "sha string, chars long, key binary, parent_key binary")


def shards(rows: DataFrame, count: int) -> DataFrame:
    """Nodes of each of ``count`` ranges of the distinct sequences: ``key`` is null where a node is complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        seq = t.column("seq").combine_chunks()
        seq = seq.chunk(0) if isinstance(seq, pa.ChunkedArray) else seq
        turns = seq.flatten()
        digests = np.frombuffer(b"".join(turns.field("d").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        sizes = np.diff(seq.offsets.to_numpy()).astype(np.int64)
        nodes = shard_nodes(digests, turns.field("chars").to_numpy(zero_copy_only=False).astype(np.int64), sizes, t.column("n").to_numpy(),
                            t.column("least").to_numpy(), np.array(t.column("sha").to_pylist(), object))
        for d in nodes:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(d["pos"]), d["depth"], np.int64)), pa.array(d["conv_id"]), pa.array(list(d["parent"]), pa.int64()),
                pa.array(d["n_convs"]), pa.array(d["n_children"]), pa.array(d["n_leaves"]), pa.array(d["saved"]),
                pa.array(list(d["sha"]), pa.string()), pa.array(d["chars"]), pa.array(d["key"], pa.binary()), pa.array(d["parent_key"], pa.binary())],
                ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha", "chars", "key", "parent_key"])

    return rows.repartitionByRange(count, "seq").mapInArrow(run, PART)


def recombined(shared: DataFrame) -> DataFrame:
    """Nodes on the boundaries, whole again: their parts add up, then each adds to its parent what only the whole node shows, that is
    whether it is a leaf and the tokens it saves itself. At most the depth of two rows for each shard, so one task holds them."""
    parts = shared.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("sha").alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.to_pandas() for b in batches if b.num_rows]
        if not held:
            return
        rows = pd.concat(held).sort_values("depth", ascending=False).to_dict("records")
        at = {r["key"]: r for r in rows}
        for r in rows:
            r["n_leaves"] += r["n_children"] == 0
            r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
            if up := at.get(r["parent_key"]):
                up["n_children"] += 1
                up["n_leaves"] += r["n_leaves"]
                up["saved_tokens"] += r["saved_tokens"]
        names = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha", "key"]
        columns = [pa.array([r[c] for r in rows], pa.binary() if c == "key" else pa.string() if c == "sha" else pa.int64()) for c in names]
        parents = pa.array([at[r["parent_key"]]["conv_id"] if r["parent_key"] in at else None for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, parents], [*names, "parent_conv_id"])

    schema = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string, key binary, parent_conv_id long"
    return parts.coalesce(1).mapInArrow(run, schema)


def trie(sequenced: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``seq`` (one row for each ``conv_id``, ids differ), from the textless root on.

    Equal sequences collapse first, so what many conversations share is one row; the distinct ones are dealt in ranges of their
    order, and a first turn that a third of them share spreads over many ranges. Returns ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in its subtree), ``saved_tokens`` (code points that
    a shared prefix saves, summed over its subtree) and ``ends_sha256`` (of the ids that end here, ascending, comma-joined). An empty
    table has no nodes, a conversation without turns is a member of the root.
    """
    key = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t["d"])), ""), 256))
    keyed = written(sequenced.select("conv_id", key.alias("key"), "seq"), "sequences")
    distinct = keyed.groupBy("key").agg(F.first("seq").alias("seq")).join(ends(keyed.select("key", "conv_id")), "key")
    rows = written(distinct.select("seq", "n", "least", "sha"), "distinct")
    total, count = rows.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0)), F.count("*")).first()
    spread = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // 2000))
    nodes = written(shards(rows, max(1, spread, -(-total // SHARD_TURNS))), "nodes")
    edge = written(recombined(nodes.where("key IS NOT NULL")), "edge")
    inner = nodes.where("key IS NULL").drop("key", "chars")
    above = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below_edge = join_dimension(inner.where("parent_key IS NOT NULL"), above, ["parent_key"]).withColumn("parent_conv_id", F.col("above"))
    out = inner.where("parent_key IS NULL").unionByName(below_edge.drop("above")).drop("parent_key").unionByName(edge.drop("key"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
