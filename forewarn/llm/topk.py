"""Exact top-k by inner product: local score lists, a safe cutoff, and what can still pass it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a block of candidates or queries, and slices of the components: each slice is one list of scores.
BLOCK, SLICES = 2048, 4
#: Whole numbers up to this size are exact in a double.
EXACT = 2 ** 53
#: Cutoff of a query with fewer than k gathered scores: no score is lower.
NO_CUTOFF = -(2 ** 63)
#: Components of the pairs that are resolved at a time.
RESOLVED = 1 << 22


def numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of each component. Null vectors and those with a null, infinite or undefined
    component are left out, as are rows without an id."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def blocked(rows: DataFrame, name: str, extra: str | None = None) -> DataFrame:
    """Rows packed to blocks of about ``BLOCK`` vectors of one size: ``<name>_block``, ``dim``, the packed ids and
    components, and the packed numbers of the column ``extra``. Blocks are dealt by a hash of the id."""
    from .forest_join import grouped
    blocks = max(1, -(-rows.count() // BLOCK))
    keyed = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    keyed = keyed.repartition("b", "dim").sortWithinPartitions("b", "dim", "id")
    columns = ["id", *([extra] if extra else [])]
    names = [f"{name}_block", "dim", *(f"{name}_{c}" for c in columns), f"{name}_v"]

    def pack(batches):
        for g in grouped(batches, 2):
            for a in range(0, g.num_rows, 2 * BLOCK):
                part = g.slice(a, 2 * BLOCK)
                packed = [part.column(c).to_numpy().astype("<i8").tobytes() for c in columns]
                flat = np.concatenate([c.flatten().to_numpy() for c in part.column("v").chunks]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0)[0].as_py()], pa.int32()), pa.array([part.column(1)[0].as_py()], pa.int32()),
                     *(pa.array([x], pa.binary()) for x in [*packed, flat])], names)

    kinds = ", ".join(f"{n} {'int' if n.endswith(('block', 'dim')) else 'binary'}" for n in names)
    return keyed.select("b", "dim", *columns, "v").mapInArrow(pack, kinds)


def unpack(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}_id"], "<i8")
    return ids, np.frombuffer(row[f"{name}_v"], "<i8").reshape(len(ids), row["dim"])


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these are exact, else in 64-bit integers."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    return q @ c.T  # within 64 bits, see fits


def fits(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> None:
    """Fail where the score of a pair, or a sum on the way to it, might leave 64 bits; nothing that counts wraps."""
    x, y = (np.sqrt((v.astype(float) ** 2).sum(axis=1)) for v in (q, c))
    if x.max(initial=0) * y.max(initial=0) >= 2.0 ** 63 and ((x[:, None] * y[None, :] >= 2.0 ** 63) & ~own).any():
        raise OverflowError("inner products leave 64 bits: choose a smaller scale")


def scores_of(q: np.ndarray, c: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Whole scores of the open pairs alone; the others stay 0 and are not looked at."""
    whole = np.zeros(open_.shape, np.int64)
    i, j = np.nonzero(open_)
    step = max(1, RESOLVED // max(1, q.shape[1]))
    for a in range(0, len(i), step):
        x, y = i[a:a + step], j[a:a + step]
        whole[x, y] = np.einsum("nd,nd->n", q[x], c[y])
    return whole


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest k of a list with their ids, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)
        pick = np.concatenate([over, ties[np.argsort(ids[ties], kind="stable")][:k - len(over)]])
        scores, ids = scores[pick], ids[pick]
    order = np.lexsort((ids, -scores))
    return scores[order], ids[order]


def cuts(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, SLICES + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def lists(pairs: DataFrame, k: int) -> DataFrame:
    """First phase: in each block every slice of the components is a list of partial scores, of which the k highest are gathered. Only
    the vectors that these name are scored whole, and each block lists its k best."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                qi, q = unpack(row, "q")
                ci, c = unpack(row, "c")
                own = qi[:, None] == ci[None, :]
                fits(q, c, own)
                named = np.zeros((len(qi), len(ci)), bool)
                for s in cuts(row["dim"]):
                    part = product(q[:, s], c[:, s])
                    part[own] = np.iinfo(np.int64).min
                    if len(ci) > k:
                        np.put_along_axis(named, np.argpartition(part, len(ci) - k, axis=1)[:, -k:], True, axis=1)
                    else:
                        named[:] = True
                named &= ~own
                yield answers(qi, ci, scores_of(q, c, named), named, k)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def answers(qi, ci, whole, open_, k) -> pa.RecordBatch:
    """For each query the k best of its open candidates; an id with several vectors takes one place."""
    q, v, s = [], [], []
    repeated = len(np.unique(ci)) < len(ci)
    for i in range(len(qi)):
        hit = np.flatnonzero(open_[i])
        scores, ids = whole[i, hit], ci[hit]
        if repeated:
            order = np.lexsort((-scores, ids))
            ids, first = np.unique(ids[order], return_index=True)
            scores = scores[order][first]
        scores, ids = best(scores, ids, k)
        q.append(np.full(len(ids), qi[i]))
        v.append(ids)
        s.append(scores)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (q, v, s)],
                                      ["query_id", "vec_id", "score"])


def resolved(pairs: DataFrame, k: int) -> DataFrame:
    """Second and third phase: a vector whose whole score reaches the cutoff has a partial score of at least cutoff / slices in some
    slice, so the entries of each list from there on are collected; the vectors they name, and no others, are scored whole,
    and each block gives the k best of those that reach the cutoff."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                qi, q = unpack(row, "q")
                ci, c = unpack(row, "c")
                own = qi[:, None] == ci[None, :]
                fits(q, c, own)
                limit = np.frombuffer(row["q_cutoff"], "<i8")[:, None]
                least = -((-(limit + 1)) // SLICES) - 1  # at most cutoff / slices, without leaving 64 bits
                passed = np.zeros((len(qi), len(ci)), bool)
                for s in cuts(row["dim"]):
                    passed |= product(q[:, s], c[:, s]) >= least
                passed &= ~own
                whole = scores_of(q, c, passed)
                yield answers(qi, ci, whole, passed & (whole >= limit), k)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def met(q: DataFrame, c: DataFrame, q_blocks: int, c_blocks: int) -> DataFrame:
    """Each block of queries next to each block of candidates, by a shuffled join. A block is a megabyte in one value, which Spark takes for
    a small row: left to itself it would send all copies of the query blocks through the driver."""
    left = q.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    return left.hint("merge").join(right.hint("merge"), ["q_block", "c_block", "dim"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other vectors of its size, ties to the smaller
    id: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; all there are, if fewer.

    Components become floor(scale * x). Vectors that are null or hold null, infinite or undefined components take no
    part; the query's own id is no candidate; rows that repeat an id and a vector count once, and an id with several
    vectors has its best score. The cutoff of a query is the k-th of its gathered whole scores (the lowest number if
    there are fewer), so nothing that belongs to the answer is below it; the cutoffs travel with the blocks of
    queries, not by broadcast. Each block of queries meets each block of candidates once in either pass, and a block
    returns at most k rows for a query. Scores that might leave 64 bits are an error.
    """
    rows = written(numbers(vectors, id_col, vector_col, scale).distinct(), "vectors")
    asked = written(numbers(queries, id_col, vector_col, scale).distinct(), "queries")
    c = written(blocked(rows, "c"), "blocks")
    c_blocks, q_blocks = (max(1, -(-x.count() // BLOCK)) for x in (rows, asked))

    def top(found: DataFrame) -> DataFrame:
        return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)

    kth = top(lists(met(blocked(asked, "q"), c, q_blocks, c_blocks), k)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    cutoff = kth.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("s")).alias("cutoff"))
    limited = written(asked.join(cutoff.hint("merge"), "id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NO_CUTOFF))), "cutoffs")
    return top(resolved(met(blocked(limited, "q", "cutoff"), c, q_blocks, c_blocks), k)).select("query_id", "rank", "vec_id", "score")
