"""Exact top-k search by tiled matrix products (operator 4)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, stage, tidied

#: Queries multiplied at once and candidates of one tile; bytes of queries that one pass broadcasts.
BLOCK_QUERIES, TILE_ROWS, PASS_BYTES = 512, 2048, 32 << 20
_EXACT = 2**53


def usable(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector is neither null nor empty and has no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def quantise(df: DataFrame, scale: int, *, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector``: each component x as floor(scale * x), x as double.

    The whole numbers stay doubles: they are exact, and one beyond 2^53 doesn't wrap.
    """
    rows = usable(pick(df, id=id_col, vector=vector_col))
    return rows.select("id", F.transform("vector", lambda x: _floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"))


def _floor(x):
    """Floor as a double; a double of 2^52 or more is whole already and may not fit a long."""
    return F.when(F.abs(x) < F.lit(float(2**52)), F.floor(x).cast("double")).otherwise(x)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; one beyond 64 bits is an error, for its rank would be lost."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object)
    s = whole(q) @ whole(c).T
    if s.size and not (-(2**63) < s.min() and s.max() < 2**63):
        raise OverflowError("an inner product exceeds 64 bits; use a smaller scale")
    return s.astype(np.int64)


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the ``k`` best scores, of equal ones the first columns.

    Partial selection finds the k-th score; what is above it is taken, and of what equals it as
    many as are wanted, so ties are exact however many there are.
    """
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    cut = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, level = scores > cut, scores == cut
    level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(scores), k)


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows for each query: ``query_id, rank, vec_id, score``.

    ``rows`` and ``queries`` are as ``quantise`` returns them.  A query row never matches rows of
    its own id, and vectors of another length than its own take no part.  Ties go to the smaller
    id; a query with fewer rows gets all; rows with a null id take no part; a repeated row is a
    candidate as often as it stands there, and a repeated query is answered once.  An empty side
    gives an empty result.

    Queries are dealt into blocks; passes run one after the other, each with blocks of about
    ``PASS_BYTES``, and write their lists before the next one's blocks are gathered.
    Every task multiplies its tiles with each block, selects per tile, and keeps one list per
    query; lists meet in a tree: by query and a part of the tasks first, then by query.
    """
    spark = rows.sparkSession
    asked = queries.where("id is not null").dropDuplicates(["id"])
    candidates = rows.where("id is not null")
    width = asked.select(F.max(F.size("vector"))).first()[0] or 0
    ids_kind, total = asked.schema["id"].dataType, asked.count()
    empty = spark.createDataFrame([], T.StructType([T.StructField("query_id", ids_kind), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", ids_kind), T.StructField("score", T.LongType())]))
    if not total or not width:
        return empty
    passes = max(1, -(-total * (width + 1) * 8 // PASS_BYTES))
    found: DataFrame | None = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else asked
        sent = spark.sparkContext.broadcast(_blocks(part.toArrow()))  # about PASS_BYTES, by the count above
        one = stage(_pass(candidates, sent, k), "topk")
        sent.destroy()  # the driver and the executors hold one pass at a time
        found = one if found is None else found.unionByName(one)
    tree = found
    merged = _merge(_merge(tree, ["query_id", F.pmod(F.col("task"), F.lit(16)).alias("task")], k), ["query_id"], k)
    out = merged.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select(F.col("query_id").cast(ids_kind).alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").cast(ids_kind).alias("vec_id"), (-F.col("b.minus")).alias("score"))


def _merge(lists: DataFrame, by: list, k: int) -> DataFrame:
    """One list of at most ``k`` out of those of each group; entries order by (minus score, id)."""
    return lists.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


_ENTRY = T.ArrayType(T.StructType([T.StructField("minus", T.LongType()), T.StructField("id", T.LongType())]))


def _blocks(asked: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of equal vector lengths: ids, vectors."""
    ids = asked.column("id").cast(pa.int64()).to_numpy()
    col = asked.column("vector").combine_chunks()
    sizes, flat = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), col.flatten().to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, []
    for length in np.unique(sizes):
        mine = np.flatnonzero(sizes == length)
        mine = mine[np.argsort(ids[mine])]
        for i in range(0, len(mine), BLOCK_QUERIES):
            own = mine[i : i + BLOCK_QUERIES]
            out.append((ids[own], flat[starts[own][:, None] + np.arange(length)]))
    return out


_NONE = np.iinfo(np.int64).min  # no score


def _pass(candidates: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    arrow = pa.list_(pa.struct([("minus", pa.int64()), ("id", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        blocks = sent.value
        held = [(np.full((len(i), k), _NONE), np.zeros((len(i), k), np.int64)) for i, _ in blocks]

        def tile(ids: np.ndarray, vectors: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            for b, (qids, q) in enumerate(blocks):
                if q.shape[1] != vectors.shape[1]:
                    continue
                s = _scores(q, vectors)
                s[qids[:, None] == ids] = _NONE  # a query's own rows
                at = best_of(s, k)
                ms = np.concatenate([held[b][0], np.take_along_axis(s, at, 1)], axis=1)
                mi = np.concatenate([held[b][1], ids[at]], axis=1)
                top = np.lexsort((mi, ~ms), axis=1)[:, :k]  # ~x falls as x grows, without overflow
                held[b] = np.take_along_axis(ms, top, 1), np.take_along_axis(mi, top, 1)

        for b in batches:
            for start in range(0, b.num_rows, TILE_ROWS):
                part = b.slice(start, TILE_ROWS)
                ids = part.column("id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                col = part.column("vector")
                sizes = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for length in np.unique(sizes):
                    mine = np.flatnonzero(sizes == length)
                    tile(ids[mine], flat[starts[mine][:, None] + np.arange(length)])
        for (qids, _), (ms, mi) in zip(blocks, held):
            there = ms != _NONE
            lens = there.sum(1)
            some = lens > 0
            if some.any():
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens[some])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(-ms[there]), pa.array(mi[there])], ["minus", "id"])).cast(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(qids[some]), pa.array([task] * int(some.sum()), pa.int32()), lists], ["query_id", "task", "best"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("best", _ENTRY)])
    return candidates.mapInArrow(tidied(run), schema)
