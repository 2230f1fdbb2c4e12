"""Best-fit packing of token pieces into sequences (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, scratch, small_batches, stage, sub_batches, tidied
from loomgrid.llm.tokens import SLICE_BYTES, shipped

#: Pieces packed together.  Each shard may leave one sequence half empty, so larger shards waste
#: less; a shard is one task's work, so its size doesn't depend on the data's.
SHARD_PIECES = 8_192
#: Sequences filled less than this are packed again, those of many shards together.
FILLED = 0.98
#: Of tokens, documents and attention cost in norms and products.
WEIGHTS = (1.0, 0.05, 0.05)


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold: tokens, documents (pieces) and attention cost, which is the sum of
    squared piece lengths.  Left out, the last two are as large as the tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def best_fit(lengths: np.ndarray, capacities: Capacities, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece by vector best-fit, longest pieces first.

    A piece demands (length, 1, length squared).  Of the open sequences whose residual vector
    covers the demand in every dimension, rule ``norm`` takes the one with the least weighted norm
    of what would remain, ``dot`` the one with the greatest weighted dot product of demand and
    residual, both relative to the capacities; ties go to the sequence opened first.  Where none
    fits, one is opened.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule {rule!r}: norm or dot")
    cap, w = capacities.vector(), np.asarray(weights, np.float64)
    n_pieces = len(lengths)
    seq, off = np.zeros(n_pieces, np.int64), np.zeros(n_pieces, np.int64)
    if not n_pieces:
        return seq, off
    if lengths.max() > cap[0] or int(lengths.max()) ** 2 > cap[2]:
        raise ValueError("a piece exceeds the capacities")
    left = np.empty((3, n_pieces), np.int64)  # residuals of the open sequences, by age
    name = np.empty(n_pieces, np.int64)
    n_open = opened = 0
    least = int(lengths.min())
    scale = (w / cap.astype(np.float64) ** 2)[:, None]
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        need = np.array([[n], [1], [n * n]], np.int64)
        rest = left[:, :n_open] - need
        at = np.flatnonzero((rest >= 0).all(0))
        if len(at):
            if rule == "norm":
                k = int(at[((rest[:, at].astype(np.float64) ** 2) * scale).sum(0).argmin()])
            else:
                k = int(at[((left[:, at] * need) * scale).sum(0).argmax()])
        else:
            k, n_open, opened = n_open, n_open + 1, opened + 1
            left[:, k], name[k] = cap, opened - 1
        seq[i], off[i] = name[k], cap[0] - left[0, k]
        left[:, k] -= need[:, 0]
        if left[0, k] < least or left[1, k] < 1 or left[2, k] < least * least:  # nothing more fits
            left[:, k : n_open - 1] = left[:, k + 1 : n_open]
            name[k : n_open - 1] = name[k + 1 : n_open]
            n_open -= 1
    return seq, off


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: all of ``most`` tokens but the first."""
    head = n % most or min(n, most)
    return [(0, head), *((s, most) for s in range(head, n, most))] if n else []


def token_pieces(docs: DataFrame, tokenizer_path: str, most: int, *, id_col: str, text_col: str, end_id: int, keep_ids: bool) -> DataFrame:
    """A row per piece: document, piece, start, length, CRC-32 of its ids and, if asked, the ids."""
    make = shipped(docs.sparkSession, tokenizer_path)
    rows = pick(docs, id=id_col, text=text_col)
    end = np.array([end_id], "<u4").tobytes()
    fields = [T.StructField("id", rows.schema["id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            of, out = [], []
            for i, ids in enumerate(enc.encode([x or "" for x in b.column("text").to_pylist()])):
                ids += end
                for p, (s, n) in enumerate(cut(len(ids) >> 2, most)):
                    part = ids[4 * s : 4 * (s + n)]
                    of.append(i)
                    out.append((p, s, n, zlib.crc32(part), part))
            cols = [b.column("id").take(pa.array(of, pa.int64()))] + [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([x[4] for x in out], pa.binary())] * keep_ids, schema.names)

    small_batches(docs.sparkSession)
    return rows.mapInArrow(tidied(run), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacities: Capacities = Capacities(), *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences within the capacities.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with
    ``keep_ids``, ``ids`` (little-endian unsigned 32-bit).  A document is its ids and ``end_id``;
    only longer ones are cut, the first piece taking what the full ones leave.  Full pieces are
    sequences of their own; the others are dealt at random, however alike, into shards of bounded
    size, and each shard is packed by ``best_fit``.  What lies in sequences that a shard left
    less than ``FILLED`` is dealt into fewer shards and packed again, as long as that saves any.
    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each;
    an empty table gives an empty result; other columns are left behind.  A bound on attention cost
    must leave room for a full piece.
    """
    most = min(capacities.tokens, int(np.sqrt(capacities.vector()[2])))
    pieces = token_pieces(docs, tokenizer_path, most, id_col=id_col, text_col=text_col, end_id=end_id, keep_ids=keep_ids)
    with scratch() as kept:
        pieces = stage(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
        alone = F.col("length") == capacities.tokens
        small = pieces.where(~alone)
        shards, deal = max(1, -(-small.count() // SHARD_PIECES)), 0
        placed = stage(_filled(small, shards, deal, capacities, weights, rule), "placed")
        while shards > 1:
            by = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.count("*").alias("n")).where(F.col("filled") < FILLED * capacities.tokens)
            loose, sequences = by.agg(F.sum("n"), F.count("*")).first()
            if not loose or -(-loose // SHARD_PIECES) >= shards:
                break
            shards, deal = -(-loose // SHARD_PIECES), deal + 1
            again = stage(_filled(placed.join(by, "sequence_id", "left_semi"), shards, deal, capacities, weights, rule), "again")
            if again.select("sequence_id").distinct().count() >= sequences:
                break
            placed = stage(placed.join(by, "sequence_id", "left_anti").unionByName(again), "placed")
        kept += [pieces, placed]
    names = [c for c in pieces.columns if c != "uid"]
    full = pieces.where(alone).select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = pieces.where(~alone).join(placed.drop("length"), "uid").select(*names, "sequence_id", "offset")
    return full.unionByName(packed).withColumnRenamed("id", id_col)


def _filled(pieces: DataFrame, shards: int, deal: int, capacities: Capacities, weights: tuple[float, float, float], rule: str) -> DataFrame:
    """``uid, length, sequence_id, offset`` of pieces, dealt into shards; ``deal`` numbers the turn."""

    def fill(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("uid")
        seq, off = best_fit(shard.column("length").to_numpy(), capacities, weights, rule)
        base = (deal << 44 | key[0].as_py()) << 14  # a shard has fewer than 2^14 pieces
        return shard.select(["uid", "length"]).append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off))

    dealt = pieces.select("uid", "length").withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(deal)), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(fill, "uid long, length long, sequence_id long, offset long")
