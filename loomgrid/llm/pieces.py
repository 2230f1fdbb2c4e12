"""SentencePiece encoding with byte spans, and decoding (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgrid.llm._common import pick, sub_batches
from loomgrid.llm.charmap import BYTE, Model
from loomgrid.llm.tokens import SLICE_BYTES, PieceEncoder, shipped


def piece_widths(model: Model) -> np.ndarray:
    """Bytes of normalised text that each piece stands for; an unknown piece (-1) has no fixed width."""
    return np.array([1 if k == BYTE else -1 if k == 2 else len(p.encode()) if k in (1, 4) else 0 for p, k in zip(model.pieces, model.kinds)], np.int64)


def spans(model: Model, widths: np.ndarray, text: str, ids: np.ndarray) -> np.ndarray:
    """Start and end, in the original text's bytes, of each piece.

    The pieces tile the normalised text, whose alignment gives the places.  A run of unknown
    characters is one piece without fixed width; it takes what the others leave where only one
    stands in the text, else the characters up to where the next known piece fits.
    """
    normal, at = model.normalise(text)
    w = widths[ids]
    if (w < 0).any():
        w, pos = w.copy(), 0
        known = [model.pieces[i].encode() for i in ids]
        for k in range(len(ids)):
            if w[k] < 0:
                after = b"".join(known[j] for j in range(k + 1, len(ids)) if widths[ids[j]] >= 0) if k + 1 < len(ids) and widths[ids[k + 1]] >= 0 else b""
                first = known[k + 1] if after else b""
                end = normal.find(first, pos + 1) if first else len(normal)
                w[k] = (len(normal) if end < 0 else end) - pos
            pos += int(w[k])
    ends = np.cumsum(w)
    if len(ids) and ends[-1] != len(normal):
        raise ValueError("the pieces don't tile the normalised text")
    starts = ends - w
    return np.stack([at[starts], at[ends]], 1) if len(ids) else np.zeros((0, 2), np.int64)


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ("ids", "spans", "decoded")) -> DataFrame:
    """Encode every whole text as the sentencepiece library does, with spans, and decode it again.

    Returns ``doc_id, n_tokens, covered, ids_sha256, decoded_sha256`` and what ``keep`` names:
    ``ids array<int>``, ``spans array<struct<start,end>>`` (bytes of the original text, one per
    id) and ``decoded string``.  ``covered`` is the number of original bytes that the spans cover.
    A null or empty text has no ids and decodes to the empty text; a null id stays null; repeated
    rows are encoded each; an empty table gives an empty result; other columns are left behind.
    """
    make, keep = shipped(docs.sparkSession, model_path), list(keep)
    rows = pick(docs, id=id_col, text=text_col)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kinds = {"ids": T.ArrayType(T.IntegerType()), "spans": T.ArrayType(span), "decoded": T.StringType()}
    schema = T.StructType(
        [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + [T.StructField(k, kinds[k]) for k in keep]
    )
    arrow = {"ids": pa.list_(pa.int32()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "decoded": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        assert isinstance(enc, PieceEncoder)
        widths = piece_widths(enc.spec)
        names = [str(i) for i in range(len(enc.spec.pieces))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            texts = [x or "" for x in b.column("text").to_pylist()]
            packed = [np.frombuffer(x, "<u4") for x in enc.encode(texts)]
            lists = [x.tolist() for x in packed]
            decoded = [enc.model.decode(x) if x else "" for x in lists]
            placed = [spans(enc.spec, widths, t, i) for t, i in zip(texts, packed)]
            cols = [
                b.column("id"),
                pa.array(map(len, lists), pa.int64()),
                pa.array([int((p[:, 1] - p[:, 0]).sum()) for p in placed], pa.int64()),
                pa.array([sha(",".join([names[i] for i in x])) for x in lists], pa.string()),
                pa.array(map(sha, decoded), pa.string()),
            ]
            more = {"ids": lists, "decoded": decoded, "spans": [[{"start": s, "end": e} for s, e in p.tolist()] for p in placed] if "spans" in keep else None}
            yield pa.RecordBatch.from_arrays(cols + [pa.array(more[k], arrow[k]) for k in keep], schema.names)

    return rows.mapInArrow(run, schema)
