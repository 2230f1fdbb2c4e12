"""Context-triggered piecewise hashing (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, shuffle_partitions, stage, sub_batches

#: Bytes of the rolling window, smallest block size, and most characters of a signature.
WINDOW, MIN_BLOCK, MOST = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SLICE_BYTES = 4 << 20
_BASE = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


def rolling(data: bytes) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at each place (fewer at the start)."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h, factor = raw.copy(), np.uint32(1)
    with np.errstate(over="ignore"):
        for j in range(1, min(WINDOW, len(raw))):
            factor = factor * _BASE
            h[j:] += raw[:-j] * factor
        h *= _MIX
    return h ^ (h >> np.uint32(15))


def signature(data: bytes, ends: np.ndarray) -> str:
    """A character per chunk between boundaries; what follows the last allowed one is one chunk."""
    out, start = [], 0
    for end in [*ends[: MOST - 1].tolist(), len(data)]:
        if end > start:
            c = zlib.crc32(data[start:end])
            out.append(ALPHABET[(c ^ c >> 13) & 63])
            start = end
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """``block:signature:signature of twice the block``.

    The block size is the smallest 3 * 2^i whose expected number of chunks is within a signature,
    halved while its signature stays under half full.  A boundary of size 2b is one of b as well,
    since its hash is a multiple, so both sizes come from one rolling pass.
    """
    h = rolling(data)
    block = MIN_BLOCK
    while block * MOST < len(data):
        block *= 2
    while True:
        at = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
        one = signature(data, at)
        if block == MIN_BLOCK or len(one) >= MOST // 2:
            break
        block //= 2
    two = signature(data, np.flatnonzero(h % np.uint32(2 * block) == 2 * block - 1) + 1)
    return f"{block}:{one}:{two}"


def edits(a: str, b: str) -> int:
    """Least insertions and deletions that turn ``a`` into ``b``, by a bit-parallel common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def _squeezed(s: str) -> str:
    """Runs of more than three equal characters say little; they are cut to three."""
    out: list[str] = []
    for c in s:
        if out[-3:] != [c, c, c]:
            out.append(c)
    return "".join(out)


def likeness(x: str, y: str) -> float:
    """From 0 to 1; 1 for equal fingerprints.  Signatures are compared where block sizes meet:
    both of them for equal sizes, the one that the sizes share if one is twice the other."""
    if x == y:
        return 1.0
    bx, x1, x2 = x.split(":")
    by, y1, y2 = y.split(":")
    pairs = {1.0: [(x1, y1), (x2, y2)], 2.0: [(x1, y2)], 0.5: [(x2, y1)]}.get(int(bx) / int(by), [])
    best = 0.0
    for a, b in pairs:
        a, b = _squeezed(a), _squeezed(b)
        if a and b:
            best = max(best, 1.0 - edits(a, b) / (len(a) + len(b)))
    return min(best, 1.0)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text; a null text counts as the empty one,
    a null id stays null, repeated rows are taken each, other columns are left behind."""
    rows = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t.encode()) for t in texts], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the next text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, compared.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The next document is that of ascending id, after the last the first; null ids
    come first, equal ids order by a hash of their texts.  A lone document is its own next.  A
    null or empty text is the empty text; repeated rows are taken each; an empty table gives an
    empty result; other columns are left behind.

    Texts are dealt by range of id, sorted and walked once, in pairs of neighbours.  Only the
    first and last text of each range meet in a second, small join over the ranges' borders.
    """
    import hashlib

    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # rows alike in id and text may stand in any order, so their own numbers split them over ranges
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "id", "tie", "row").sortWithinPartitions("id", "tie", "text", "row").drop("row")
    kind = rows.schema["id"].dataType
    result = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    edge = [("range", T.IntegerType()), ("role", T.StringType()), ("text", T.StringType())]
    full = T.StructType([T.StructField("id", kind)] + [T.StructField(*x) for x in result + edge])

    def judged(text: str, mark: str, following: str, next_mark: str) -> tuple:
        new = edited(text, following)
        raw = new.encode()
        new_mark = mark if new == text else next_mark if new == following else fingerprint(raw)
        return len(text), hashlib.sha256(raw).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        last: tuple[pa.Scalar, str, str] | None = None
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            ids, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                mark = fingerprint(text.encode())
                own = b.column("id")[i].as_py()
                if last is None:
                    ids.append(own)
                    out.append((None,) * 6 + (at, "first", text))
                else:
                    ids.append(last[0])
                    out.append(judged(last[1], last[2], text, mark) + (None, None, None))
                last = own, text, mark
            yield batch(ids, out)
        if last is not None:
            yield batch([last[0]], [(None,) * 6 + (at, "last", last[1])])

    def batch(ids: list, out: list[tuple]) -> pa.RecordBatch:
        kinds = [*arrow, pa.int32(), pa.string(), pa.string()]
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], full.names)

    walked = stage(dealt.mapInArrow(walk, full), "neighbours")
    borders = walked.where("range is not null")
    used = sorted(r[0] for r in borders.where("role = 'first'").select("range").collect())  # a number per range
    names = [n for n, _ in result]
    inner = walked.where("range is null").select(F.col("id").alias(id_col), *names)
    if not used:
        return inner
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "range int, next int")
    firsts = borders.where("role = 'first'").select(F.col("range").alias("next"), F.col("text").alias("following"))
    lasts = borders.where("role = 'last'").select("range", "id", "text").join(after, "range").join(firsts, "next").select("id", "text", "following")
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(*x) for x in result])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [judged(t, fingerprint(t.encode()), f, fingerprint(f.encode())) for t, f in zip(b.column("text").to_pylist(), b.column("following").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate(arrow))], schema.names)

    return inner.unionByName(lasts.mapInArrow(finish, schema))
