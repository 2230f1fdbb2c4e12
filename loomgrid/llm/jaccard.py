"""Similarity join on word shingles by parity sketches (operator 9)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, scratch, shuffle_partitions, small_batches, stage, sub_batches, tidied
from loomgrid.llm.components import components, relabel
from loomgrid.llm.words import U, WordHasher, mix, shingles

#: Words of a shingle; two sets link when PERCENT * union <= 100 * intersection.
WORDS, PERCENT = 5, 80
SLICE_BYTES = 256 << 10
#: Keys that a task packs together, and bytes of packed keys that meet in one task.
PACK_KEYS, MEET_BYTES = 256 << 10, 8 << 20
#: A key that so many sets of one pack have is folded there.
FOLD = 16
#: Sets of a group that are compared with each other, or with as many others, in one step; words of
#: the short sketches that are compared first.
CHUNK, SHORT_WORDS = 256, 16
#: About so many keys are sorted at once where they meet.
MEET_ROWS = 64 << 10
#: Partners of one set that are streamed past it in one task.
PART_ROWS = 32
#: Ids of sets that may be broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Rounds of sketches, each with more blocks; sets that still lack blocks then meet by their tokens.
_SEEDS, _TAG_BITS = 16, 11
ROUNDS = _SEEDS - 1


@cache
def bands(percent: int = PERCENT) -> tuple[int, ...]:
    """Lower bounds of the size bands; sizes that can link are in one band or in neighbouring ones."""
    out, r, x = [], 100 / percent, 1.0
    while len(out) < 126:
        out.append(int(np.ceil(x)))
        x *= r
    return tuple(out)


def most_apart(level: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of a level: the smaller set in band ``level``,
    the larger in it or the next.  With d the difference, u the union: d <= (1 - t) u and
    2u = a + b + d, hence d <= (a + b)(1 - t) / (1 + t)."""
    a = bands(percent)[level + 1] - 1
    b = a * 100 // percent
    return (a + b) * (100 - percent) // (100 + percent)


def own_apart(n: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference of sets of given sizes to any that they link to at a level:
    in the level's own band, one that is larger by the limit; from the next band, one of the level's."""
    edge = np.array(bands(percent), np.int64)
    other = np.where(n < edge[level + 1], n * 100 // percent, edge[level + 1] - 1)
    return (n + other) * (100 - percent) // (100 + percent)


def n_blocks(level: int, seed: int, percent: int = PERCENT) -> int:
    """Blocks of a level's sketch: one more than differences, and some to spare, more with each seed."""
    d = most_apart(level, percent)
    return d + 1 + (1 + d // 3) * 2**seed


class Sets:
    """The distinct shingle hashes of the rows of a slice, row by row, sorted."""

    def __init__(self, hasher: WordHasher, col: pa.Array) -> None:
        n = len(col)
        h, of, _ = hasher.column(col)
        g, row, _ = shingles(h, of, n, WORDS, short=True)
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        self.g, self.row = g[new], row[new]
        self.n = np.bincount(self.row, minlength=n).astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n
        with np.errstate(over="ignore"):
            total = np.zeros(n, U)
            full = np.flatnonzero(self.n > 0)
            if len(full):
                total[full] = np.add.reduceat(mix(self.g ^ U(0x5851F42D4C957F2D)), self.starts[full])
            self.cls = mix(total + self.n.astype(U) * U(0x9E3779B97F4A7C15))
        self.cls[self.n == 0] = 0

    def of(self, i: int) -> np.ndarray:
        return self.g[self.starts[i] : self.starts[i] + self.n[i]]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of some rows, and for each its place in ``rows``."""
        n = self.n[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.g[at], np.repeat(np.arange(len(rows)), n)

    def keys(self, rows: np.ndarray, level_of: np.ndarray, percent: int = PERCENT, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Keys of the non-empty blocks at each row's level, the row of each; then the rows of this
        round, the tag of each (its level and round), and how many more blocks it has than it needs.

        Every token toggles a bit of its block, in a sketch so wide that a block's bits are told by
        the XOR of its tokens' hashes.  Sets that differ in d tokens differ in d blocks at most.  A
        row with more non-empty blocks than tokens it may differ in (``own_apart``) shares one of
        them with each set it links to; a row with fewer goes on to the next round, and there meets
        others that had to.  What is left after all rounds meets by its tokens, one of which any two
        linked sets share.
        """
        for seed in range(rounds + 1):
            if not len(rows):
                return
            need = own_apart(self.n[rows], level_of, percent) + 1
            g, at = self.take(rows)
            tag = level_of * _SEEDS + (seed if seed < rounds else _SEEDS - 1)
            with np.errstate(over="ignore"):
                if seed < rounds:
                    k = np.array([n_blocks(int(x), seed, percent) for x in range(level_of.max() + 1)], np.int64)[level_of]
                    first = np.cumsum(k) - k
                    block = ((mix(g + U(0xA0761D6478BD642F) * U(2 * seed + 1)) >> U(32)) * k[at].astype(U)) >> U(32)
                    where = first[at] + block.astype(np.int64)
                    xor = np.zeros(int(k.sum()), U)
                    np.bitwise_xor.at(xor, where, mix(g ^ U(0xE7037ED1A0B428DB)))
                    filled = np.zeros(len(xor), bool)
                    filled[where] = True
                    full = np.add.reduceat(filled.astype(np.int64), first)
                    there = np.flatnonzero(filled)
                    owner = np.repeat(np.arange(len(rows)), full)
                    key = mix(xor[there] ^ mix((there - first[owner]).astype(U) * U(0x9FB21C651E98DF25) + tag[owner].astype(U)))
                else:
                    owner, full = at, self.n[rows]
                    key = mix(mix(g ^ U(0xE7037ED1A0B428DB)) + tag[owner].astype(U))
                key = (key >> U(_TAG_BITS) << U(_TAG_BITS)) | tag[owner].astype(U)
            yield key, rows[owner], rows, tag, full - need
            more = full < need
            rows, level_of = rows[more], level_of[more]

    def levels(self, rows: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The levels of each row: that of its band, as the smaller set, and the one before."""
        band = np.searchsorted(np.array(bands(percent)), self.n[rows], "right") - 1
        for level in (band, band - 1):
            fine = level >= 0
            fine[fine] = own_apart(self.n[rows[fine]], level[fine], percent) > 0  # else it links to its equals only
            yield rows[fine], level[fine]


def sketch(g: np.ndarray) -> bytes:
    """A parity sketch of 8 bits a token, rounded up to a power of two; halves fold by XOR."""
    bits = 64
    while bits < 8 * len(g):
        bits *= 2
    at = (mix(g ^ U(0x8EBC6AF09C88C6E3)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def short_sketch(g: np.ndarray) -> bytes:
    """A parity sketch of one length for all sets."""
    bits = 64 * SHORT_WORDS
    at = (mix(g ^ U(0x8EBC6AF09C88C6E3)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: the Hamming distance of two parity sketches."""
    if len(x) > len(y):
        x, y = y, x
    b = np.frombuffer(y, np.uint64)
    while len(b) * 8 > len(x):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(b ^ np.frombuffer(x, np.uint64)).sum())


def _leaders(keys: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, set) sorted by key; the size and leader of each one's group; group starts.

    The leader is the set whose groups are largest, all told: the one that most others resemble.
    """
    order = np.lexsort((cls, keys))
    keys, cls = keys[order], cls[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
    keys, cls = keys[new], cls[new]
    if not len(keys):
        return keys, cls, np.zeros(0, np.int64), cls, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    each = np.repeat(size, size)
    name, at = np.unique(cls, return_inverse=True)
    weight = np.bincount(at, weights=each - 1)[at]
    group = np.repeat(np.arange(len(start)), size)
    last = np.lexsort((cls, weight, group))[np.append(start[1:], len(keys)) - 1]
    return keys, cls, each, np.repeat(cls[last], size), start


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    return a[at], b[at], np.diff(np.append(at, len(a)))


_OUT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("w", T.LongType())])


def _rows(kind: int, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> pa.RecordBatch:
    w = np.ones(len(x), np.int64) if w is None else w
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(w.astype(np.int64))], _OUT.names)


def candidates(texts: DataFrame, buckets: int, percent: int = PERCENT) -> DataFrame:
    """Sets that share a key, out of ``text``: rows of kind 0 (leader x, set y, w keys) and, for
    groups of three and more, of kind 1 (key x, set y).

    Keys travel packed, by range of key; ``buckets`` follows their bytes, so that a task holds
    about ``MEET_BYTES`` of them.  A key that many sets of one pack have is folded before the
    shuffle: the pack's leader alone goes on, and the others are dealt evenly as they are.
    """
    blob = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in ("keys", "at", "names")])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, turn = WordHasher(letters=False), 0
        keys: list[np.ndarray] = []
        names: list[np.ndarray] = []

        def pack() -> pa.RecordBatch:
            nonlocal turn
            k, c, each, lead, _ = _leaders(np.concatenate(keys), np.concatenate(names))
            keys.clear()
            names.clear()
            folded = (each >= FOLD) & (c != lead)
            out: list[tuple[int, int, bytes, bytes, bytes]] = []
            if folded.any():
                turn += 1
                out.append((turn % buckets, 1, k[folded].tobytes(), c[folded].tobytes(), lead[folded].tobytes()))
            single = each < FOLD
            for kind, own in ((0, single), (2, ~single & ~folded)):  # 2: stands for folded ones
                mine, sets_of = k[own], c[own]
                bucket = ((mine >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                start = np.flatnonzero(np.concatenate([[len(bucket) > 0], bucket[1:] != bucket[:-1]]))
                for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(bucket)]):
                    of, at = np.unique(sets_of[lo:hi], return_inverse=True)
                    out.append((int(bucket[lo]), kind, mine[lo:hi].tobytes(), at.astype(np.uint16 if len(of) < 65536 else np.uint32).tobytes(), of.tobytes()))
            cols = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[2:])], blob.names)

        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            sets = Sets(hasher, b.column("text"))
            _, rows = np.unique(sets.cls, return_index=True)
            rows = rows[sets.n[rows] > 0]
            for own, level in sets.levels(rows, percent):
                for key, of, *_ in sets.keys(own, level, percent):
                    keys.append(key)
                    names.append(sets.cls[of])
            if sum(map(len, keys)) >= PACK_KEYS:
                yield pack()
        if keys:
            yield pack()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            for kind, k, at, names in zip(*(b.column(n).to_pylist() for n in ("kind", "keys", "at", "names"))):
                k, names = np.frombuffer(k, U), np.frombuffer(names, U)
                if kind == 1:
                    c = np.frombuffer(at, U)
                    yield _rows(0, *_pairs(names, c))
                    yield _rows(1, k, c)
                    yield _rows(1, *_pairs(k, names)[:2])
                else:
                    held.append((kind, k, np.frombuffer(at, np.uint16 if len(at) == 2 * len(k) else np.uint32), names))
        # a range of keys at a time, so that what sorting takes doesn't follow the partition's size
        some = np.sort(np.concatenate([np.zeros(0, U), *(k[::64] for _, k, _, _ in held)]))
        borders = some[MEET_ROWS // 64 :: MEET_ROWS // 64]
        cuts = [np.concatenate([[0], np.searchsorted(k, borders), [len(k)]]) for _, k, _, _ in held]
        for i in range(len(borders) + 1):
            part = [(kind, k[c[i] : c[i + 1]], names[at[c[i] : c[i + 1]]]) for (kind, k, at, names), c in zip(held, cuts) if c[i] < c[i + 1]]
            if not part:
                continue
            k, c, each, lead, _ = _leaders(np.concatenate([x[1] for x in part]), np.concatenate([x[2] for x in part]))
            follows = (each > 1) & (c != lead)
            if follows.any():
                yield _rows(0, *_pairs(lead[follows], c[follows]))
            marked = np.concatenate([np.zeros(0, U), *(x[1] for x in part if x[0] == 2)])
            more = (each > 2) | (each > 1) & np.isin(k, marked)  # a pair needs no more than its own row
            if more.any():
                yield _rows(1, k[more], c[more])

    packed = texts.mapInArrow(tidied(spread), blob).repartition(buckets, "bucket")
    return packed.mapInArrow(tidied(meet), _OUT)


def _texts_of(rows: DataFrame, involved: DataFrame) -> DataFrame:
    """Sets of the involved classes, from the texts of their representatives: the leader ``a`` that
    each meets first and the parts that it and they are dealt into, as ``involved`` has them, then
    ``n, g, sketch, short, tags, spare`` (hashes sorted; for each tag how many blocks it has to spare)."""
    small = involved.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = rows.join(F.broadcast(involved) if small else involved, rows["id"] == involved["rep"]).select("cls", "a", "parts", "heads", "text")
    long = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("a", T.LongType()), T.StructField("parts", T.IntegerType()), T.StructField("heads", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("g", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("short", T.BinaryType()), T.StructField("tags", long), T.StructField("spare", long)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letters=False)
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            sets = Sets(hasher, b.column("text"))
            own = np.flatnonzero((sets.cls == b.column("cls").to_numpy().view(U)) & (sets.n > 0))
            tags: list[list[int]] = [[] for _ in range(len(sets.n))]
            spare: list[list[int]] = [[] for _ in range(len(sets.n))]
            for mine, level in sets.levels(own):
                for _, _, todo, tag, more in sets.keys(mine, level):
                    for r, t, m in zip(todo.tolist(), tag.tolist(), more.tolist()):
                        tags[r].append(t)
                        spare[r].append(m)
            g = [sets.of(i) for i in own]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(own)) for c in ("cls", "a", "parts", "heads")), pa.array(sets.n[own]), pa.array([x.tobytes() for x in g], pa.binary()), pa.array([sketch(x) for x in g], pa.binary()), pa.array([short_sketch(x) for x in g], pa.binary()), pa.array([tags[i] for i in own], pa.list_(pa.int64())), pa.array([spare[i] for i in own], pa.list_(pa.int64()))],
                schema.names,
            )

    return chosen.mapInArrow(tidied(run), schema)


def parts_of(pairs: DataFrame) -> DataFrame:
    """Into how many parts the partners of each ``a`` are dealt."""
    return pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))


def verify_first(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs of each set with its own leader that link; sets carry all that is needed."""
    heads = sets.where("heads is not null").select(F.col("cls").alias("a"), F.explode(F.sequence(F.lit(0), F.col("heads") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "g")
    tails = sets.where("a is not null").select("a", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("salt"), F.col("cls").alias("b"), "g")
    return _streamed(heads.unionByName(tails), percent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose sets link."""
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    own = sets.select("cls", "g")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # else all sets are dealt, which only costs more
        own = own.join(F.broadcast(ids), "cls", "left_semi")
    parts = parts_of(pairs)
    heads = parts.join(own, parts["a"] == own["cls"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "g")
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    tails = dealt.join(own, dealt["b"] == own["cls"]).select("a", "salt", "b", "g")
    return _streamed(heads.unionByName(tails), percent)


def _streamed(rows: DataFrame, percent: int) -> DataFrame:
    """Exact intersections of ``a`` (rows without ``b``) with the rows laid behind it, so that a
    task holds one set; an ``a`` with many partners is there once for every part of them."""
    laid = rows.repartition(shuffle_partitions(rows.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, U)
        for batch in batches:
            out = []
            for a, b, g in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "g"))):
                x = np.frombuffer(g, U)
                if b is None:
                    at, head = a, x
                    continue
                assert a == at
                if min(len(x), len(head)) * 100 < percent * max(len(x), len(head)):
                    continue
                place = np.searchsorted(head, x)
                place[place == len(head)] = 0
                both = int((head[place] == x).sum())
                if 100 * both >= percent * (len(x) + len(head) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return laid.select("a", "b", "g").mapInArrow(tidied(run), "a long, b long")


def near_sketches(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sizes and parity sketches allow a link."""
    few = sets.select("cls", "n", "sketch")
    for side in ("a", "b"):
        mine = few.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
        pairs = pairs.join(mine, side)
        if side == "b":
            pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("n_a", "n_b", "s_a", "s_b")]
            fine = [apart(x, y) * (100 + percent) <= (m + n) * (100 - percent) for m, n, x, y in zip(*cols)]
            yield b.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidied(run), "a long, b long")


def _open_rows(members: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows ``key, cls, comp, df`` of groups that still hold several components; ``df`` is their size.

    A set stays only in the groups of its rarest blocks, as many as it needs.  In one order of all
    blocks of a tag, by (df, key), two linked sets that differ in d blocks share one of the first
    d + 1 of each (they share all but d), so those are enough, and what many sets have is used only
    by sets that have little else.  Blocks of one or two sets are in no group and come first.
    """
    known = relabel(members.select("key", "cls", F.col("cls").alias("comp")), comps, "comp")
    stats = known.groupBy("key").agg(F.count("*").alias("df"), (F.min("comp") < F.max("comp")).alias("several"))
    known = stage(known.join(stats, "key"), "groups")
    several = known.where("several")
    tag = F.col("key").bitwiseAND(F.lit(2**_TAG_BITS - 1))
    mine = known.join(several.select("cls").distinct(), "cls", "left_semi").withColumn("tag", tag)
    spare = sets.select("cls", F.explode(F.arrays_zip("tags", "spare")).alias("t")).select("cls", F.col("t.tags").alias("tag"), F.col("t.spare").alias("spare")).dropDuplicates(["cls", "tag"])
    # a set may stand twice with a key that was folded; equal rows share a rank
    rank = F.dense_rank().over(Window.partitionBy("cls", "tag").orderBy(F.desc("df"), F.desc("key")))
    return mine.join(spare, ["cls", "tag"]).withColumn("rank", rank).where("rank > spare and several").select("key", "cls", "comp", "df")


def cross_pairs(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components within a key's group whose sizes and short sketches allow a link.

    Groups are dealt into chunks of about ``CHUNK`` sets and each two chunks meet on their own, as
    runs of a sorted partition; pairs are compared there and only those that may link come out.
    """
    cut = rows.withColumn("chunks", F.ceil(F.col("df") / CHUNK).cast("int")).join(sets.select("cls", "n", "short").dropDuplicates(["cls"]), "cls")
    chunk = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    ends = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, chunk).alias("lo"), F.greatest(j, chunk).alias("hi"), (chunk < j).alias("low")))
    met = cut.withColumn("e", F.explode(ends)).select("key", "e.lo", "e.hi", "e.low", "cls", "comp", "n", "short")
    laid = met.repartition(shuffle_partitions(rows.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        one = lambda c: t.column(c).to_numpy()
        cls, comp, n, low = one("cls"), one("comp"), one("n"), t.column("low").to_numpy(zero_copy_only=False)
        bits = np.frombuffer(b"".join(t.column("short").to_pylist()), U).reshape(len(cls), SHORT_WORDS)
        same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        x, y = np.triu_indices(len(cls), 1) if same else (v.ravel() for v in np.meshgrid(np.flatnonzero(low), np.flatnonzero(~low), indexing="ij"))
        fine = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        x, y = x[fine], y[fine]
        d = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        fine = d * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
        return np.minimum(cls[x[fine]], cls[y[fine]]), np.maximum(cls[x[fine]], cls[y[fine]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            ids = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")])
            starts = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)]))
            rest = t.slice(int(starts[-1]))  # its run may go on in the next batch
            found = [compare(t.slice(int(a), int(b - a))) for a, b in zip(starts[:-1], starts[1:]) if b - a > 1]
            yield _rows(0, *_pairs(*(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1)))[:2])
        if rest is not None and rest.num_rows > 1:
            yield _rows(0, *_pairs(*compare(rest))[:2])

    return laid.mapInArrow(tidied(run), _OUT).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _more(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after further edges between them."""
    with scratch() as kept:
        fresh = components(relabel(relabel(edges, comps, "a"), comps, "b"))
        known = relabel(comps, fresh, "comp")
        out = stage(known.unionByName(fresh.join(comps.select("node"), "node", "left_anti")), "components")
        kept.append(out)
    return out


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """Link documents whose sets of word shingles are alike: ``doc_id, n_shingles, component_id``.

    Words are runs of anything but ASCII blanks, A-Z as a-z; a set holds the distinct runs of five
    words, or the whole sequence if there are fewer.  Two documents link when the intersection is
    at least 80 % of the union.  ``component_id`` is the smallest id that links lead to.

    Equal sets form a class first.  Parity sketches of size bands, cut into blocks, are joined by
    pigeonhole (``Sets.keys``): linked sets share a block that isn't empty.  Within a block's group
    the sets are first verified against a leader; only sets whose components stay apart are then
    compared with each other, after size and sketch distance.  So no link between components is
    lost, though links inside one may go unverified.  Sets are compared by 64-bit hashes.

    A null or blank text has an empty set and is linked with nothing; a row with a null id links
    nothing and reports the component of its equals, else null; repeated rows form one class; an
    empty table gives an empty result.  Columns named in ``keep`` are carried along, except those
    whose names the result has itself; others are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in keep if c not in (id_col, "n_shingles", "component_id")]
    rows = pick(docs, id=id_col, text=text_col, **{f"keep_{i}": c for i, c in enumerate(keep)})
    kept = [f"keep_{i}" for i in range(len(keep))]
    schema = T.StructType([rows.schema["id"], *(rows.schema[c] for c in kept), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType())])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letters=False)
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            sets = Sets(hasher, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in kept), pa.array(sets.n), pa.array(sets.cls.view(np.int64))], schema.names)

    with scratch() as stay:
        listed = stage(rows.mapInArrow(tidied(measure), schema), "sets")
        named = stage(_classes(rows, listed), "named")
        stay += [listed, named]
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    answer = named.join(least, "comp").select("cls", "least")
    own = [F.col("id").alias(id_col), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("n").alias("n_shingles")]
    full = listed.where("n > 0").join(answer, "cls", "left").select(*own, F.col("least").alias("component_id"))
    return full.unionByName(listed.where("n = 0").select(*own, F.col("id").alias("component_id")))


def _classes(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``cls, rep, comp``: the classes of equal sets, the smallest id of each, and their components."""
    spark = rows.sparkSession
    classes = listed.where("n > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("rep"))
    tokens = listed.agg(F.sum("n")).first()[0] or 0  # a key of 8 bytes and its set's number for most of them
    buckets = max(shuffle_partitions(spark), -(-tokens * 9 // MEET_BYTES))
    found = stage(candidates(rows.where("id is not null").select("text"), buckets), "candidates")
    star = stage(found.where("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "star")
    best = stage(star.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a")), "best")
    parts = stage(parts_of(best), "parts")
    involved = star.select(F.col("a").alias("cls")).unionByName(star.select(F.col("b").alias("cls"))).distinct().join(classes, "cls")
    involved = involved.join(best.join(parts, "a").withColumnRenamed("b", "cls"), "cls", "left")
    involved = involved.join(parts.select(F.col("a").alias("cls"), F.col("parts").alias("heads")), "cls", "left")
    sets = stage(_texts_of(rows, stage(involved, "involved")), "hashes")

    comps = _more(spark.createDataFrame([], "node long, comp long"), stage(verify_first(sets), "links"))
    apart_still = lambda p: relabel(relabel(p.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), comps, "ca"), comps, "cb").where("ca <> cb").select("a", "b")
    rest = apart_still(star.join(best, ["a", "b"], "left_anti"))
    comps = _more(comps, stage(verify(near_sketches(rest, sets), sets), "links"))
    # a set may stand twice with a key that was folded; then it only counts as more frequent
    members = found.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("cls"))
    last = near_sketches(cross_pairs(_open_rows(members, comps, sets), sets), sets)
    comps = _more(comps, stage(verify(last, sets), "links"))
    return classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
