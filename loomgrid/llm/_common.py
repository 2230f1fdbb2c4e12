"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGES: dict[str, SparkSession] = {}
_here = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session of this machine alone (local tests) gets a temporary folder where the setting is
    absent; a cluster's executors couldn't see one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor without recomputing
    what came before.  The files go at the end of a ``scratch`` block, with ``release_stages``, or
    when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid-{name}-{uuid.uuid4().hex}"
    _STAGES[path] = spark
    if blocks := getattr(_here, "blocks", None):
        blocks[-1].append(path)
    writer = df.write.mode("overwrite")
    if partition_by := list(partition_by):
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete what is staged inside the block when it ends, but for the staged frames that the block
    puts into the list it is given."""
    blocks = _here.blocks = getattr(_here, "blocks", [])
    blocks.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        paths, stay = blocks.pop(), {x._staged_at for x in kept}
        for path in paths:
            if path not in stay:
                _delete(path)
        if blocks:
            blocks[-1] += stay


def _delete(path: str) -> None:
    spark = _STAGES.pop(path, None)
    if spark is None:
        return
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner cleans up
        pass


def release_stages() -> None:
    """Delete all staged tables of this process; frames that still read them become unusable."""
    for path in list(_STAGES):
        _delete(path)


atexit.register(release_stages)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes (a session setting; a smaller one stays).

    Spark bounds them by rows and by 64 MB; rows here are whole texts or packed keys, and a batch is
    held several times over, in the JVM and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives the memory it has freed back to the system when its task ends; workers
    are used again, and idle ones would keep it."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the columns that an operator works on, under the operator's own names.

    Everything else is left behind, so extra columns, whatever their names, can't clash.
    """
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def numbered(df: DataFrame) -> DataFrame:
    """The columns named ``c0, c1, ...`` by their place, so that no name of theirs can clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named_again(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, under their own names, from a frame that has them ``numbered``."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that ``column`` holds at most ``max_bytes`` in each (or one row)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def crc_bucket(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n
