"""Small text formats: lists, groups, BED, sequence indexes and FASTA."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """First column of each line; blank lines are left out, a last line without its end isn't."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("path")).where("path <> ''")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    p = r"^\s*(\S+)\s+(\S+)"
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(F.regexp_extract("value", p, 1).alias("sample_id"), F.regexp_extract("value", p, 2).alias("group")).where("sample_id <> ''")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """0-based half-open lines to 1-based inclusive ranges; headers and lines that hold none are skipped."""
    line = F.rtrim(F.regexp_replace("value", "\r$", ""))
    part = F.split(line, "\t", -1)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track\b|browser\b)")).select(part.alias("p")).where(F.size("p") >= 3)
    rows = rows.select(F.get("p", F.lit(0)).alias("chrom"), F.get("p", F.lit(1)).try_cast("long").alias("s"), F.get("p", F.lit(2)).try_cast("long").alias("e"))
    return rows.where("s >= 0 and e > s").select("chrom", (F.col("s") + 1).alias("start"), F.col("e").alias("end"))


def read_fai(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """``chrom, length`` of a sequence index; a malformed line is an error."""
    return parse_fai(spark.read.text(path), only)


def parse_fai(lines: DataFrame, only: list[str] | None = None) -> DataFrame:
    part = F.split("value", "\t", -1)
    n = F.get(part, F.lit(1)).try_cast("long")
    rows = lines.where("value <> ''").select(F.get(part, F.lit(0)).alias("chrom"), F.when(n > 0, n).otherwise(F.raise_error(F.concat(F.lit("malformed index line: "), F.col("value"))).cast("long")).alias("length"))
    return rows.where(F.col("chrom").isin(only)) if only else rows


def read_fasta(spark: SparkSession, path: str, chunk: int = 10_000, overlap: int = 1_000) -> DataFrame:
    """``chrom, chunk, seq``: sequences in chunks, each with the letters that follow, up to
    ``overlap``, so that short reads of the reference need one chunk.  A file is a task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
                for record in text.split(">")[1:]:
                    head, _, body = record.partition("\n")
                    seq = "".join(body.split())
                    starts = range(0, max(1, len(seq)), chunk)
                    yield pa.RecordBatch.from_arrays([pa.array([head.split()[0]] * len(starts)), pa.array([s // chunk for s in starts], pa.int64()), pa.array([seq[s : s + chunk + overlap] for s in starts])], ["chrom", "chunk", "seq"])

    return files.mapInArrow(run, "chrom string, chunk long, seq string")


def catalog(chunks: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Names and lengths of sequences."""
    return chunks.groupBy("chrom").agg(F.sum(F.least(F.length("seq"), F.lit(chunk))).alias("length"))


def sample_name(path, whole_stem: bool = True):
    """Sample name from a file's name: all but the extension, or what stands before the first dot."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"\.[^.]*$", "") if whole_stem else F.element_at(F.split(base, r"\."), 1)


def lengths(chunks: DataFrame, fai: str | None = None, chunk: int = 10_000) -> dict[str, int]:
    """Sequences and their lengths: in the order of an index, or by name from the chunks."""
    if fai:
        return {x.chrom: x.length for x in read_fai(chunks.sparkSession, fai).collect()}
    end = F.col("chunk") * chunk + F.least(F.length("seq"), F.lit(chunk))
    return {x.chrom: x.n for x in chunks.groupBy("chrom").agg(F.max(end).alias("n")).orderBy("chrom").collect()}
