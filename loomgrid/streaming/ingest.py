"""Structured Streaming over arriving read files: mergeable counters, kept current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgrid.functions.sequence import is_autosome, is_y
from loomgrid.operators.fetal import in_par


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sex_counters(reads: DataFrame, kept: Column, build: str = "hg38") -> DataFrame:
    """Reads on Y and on autosomes per sample.  The state is three numbers per sample, so no
    watermark is needed; write it in update or complete mode."""
    y, par = is_y(F.col("chrom")), in_par(F.col("pos"), build)
    return reads.groupBy("sample_id").agg(F.count_if(kept & y & ~par).alias("y"), F.count_if(kept & is_autosome(F.col("chrom"))).alias("auto"), F.count("*").alias("total"))


def motif_counters(motifs: DataFrame) -> DataFrame:
    """Counts of pure motifs per sample; at most 4^k numbers each."""
    return motifs.where(F.col("motif").rlike("^[ACGT]+$")).groupBy("sample_id", "motif").agg(F.count("*").alias("count"))


def windowed_depth(reads: DataFrame, time: str, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Reads per sample and time window, closed once the watermark has passed."""
    return reads.withWatermark(time, lateness).groupBy(F.window(time, width), "sample_id").agg(F.count("*").alias("n"))
