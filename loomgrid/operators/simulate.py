"""Reads drawn from a truth table, the same for every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*parts):
    """A number in [0, 1) that follows from its parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def draw_pileup(spark: SparkSession, truth: DataFrame, n_samples: int, depth: int, error: float = 0.001) -> DataFrame:
    """``chrom, pos, sample_id, ref_base, read_base, bq, mapq, strand, rpr, is_dup, gt``.

    ``truth``: ``chrom, pos, ref, alt, af``.  A sample's genotype is two draws at the frequency
    (Hardy-Weinberg); each read shows one of its alleles, or, at the error rate, another letter.
    """
    each = truth.crossJoin(F.broadcast(spark.range(n_samples).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample_id"))))
    drawn = lambda i: (_unit("chrom", "pos", "sample_id", F.lit(i)) < F.col("af")).cast("int")
    each = each.withColumn("gt", F.array_sort(F.array(drawn(1), drawn(2))))
    reads = each.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    pick = F.get("gt", (_unit("chrom", "pos", "sample_id", "k", F.lit(3)) * 2).cast("int"))
    letter = F.when(pick == 1, F.col("alt")).otherwise(F.col("ref"))
    other = F.substring(F.lit("ACGT"), (_unit("chrom", "pos", "sample_id", "k", F.lit(5)) * 4).cast("int") + 1, F.lit(1))
    wrong = _unit("chrom", "pos", "sample_id", "k", F.lit(4)) < error
    return reads.select(
        "chrom", "pos", "sample_id", F.col("ref").alias("ref_base"), F.when(wrong, other).otherwise(letter).alias("read_base"),
        (20 + F.floor(_unit("chrom", "pos", "sample_id", "k", F.lit(6)) * 20)).cast("int").alias("bq"), F.lit(60).alias("mapq"),
        F.when(_unit("chrom", "pos", "sample_id", "k", F.lit(7)) < 0.5, "+").otherwise("-").alias("strand"), F.col("k").alias("rpr"), F.lit(False).alias("is_dup"), "gt",
    )


def ancient(reads: DataFrame, rate: float = 0.3, decay: float = 0.3) -> DataFrame:
    """C read as T at a rate that falls with the distance from the fragment's start (``rpr``)."""
    hit = _unit("chrom", "pos", "sample_id", "rpr", F.lit(9)) < F.lit(rate) * F.pow(F.lit(1.0 - decay), F.col("rpr") - 1)
    return reads.withColumn("read_base", F.when((F.col("read_base") == "C") & hit, "T").otherwise(F.col("read_base")))
