"""Interval algebra on 1-based inclusive ranges ``chrom, start, end``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that intervals and points meet in.
BIN = 1 << 20
#: Width of the bins that windows run over.
CARRY = 1 << 14


def _carried(df: DataFrame, value: Column, width: int) -> DataFrame:
    """``chrom, bin, before``: the largest ``value`` of all earlier bins of the chromosome.  One row a
    bin, so its size follows the genome and not the data."""
    per = df.groupBy("chrom", F.floor(F.col("start") / width).alias("bin")).agg(F.max(value).alias("most"))
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("chrom", "bin", F.max("most").over(earlier).alias("before"))


def merge(intervals: DataFrame, width: int = CARRY) -> DataFrame:
    """Union per chromosome; ranges that touch without a shared position stay apart.

    Ranges of one start are joined first.  Then windows run over bins of starts, and what earlier bins
    reach (their largest end, their last beginning of a union) is carried in from a table of bins.
    """
    longest = intervals.groupBy("chrom", "start").agg(F.max("end").alias("end"))
    binned = longest.withColumn("bin", F.floor(F.col("start") / width))
    w = Window.partitionBy("chrom", "bin").orderBy("start")
    seen = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    flagged = binned.join(_carried(longest, F.col("end"), width), ["chrom", "bin"]).withColumn("begins", F.when(F.coalesce(F.col("start") > seen, F.lit(True)), F.col("start"))).drop("before")
    begun = F.coalesce(F.max("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("before"))
    of = flagged.join(_carried(flagged, F.col("begins"), width), ["chrom", "bin"]).withColumn("island", begun)
    return of.groupBy("chrom", "island").agg(F.max("end").alias("end")).select("chrom", F.col("island").alias("start"), "end")


def total_length(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("chrom").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


def binned(intervals: DataFrame, width: int = BIN) -> DataFrame:
    return intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def points_in(points: DataFrame, intervals: DataFrame, how: str, pos: str = "pos", width: int = BIN) -> DataFrame:
    """Points inside (``left_semi``) or outside (``left_anti``) the intervals, joined within bins."""
    held = binned(intervals.select(F.col("chrom").alias("c"), F.col("start").alias("s"), F.col("end").alias("e")).withColumnsRenamed({"s": "start", "e": "end"}), width)
    p = points.withColumn("bin", F.floor(F.col(pos) / width))
    on = (p["chrom"] == held["c"]) & (p["bin"] == held["bin"]) & p[pos].between(held["start"], held["end"])
    return p.join(held, on, how).drop("bin")


def overlap_lengths(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Shared positions of two sets of disjoint intervals, by chromosome; a pair that meets in
    several bins counts in the first of them."""
    x, y = binned(a, width), binned(b.withColumnsRenamed({"start": "s2", "end": "e2"}).withColumns({"start": F.col("s2"), "end": F.col("e2")}), width).drop("start", "end")
    lo, hi = F.greatest("start", "s2"), F.least("end", "e2")
    met = x.join(y, ["chrom", "bin"]).where((lo <= hi) & (F.col("bin") == F.floor(lo / width)))
    return met.groupBy("chrom").agg(F.sum(hi - lo + 1).alias("bases"))


def last_start(points: DataFrame, intervals: DataFrame, pos: str = "pos", width: int = CARRY) -> DataFrame:
    """As-of: the last interval that starts at or before each point, with ``inside``; of one start the
    last end, and nulls before the first.

    Distinct positions and starts are laid in one order within bins, and the last start of earlier bins
    is carried in from a table of bins, so no group exceeds two bins' positions and no range is joined.
    """
    own = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    starts = intervals.groupBy("chrom", "start").agg(F.max("end").alias("end")).withColumn("own", own)
    places = points.select("chrom", F.col(pos).alias("start")).where("chrom is not null and start is not null").distinct()
    laid = starts.select("chrom", F.col("start").alias("at"), F.lit(0).alias("kind"), "own").unionByName(places.select("chrom", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["own"].dataType).alias("own")))
    w = Window.partitionBy("chrom", "bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    within = laid.withColumn("bin", F.floor(F.col("at") / width)).withColumn("last", F.last("own", True).over(w)).where("kind = 1")
    every = starts.select("chrom", "start", "own").unionByName(places.withColumn("own", F.lit(None).cast(starts.schema["own"].dataType)))
    got = within.join(_carried(every, F.col("own"), width), ["chrom", "bin"]).select("chrom", F.col("at").alias(pos), F.coalesce("last", "before").alias("last"))
    met = points.join(got, ["chrom", pos], "left")
    return met.select(*points.columns, F.col("last.start").alias("start"), F.col("last.end").alias("end"), F.coalesce(F.col(pos) <= F.col("last.end"), F.lit(False)).alias("inside"))


def tiles(regions: DataFrame, delta: int = 2_000_000) -> DataFrame:
    """Windows of ``delta`` positions over each region, the last one clipped."""
    cut = regions.select("chrom", F.explode(F.expr(f"sequence(start, end, {int(delta)}L)")).alias("start"), F.col("end").alias("stop"))
    return cut.select("chrom", "start", F.least(F.col("start") + delta - 1, "stop").alias("end"))


def commands(tiled: DataFrame, program: str, arguments: str, outdir: str) -> DataFrame:
    """One command line per tile, as a planner for machines without a cluster prints them."""
    name = F.format_string("%s.%d-%d", "chrom", "start", "end")
    text = F.concat(F.lit(f"{program} {arguments} -r "), F.format_string("%s:%d-%d", "chrom", "start", "end"), F.lit(f" -o {outdir}/"), name, F.lit(".vcf.gz"))
    return tiled.select("chrom", "start", "end", text.alias("command"))


def batches(samples: DataFrame, size: int = 500) -> DataFrame:
    """Samples in order, dealt into batches of ``size``; the list is a dimension table."""
    return samples.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("sample_id")) - 1) / size))


def window_of(pos: Column, width: int = 500_000) -> Column:
    return F.floor(pos / width)
