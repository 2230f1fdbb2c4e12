"""Fetal fraction from the share of reads on chromosome Y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.sequence import is_autosome, is_y
from loomgrid.operators import intervals

#: Pseudo-autosomal regions of Y (1-based, inclusive), and lengths without gaps that
#: give the geometric scale 2 * autosomes / unique Y.
PAR = {"hg38": ((10001, 2781479), (56887903, 57217415)), "hg19": ((10001, 2649520), (59034050, 59363566))}
LENGTHS = {"hg38": (2875001522, 54126423), "hg19": (2881033286, 56404529)}
FALLBACK_SCALE, MALE_THRESHOLD = 100.0, 1e-4


def in_par(pos: Column, build: str = "hg38") -> Column:
    out = F.lit(False)
    for lo, hi in PAR[build]:
        out = out | pos.between(lo, hi)
    return out


def counters(reads: DataFrame, kept: Column, build: str = "hg38", mappable: DataFrame | None = None) -> DataFrame:
    """Per sample: total, filtered, Y reads outside the pseudo-autosomal regions, those inside, and
    autosomal reads.  With ``mappable`` intervals, kept reads elsewhere count as filtered."""
    if mappable is not None:
        reads = reads.withColumn("kept_", kept)
        inside = intervals.points_in(reads.where("kept_"), intervals.merge(mappable), "left_semi").withColumn("map_", F.lit(True))
        outside = intervals.points_in(reads.where("kept_"), intervals.merge(mappable), "left_anti").withColumn("map_", F.lit(False))
        reads = inside.unionByName(outside).unionByName(reads.where("not kept_").withColumn("map_", F.lit(False)))
        kept = F.col("kept_") & F.col("map_")
    y, par, auto = is_y(F.col("chrom")), in_par(F.col("pos"), build), is_autosome(F.col("chrom"))
    return reads.groupBy("sample_id").agg(
        F.count("*").alias("total"), F.count_if(kept & y & ~par).alias("y"), F.count_if(kept & y & par).alias("par"), F.count_if(kept & auto).alias("auto"),
        F.count_if(~kept | (kept & ~y & ~auto)).alias("filtered"),
    )


def scale_of(build: str, mappable: DataFrame | None = None) -> float:
    """2 * autosomal length / unique Y length, from the intervals if given; they are summed first."""
    if mappable is None:
        if build not in LENGTHS:
            return FALLBACK_SCALE
        auto, y = LENGTHS[build]
        return 2.0 * auto / y
    merged = intervals.merge(mappable)
    par = mappable.sparkSession.createDataFrame([("Y", a, b) for a, b in PAR[build]], "chrom string, start long, end long")
    ys = merged.where(is_y(F.col("chrom"))).withColumn("chrom", F.lit("Y"))
    auto = merged.where(is_autosome(F.col("chrom"))).agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0] or 0
    y = (ys.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0] or 0) - (intervals.overlap_lengths(ys, par).agg(F.sum("bases")).first()[0] or 0)
    return 2.0 * auto / y if y > 0 else FALLBACK_SCALE


def fraction(counts: DataFrame, scale: float, noise: float = 0.0, threshold: float = MALE_THRESHOLD) -> DataFrame:
    """``y_ratio, sex, fetal_fraction``: no autosomal reads: UNDETERMINED; a ratio above the threshold:
    MALE and max(0, ratio - noise) * scale; else FEMALE; -1 where there is no fraction."""
    ratio = F.when(F.col("auto") > 0, F.col("y") / F.col("auto")).otherwise(0.0)
    out = counts.withColumn("y_ratio", ratio)
    sex = F.when(F.col("auto") == 0, "UNDETERMINED").when(F.col("y_ratio") > threshold, "MALE").otherwise("FEMALE")
    return out.withColumn("sex", sex).withColumn("fetal_fraction", F.when(F.col("sex") == "MALE", F.greatest(F.lit(0.0), F.col("y_ratio") - noise) * scale).otherwise(-1.0))


def calibrate(fractions: DataFrame, noise: float = 0.0) -> DataFrame:
    """Mean and population deviation of raw and corrected ratios, CV in percent, and scale 1 / mean."""
    c = F.greatest(F.lit(0.0), F.col("y_ratio") - noise)
    out = fractions.agg(F.count("*").alias("n"), F.avg("y_ratio").alias("mean_raw"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"))
    return out.withColumns({"cv_percent": F.when(F.col("mean") > 0, F.col("sd") / F.col("mean") * 100.0).otherwise(0.0), "scale": F.when(F.col("mean") > 0, 1.0 / F.col("mean")).otherwise(0.0)})
