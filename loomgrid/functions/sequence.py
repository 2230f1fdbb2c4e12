"""Bases, fragment ends and region strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """ACGT of either case to the upper complement, all else to N, from the end."""
    return F.reverse(F.regexp_replace(F.translate(F.upper(seq), "ACGT", "TGCA"), "[^ACGT]", "N"))


def end_motif(seq: Column, reverse: Column, k: int, unmapped: Column | None = None) -> Column:
    """The first ``k`` bases of the fragment: of the read, or of its reverse complement; empty if short."""
    motif = F.when(reverse, reverse_complement(F.right(seq, F.lit(k)))).otherwise(F.upper(F.substring(seq, 1, k)))
    short = (F.length(seq) < k) | seq.isNull()
    return F.when(short if unmapped is None else short | unmapped, F.lit("")).otherwise(motif)


def pure_acgt(seq: Column) -> Column:
    return F.coalesce(seq.rlike("^[ACGT]+$"), F.lit(False))


def strip_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^(?i)chr", "")


def is_autosome(chrom: Column) -> Column:
    bare = strip_chr(chrom)
    return bare.rlike("^[0-9]{1,6}$") & F.coalesce(bare.try_cast("int").between(1, 22), F.lit(False))


def is_y(chrom: Column) -> Column:
    return F.upper(strip_chr(chrom)) == "Y"


def all_motifs(spark, k: int):
    """All 4^k motifs in lexicographic order, as a DataFrame ``motif``."""
    digits = F.concat(*[F.substring(F.lit("ACGT"), (F.floor(F.col("id") / 4**i) % 4 + 1).cast("int"), F.lit(1)) for i in reversed(range(k))])
    return spark.range(4**k).select(digits.alias("motif"))


def parse_region(text: str, lengths: dict[str, int] | None = None) -> tuple[str, int, int] | None:
    """``chr``, ``chr:start`` or ``chr:start-end``, 1-based inclusive; blank text gives None.

    With ``lengths`` the sequence must be known and hold the region; else an open end is -1.
    """
    text = text.strip()
    if not text:
        return None
    chrom, colon, rest = text.partition(":")
    start, end = 1, -1
    if lengths is not None:
        if chrom not in lengths:
            raise ValueError(f"unknown sequence {chrom!r}")
        end = lengths[chrom]
    if colon:
        m = re.fullmatch(r"(-?[0-9]+)(?:-([0-9]+))?", rest)
        if not m:
            raise ValueError(f"not a region: {text!r}")
        start, end = int(m[1]), int(m[2]) if m[2] else end
        if start < 1 or (end >= 0 and start > end) or (lengths is not None and end > lengths[chrom]):
            raise ValueError(f"region out of bounds: {text!r}")
    return chrom, start, end


def region_columns(text: Column) -> list[Column]:
    """Chromosome, start and end (null if open) of region strings; all null if it isn't one."""
    p = r"^\s*([^:\s]+)(?::([0-9]+)(?:-([0-9]+))?)?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    start, end = F.coalesce(part(2).try_cast("long"), F.lit(1)), part(3).try_cast("long")
    fine = text.rlike(p) & (start >= 1) & (end.isNull() | (start <= end))
    return [F.when(fine, part(1)).alias("chrom"), F.when(fine, start).alias("start"), F.when(fine, end).alias("end")]
