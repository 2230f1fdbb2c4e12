"""Alignment flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of the public alignment format.
BITS = {"paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20, "read1": 0x40, "read2": 0x80, "secondary": 0x100, "qc_fail": 0x200, "duplicate": 0x400, "supplementary": 0x800}


def bit(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(BITS[name])) != 0


def decoded(flag: Column) -> dict[str, Column]:
    """The twelve predicates; those that speak of an alignment are false for unmapped reads, those
    that speak of a mate are false for unpaired ones."""
    mapped, paired = ~bit(flag, "unmapped"), bit(flag, "paired")
    return {
        "is_paired": paired,
        "is_proper_pair": paired & bit(flag, "proper_pair"),
        "is_mapped": mapped,
        "is_mate_mapped": paired & ~bit(flag, "mate_unmapped"),
        "is_reverse": bit(flag, "reverse"),
        "is_mate_reverse": paired & bit(flag, "mate_reverse"),
        "is_read1": bit(flag, "read1"),
        "is_read2": bit(flag, "read2"),
        "is_secondary": mapped & bit(flag, "secondary"),
        "is_qc_fail": mapped & bit(flag, "qc_fail"),
        "is_duplicate": mapped & bit(flag, "duplicate"),
        "is_supplementary": mapped & bit(flag, "supplementary"),
    }


def proper_orientation(flag: Column, chrom: Column, pos: Column, mate_chrom: Column, mate_pos: Column) -> Column:
    """Both mapped to one sequence, and a forward read before its reverse mate: the read that lies
    first must be that one, any other read must not look like it."""
    d = decoded(flag)
    forward = ~d["is_reverse"] & bit(flag, "mate_reverse")
    return d["is_mapped"] & d["is_mate_mapped"] & (chrom == mate_chrom) & F.when(pos < mate_pos, forward).otherwise(~forward)


def caller_reads(flag: Column, mapq: Column, min_mapq: int = 5) -> Column:
    d = decoded(flag)
    return (mapq >= min_mapq) & ~(d["is_duplicate"] | d["is_qc_fail"] | d["is_secondary"] | d["is_supplementary"])


def counted_reads(flag: Column, mapq: Column, isize: Column, min_mapq: int = 30, proper_pair: bool = False, max_insert: int = 0) -> Column:
    """Mapped primary reads of quality; pair tests speak only of paired ones."""
    d = decoded(flag)
    keep = d["is_mapped"] & (mapq >= min_mapq) & ~(d["is_duplicate"] | d["is_qc_fail"] | d["is_secondary"] | d["is_supplementary"])
    if proper_pair:
        keep = keep & (~d["is_paired"] | d["is_proper_pair"])
    if max_insert > 0:
        keep = keep & (~d["is_paired"] | (F.abs(isize) <= max_insert))
    return keep


def motif_reads(flag: Column, mapq: Column, isize: Column, ends: str = "R1", **options) -> Column:
    """``counted_reads`` of the wanted end; a read without a mate counts as the first."""
    d = decoded(flag)
    first, second = ~d["is_paired"] | d["is_read1"], d["is_paired"] & d["is_read2"]
    wanted = {"R1": first, "R2": second, "both": first | second}[ends]
    return counted_reads(flag, mapq, isize, **options) & wanted
