"""Commands: caller, motif, fetalfrac, subsam, concat, pipeline, dump."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomgrid")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("caller", help="variant sites of a pileup table or of alignments with a reference")
    c.add_argument("-f", "--reference")
    c.add_argument("-I", "--input", required=True, help="alignment files (glob) or a Parquet pileup")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-r", "--regions", default="")
    c.add_argument("-G", "--pop-group")
    c.add_argument("-m", "--min-af", type=float, default=0.001)
    c.add_argument("-Q", "--min-baseq", type=int, default=10)
    c.add_argument("-q", "--min-mapq", type=int, default=5)
    c.add_argument("--ref-bias", type=float, default=0.5, help="share of a heterozygote's reads that show its other allele than the reference")
    c.add_argument("--max-alleles", type=int, default=6, choices=range(1, 11))
    c.add_argument("--filename-has-samplename", action="store_true")

    m = sub.add_parser("motif", help="end motifs per sample")
    m.add_argument("-I", "--input", required=True)
    m.add_argument("-o", "--output", required=True)
    m.add_argument("-r", "--regions", default="")
    m.add_argument("-l", "--length", type=int, default=4, choices=range(1, 11))
    m.add_argument("-q", "--min-mapq", type=int, default=30)
    m.add_argument("--reads", default="R1", choices=("R1", "R2", "both"))
    m.add_argument("--include-zero", action=argparse.BooleanOptionalAction, default=True)
    m.add_argument("--proper-pair", action="store_true")
    m.add_argument("--max-insert-size", type=int, default=0)
    m.add_argument("--fprofile", help="file of profiles: motif and one column each")
    m.add_argument("--filename-has-samplename", action="store_true")

    f = sub.add_parser("fetalfrac", help="fetal fraction from chromosome Y")
    f.add_argument("-I", "--input", required=True)
    f.add_argument("-o", "--output", required=True)
    f.add_argument("-B", "--bed")
    f.add_argument("-r", "--regions", default="")
    f.add_argument("-q", "--min-mapq", type=int, default=30)
    f.add_argument("--build", default="hg38", choices=("hg38", "hg19"))
    f.add_argument("--proper-pair", action="store_true")
    f.add_argument("--max-insert-size", type=int, default=0)
    f.add_argument("--scale", default="auto")
    f.add_argument("--noise", type=float, default=0.0)
    f.add_argument("--male-threshold", type=float, default=1e-4)
    f.add_argument("--calibrate", action="store_true")
    f.add_argument("--filename-has-samplename", action="store_true")

    s = sub.add_parser("subsam", help="subset of a variant table's samples")
    s.add_argument("-i", "--input", required=True)
    s.add_argument("-o", "--output", required=True)
    s.add_argument("-s", "--sample-list")
    s.add_argument("--keep-all-site", action="store_true")
    s.add_argument("samples", nargs="*")

    t = sub.add_parser("concat", help="union of variant tables")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-n", "--naive", action="store_true", help="check that samples agree")
    t.add_argument("inputs", nargs="+")

    w = sub.add_parser("pipeline", help="one command per window; other options are passed on")
    w.add_argument("-o", "--outdir", required=True)
    w.add_argument("--ref_fai", required=True)
    w.add_argument("-d", "--delta", type=int, default=2_000_000)
    w.add_argument("-c", "--chrom", default="")

    d = sub.add_parser("dump", help="rows of a pileup table")
    d.add_argument("input")
    d.add_argument("--header", action="store_true")
    d.add_argument("-r", "--region", default="")
    d.add_argument("-n", "--limit", type=int, default=20)
    return p


def _alignments(spark, a):
    from loomgrid.sources import alignments

    alignments.register(spark)
    return spark.read.format("alignments").option("samplefromname", str(a.filename_has_samplename).lower()).load(a.input)


def _in_regions(rows, regions: str):
    """Rows whose ``pos`` lies in any of the comma-separated regions; all rows without one."""
    from loomgrid.functions import sequence

    found = [x for x in (sequence.parse_region(r) for r in regions.split(",")) if x]
    if not found:
        return rows
    inside = F.lit(False)
    for chrom, start, end in found:
        inside = inside | ((F.col("chrom") == chrom) & (F.col("pos") >= start) & ((F.col("pos") <= end) if end >= 0 else F.lit(True)))
    return rows.where(inside)


def run(argv: list[str]) -> None:
    from loomgrid.functions import flags, sequence
    from loomgrid.operators import caller, fetal, fragments, intervals, pileup, records, variants
    from loomgrid.session import session
    from loomgrid.sources import text, vcf

    a, rest = parser().parse_known_args(argv)
    if rest and a.command != "pipeline":
        raise SystemExit(f"unknown arguments: {rest}")
    spark = session()
    flag, mapq, isize = F.col("flag"), F.col("mapq"), F.col("isize")
    if a.command == "caller":
        if a.output.endswith((".bcf", ".bcf.gz")):
            raise SystemExit("BCF output isn't supported")
        if a.reference:
            chunks = text.read_fasta(spark, a.reference)
            reads = _alignments(spark, a).where(flags.caller_reads(flag, mapq, a.min_mapq))
            reads = reads.withColumn("strand", F.when(flags.bit(flag, "reverse"), "-").otherwise("+"))
            rows = pileup.elements(reads, chunks).where(F.col("bq") >= a.min_baseq)
            rows = pileup.relocate_indels(rows).drop("is_indel")
        else:
            rows = pileup.kept_reads(spark.read.parquet(a.input), a.min_mapq, a.min_baseq)
        rows = _in_regions(rows, a.regions)
        n = rows.select("sample_id").distinct().count()
        least = pileup.min_af_for(max(1, n), a.min_af)
        as_text = a.output.endswith((".vcf", ".vcf.gz"))
        table = a.output + ".sites" if as_text else a.output
        caller.call_sites(rows, least, a.max_alleles).write.mode("overwrite").parquet(table)
        sites, groups = spark.read.parquet(table), None
        if a.pop_group:
            caller.group_af(rows, sites, text.read_groups(spark, a.pop_group), least, a.max_alleles).write.mode("overwrite").parquet(a.output + ".groups")
            groups = spark.read.parquet(a.output + ".groups")
        if as_text:
            found, calls = records.annotated(rows, sites, n, groups, a.ref_bias)
            names = sorted(x[0] for x in rows.select("sample_id").distinct().collect())  # the header names them all
            known = text.lengths(chunks, a.reference + ".fai" if os.path.exists(a.reference + ".fai") else None) if a.reference else {x.chrom: x.top for x in sites.groupBy("chrom").agg(F.max("pos").alias("top")).collect()}
            calls = calls.select("chrom", "pos", "sample_id", vcf.sample_text(*(F.col(c) for c in ("gt", "gq", "pl", "ad", "dp"))).alias("text"))
            order = {c: i for i, c in enumerate(known)}
            head = vcf.header(names, known.items(), sorted(x[0] for x in groups.select("group").distinct().collect()) if groups is not None else ())
            vcf.write(vcf.lines(found, calls, names, order), head, a.output)
    elif a.command == "motif":
        reads = _alignments(spark, a).withColumn("pos", F.col("pos0") + 1).where(flags.motif_reads(flag, mapq, isize, a.reads, min_mapq=a.min_mapq, proper_pair=a.proper_pair, max_insert=a.max_insert_size))
        if a.regions:  # overlapping regions could give a read twice
            reads = fragments.once(_in_regions(reads, a.regions))
        motifs = reads.select("sample_id", sequence.end_motif(F.col("seq"), flags.bit(flag, "reverse"), a.length).alias("motif"))
        counts = fragments.frequencies(fragments.motif_counts(motifs, a.length, a.include_zero))
        table = counts.select(F.col("sample_id").alias("#sample"), "motif", "count", records.written("frequency", F.lit("%.6f")).alias("frequency"))
        table.orderBy("#sample", "motif").write.mode("overwrite").csv(a.output, sep="\t", header=True)
        if a.fprofile and a.length == 4:
            fragments.decompose(counts, *text_profiles(spark, a.fprofile)).select("sample_id", F.array_join(F.transform("weights", lambda w: F.format_number(w, 6)), "\t").alias("weights")).write.mode("overwrite").csv(a.output + ".fprofile", sep="\t")
    elif a.command == "fetalfrac":
        reads = _in_regions(_alignments(spark, a).withColumn("pos", F.col("pos0") + 1), a.regions)
        bed = text.read_bed(spark, a.bed) if a.bed else None
        counts = fetal.counters(reads, flags.counted_reads(flag, mapq, isize, min_mapq=a.min_mapq, proper_pair=a.proper_pair, max_insert=a.max_insert_size), a.build, bed)
        scale = fetal.scale_of(a.build, bed) if a.scale == "auto" else float(a.scale)
        out = fetal.fraction(counts, scale, a.noise, a.male_threshold)
        eight = lambda c: records.written(c, F.lit("%.8f"))
        counted = [F.col(c).alias(n) for c, n in (("auto", "valid_autosomal"), ("y", "valid_y"), ("par", "y_par_excluded"), ("total", "total_reads"), ("filtered", "filtered_reads"))]
        table = out.select(F.col("sample_id").alias("#sample"), "sex", eight("fetal_fraction").alias("fetal_fraction"), eight("y_ratio").alias("y_ratio"), *counted, *[F.lit(f"{v:.8f}").alias(k) for k, v in (("scale", scale), ("noise", a.noise), ("male_threshold", a.male_threshold))])
        table.orderBy("#sample").write.mode("overwrite").csv(a.output, sep="\t", header=True)
        if a.calibrate:
            fetal.calibrate(out, a.noise).write.mode("overwrite").csv(a.output + ".calibration", sep="\t", header=True)
    elif a.command == "subsam":
        sites, names = vcf.read_vcf(spark, a.input)
        wanted = a.samples + ([r[0] for r in text.read_list(spark, a.sample_list).collect()] if a.sample_list else [])
        if missing := sorted(set(wanted) - set(names)):
            raise SystemExit(f"unknown samples: {missing}")
        calls = variants.subset(vcf.calls_of(sites, names), wanted)
        pruned, renumbered = variants.prune(sites.select("chrom", "pos", "id", "ref", "alts", "qual", "filter"), calls)
        variants.recount(pruned, renumbered, a.keep_all_site).write.mode("overwrite").parquet(a.output)
    elif a.command == "concat":
        tables = [vcf.read_vcf(spark, x) for x in a.inputs]
        if a.naive and any(n != tables[0][1] for _, n in tables):
            raise SystemExit("samples differ")
        variants.concat([t for t, _ in tables]).write.mode("overwrite").parquet(a.output)
    elif a.command == "pipeline":
        lengths = {r.chrom: r.length for r in text.read_fai(spark, a.ref_fai, [c for c in a.chrom.split(",") if c] or None).collect()}
        regions = spark.createDataFrame([(c, 1, n) for c, n in lengths.items()], "chrom string, start long, end long")
        for r in intervals.commands(intervals.tiles(regions, a.delta), "loomgrid caller", " ".join(rest), a.outdir).orderBy("chrom", "start").toLocalIterator():
            print(r.command)
    elif a.command == "dump":
        df = spark.read.parquet(a.input)
        if a.header:
            df.printSchema()
            return
        if region := sequence.parse_region(a.region):
            df = df.where((F.col("chrom") == region[0]) & (F.col("pos") >= region[1]) & ((F.col("pos") <= region[2]) if region[2] >= 0 else F.lit(True)))
        df.limit(a.limit).show(a.limit, False)


def text_profiles(spark, path: str):
    from loomgrid.operators.fragments import read_profiles

    return read_profiles(spark, path)


if __name__ == "__main__":
    run(sys.argv[1:])
