"""Variant text files: reader, header and writer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys, numbers and types of the header's fields.
FORMATS = (("GT", "1", "String"), ("GQ", "1", "Integer"), ("PL", "G", "Integer"), ("AD", "R", "Integer"), ("DP", "1", "Integer"))
INFOS = (
    ("AF", "A", "Float"), ("AC", "A", "Integer"), ("AN", "1", "Integer"), ("DP", "1", "Integer"), ("DP4", ".", "Integer"), ("FS", "A", "Float"), ("SOR", "A", "Float"),
    ("AC_obs", "A", "Integer"), ("AN_obs", "1", "Integer"), ("AF_obs", "A", "Float"), ("AC_GT", "A", "Integer"), ("AN_GT", "1", "Integer"), ("AF_GT", "A", "Float"),
    ("HWE", "1", "Float"), ("BaseQRankSum", "1", "Float"), ("MQRankSum", "1", "Float"), ("ReadPosRankSum", "1", "Float"),
)
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header(samples: Iterable[str], contigs: Iterable[tuple[str, int]], groups: Iterable[str] = (), command: str = "") -> list[str]:
    """Header lines; populations add a depth and a frequency field each."""
    out = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">']
    out += [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{i} of a sample">' for i, n, t in FORMATS]
    out += [f'##INFO=<ID={i},Number={n},Type={t},Description="{i} of a site">' for i, n, t in INFOS]
    for g in groups:
        out += [f'##INFO=<ID=DP_{g},Number=1,Type=Integer,Description="Depth in {g}">', f'##INFO=<ID=AF_{g},Number=A,Type=Float,Description="Allele frequency in {g}">']
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    if command:
        out.append(f"##command={command}")
    return [*out, "#" + "\t".join([*COLUMNS, *samples])]


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Sites with raw sample columns: ``chrom, pos, id, ref, alts, qual, filter, info (map), format,
    samples (array)``, and the samples' names.  Plain and gzip files; BCF isn't text."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"no header line in {path}; BCF isn't supported")
    names = head[0].rstrip("\r").split("\t")[9:]
    p = F.split("value", "\t", -1)
    at = lambda i: F.get(p, F.lit(i))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    sites = rows.select(
        at(0).alias("chrom"), at(1).cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), F.when(at(4) == ".", F.array().cast("array<string>")).otherwise(F.split(at(4), ",")).alias("alts"),
        at(5).try_cast("double").alias("qual"), at(6).alias("filter"), F.str_to_map(at(7), F.lit(";"), F.lit("=")).alias("info"), F.split(at(8), ":").alias("format"), F.slice(p, 10, len(names) + 1).alias("samples"),
    )
    return sites, names


def calls_of(sites: DataFrame, names: list[str]) -> DataFrame:
    """Long form ``chrom, pos, sample_id, gt array<int>, fields map``: missing alleles are -1, short
    value lists lack their last keys."""
    each = sites.select("chrom", "pos", "format", F.posexplode("samples").alias("i", "text"))
    values = F.split("text", ":")
    fields = F.map_from_arrays(F.slice("format", 1, F.least(F.size("format"), F.size(values))), F.slice(values, 1, F.least(F.size("format"), F.size(values))))
    gt = F.transform(F.split(F.try_element_at("fields", F.lit("GT")), "[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))
    named = F.get(F.lit(names), F.col("i"))
    return each.withColumn("fields", fields).select("chrom", "pos", named.alias("sample_id"), gt.alias("gt"), "fields")


def valid(chrom: Column, pos: Column, ref: Column, alts: Column) -> Column:
    """A record worth writing: names and alleles there, REF of known letters, no ALT equal to it."""
    return (chrom != "") & (pos != 0) & ref.rlike("^[ACGTNacgtn*]+$") & (F.upper(ref) != "N") & ~F.exists(alts, lambda a: (a == "") | (a == ref))


def sample_text(gt: Column, gq: Column, pl: Column, ad: Column, dp: Column) -> Column:
    joined = lambda a, by: F.array_join(F.transform(a, lambda x: x.cast("string")), by)
    return F.when(dp > 0, F.concat_ws(":", joined(gt, "/"), F.round(gq).cast("int").cast("string"), joined(pl, ","), joined(ad, ","), dp.cast("string"))).otherwise("./.")


def lines(sites: DataFrame, calls: DataFrame, samples: list[str], order: dict[str, int] | None = None) -> DataFrame:
    """Body lines in order of contig and position: ``value``.  ``calls``: ``chrom, pos, sample_id, text``."""
    texts = calls.groupBy("chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "text"))).alias("m"))
    body = sites.where(valid(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alts"))).join(texts, ["chrom", "pos"], "left")
    alts = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    qual = F.when(F.col("qual") > 0, F.col("qual").cast("string")).otherwise(".")
    own = F.transform(F.lit(samples), lambda s: F.coalesce(F.try_element_at("m", s), F.lit("./.")))
    value = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", alts, qual, F.lit("."), "info", F.lit(":".join(f[0] for f in FORMATS)), F.array_join(own, "\t"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col("chrom")), F.lit(len(order))) if order else F.lit(0)
    return body.withColumn("rank", rank).orderBy("rank", "chrom", "pos").select(value.alias("value"))


def write(body: DataFrame, head: list[str], path: str) -> None:
    """Parts of a VCF in ``path``: the header is a part of its own that sorts first."""
    if path.endswith((".bcf", ".bcf.gz")):
        raise ValueError("BCF output isn't supported; use .vcf or .vcf.gz")
    spark = body.sparkSession
    codec = "gzip" if path.endswith(".gz") else "none"
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").option("compression", codec).text(path + "/header")
    body.write.mode("overwrite").option("compression", codec).text(path + "/body")
