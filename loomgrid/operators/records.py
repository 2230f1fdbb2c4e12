"""What a site's record says of all its alleles: genotypes, strands, equilibrium."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.functions import genotypes as G
from loomgrid.functions import phred
from loomgrid.operators import genotype
from loomgrid.operators.caller import moved
from loomgrid.operators.genotype import SITE, _reads, observed_genotype

#: Fixed value: the strand score of a vanishing p.
MOST_FS = 10000.0


def seen_sites(pileup: DataFrame) -> DataFrame:
    """``chrom, pos, ref_base, alts``: the other bases of a site, by (length, letters)."""
    off = pileup.where((F.col("read_base") != F.col("ref_base")) & ~F.upper("read_base").startswith("N"))
    got = off.groupBy(*SITE, "ref_base").agg(F.collect_set(F.struct(F.length("read_base").alias("n"), F.col("read_base").alias("b"))).alias("s"))
    return got.select(*SITE, "ref_base", F.transform(F.array_sort("s"), lambda x: x.b).alias("alts"))


def calls(pileup: DataFrame, sites: DataFrame, alt_share: float = 0.5) -> DataFrame:
    """``chrom, pos, sample_id, ref_base, alts, ad, dp, pl, gt, gq`` of covered samples at sites with any
    number of alternatives (``sites``: ``chrom, pos, alts``).

    A sample's list at a site holds its distinct (base, quality) pairs with their numbers.
    """
    own = pileup.join(sites.select(*SITE, "alts"), SITE).groupBy(*SITE, "sample_id", "ref_base", "alts", "read_base", "bq").agg(F.sum(_reads(pileup)).alias("n"))
    packed = own.groupBy(*SITE, "sample_id", "ref_base", "alts").agg(F.array_sort(F.collect_list(F.struct(F.col("read_base").alias("base"), "bq", "n"))).alias("reads"))
    alleles = F.concat(F.array("ref_base"), F.col("alts"))
    depth = lambda a: F.aggregate(F.filter("reads", lambda r: r.base == a), F.lit(0).cast("long"), lambda s, r: s + r.n)
    got = packed.withColumns({"ad": F.transform(alleles, depth), "pl": G.phred(G.likelihoods(F.col("reads"), alleles, alt_share, True))}).drop("reads")
    total = F.aggregate("ad", F.lit(0).cast("long"), lambda s, x: s + x)
    return got.withColumns({"dp": total, "gt": observed_genotype(F.col("pl")), "gq": G.second_smallest(F.col("pl"))})


def allele_shares(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """``chrom, pos, af``: each alternative's share of the reads that show an allele of the site."""
    own = pileup.join(sites.select(*SITE, "alts"), SITE).where((F.col("read_base") == F.col("ref_base")) | F.array_contains("alts", F.col("read_base")))
    each = own.groupBy(*SITE, "alts", "read_base").agg(F.sum(_reads(pileup)).alias("n"))
    per = each.groupBy(*SITE, "alts").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("read_base", "n"))).alias("m"))
    return per.select(*SITE, F.transform("alts", lambda a: F.coalesce(F.try_element_at("m", a), F.lit(0)) / F.col("t")).alias("af"))


def allele_dosages(posterior: Column, n: Column) -> Column:
    """Expected number of each alternative."""
    return F.transform(F.sequence(F.lit(1), n - 1), lambda a: G.allele_dosage(posterior, n, a))


def hwe(calls: DataFrame, n_samples: int) -> DataFrame:
    """``n0, n1, n2, chi2, p``: soft counts of REF/REF, of REF with any alternative and of alternatives
    alike, from likelihoods; a sample without reads is spread evenly over all genotypes."""
    m = F.size("alts") + 1
    at = lambda i: F.get("lik", i.cast("int"))
    total = lambda f: F.aggregate(F.sequence(F.lit(1), m - 1), F.lit(0.0), lambda s, j: s + at(f(j)))
    soft = calls.withColumn("lik", G.from_pl(F.col("pl"))).select(*SITE, m.alias("m"), F.get("lik", F.lit(0)).alias("a"), total(lambda j: j * (j + 1) / 2).alias("b"), total(lambda j: j * (j + 1) / 2 + j).alias("c"))
    per = soft.groupBy(*SITE, "m").agg(*[F.sum(x).alias(x) for x in "abc"], (F.lit(n_samples) - F.count("*")).alias("absent"))
    even = F.col("absent") * 2.0 / (F.col("m") * (F.col("m") + 1))
    got = per.select(*SITE, (F.col("a") + even).alias("n0"), (F.col("b") + even * (F.col("m") - 1)).alias("n1"), (F.col("c") + even * (F.col("m") - 1)).alias("n2"))
    got = got.withColumn("chi2", G.hwe_chi2(F.col("n0"), F.col("n1"), F.col("n2")))
    return got.withColumn("p", phred.chi2_tail_series(F.col("chi2")))


def strands(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """Per alternative: reads by strand of the site's deepest allele (the first of equals) and of the
    alternative, ``fs`` and ``sor``.

    Where the alternative is the deepest itself, half of its reads on each strand stand in for it.
    """
    each = pileup.where(~F.upper("read_base").startswith("N")).groupBy(*SITE, "read_base").agg(F.count_if(F.col("strand") == "+").alias("f"), F.count_if(F.col("strand") == "-").alias("r"))
    part = F.struct((-(F.col("f") + F.col("r"))).alias("order"), F.length("read_base").alias("l"), F.col("read_base").alias("base"), "f", "r")
    per = each.groupBy(*SITE).agg(F.array_sort(F.collect_list(part)).alias("bases")).join(sites.select(*SITE, "alts"), SITE)
    major = F.get("bases", F.lit(0))
    rows = per.select(*SITE, major.base.alias("major"), major.f.alias("mf"), major.r.alias("mr"), "bases", F.explode("alts").alias("alt"))
    own = F.get(F.filter("bases", lambda b: b.base == F.col("alt")), F.lit(0))
    got = rows.select(*SITE, "major", "alt", "mf", "mr", F.coalesce(own.f, F.lit(0)).alias("af"), F.coalesce(own.r, F.lit(0)).alias("ar"))
    half = F.round((F.col("mf") + F.col("mr")) / 2.0).cast("long")
    same = F.col("major") == F.col("alt")
    got = got.withColumns({"xf": F.when(same, half).otherwise(F.col("af")), "xr": F.when(same, half).otherwise(F.col("ar"))})
    p = phred.fisher_udf("mf", "mr", "xf", "xr")
    got = got.withColumn("p", p).withColumn("fs", F.when(F.col("p") <= 0, MOST_FS).otherwise(F.abs(F.log10("p") * -10.0)))
    return got.withColumn("sor", phred.sor(*(F.col(c) for c in ("mf", "mr", "xf", "xr")))).drop("xf", "xr", "p")


def rank_p(z: Column) -> Column:
    """Two-sided p of a rank-sum score."""
    return phred.chi2_tail_series(z * z)


@F.pandas_udf(T.StringType())
def written(x: pd.Series, pattern: pd.Series) -> pd.Series:
    """A number as C writes it (``%.6g``, ``%.3f``), ties by the binary value; the JVM rounds them up."""
    return pd.Series([None if pd.isna(v) else p % v for v, p in zip(x, pattern)], dtype=object)


@F.pandas_udf(T.StringType())
def listed(x: pd.Series) -> pd.Series:
    """Numbers of an array with at most six significant digits each, by commas."""
    return x.map(lambda a: ",".join("%.6g" % v for v in a), na_action="ignore")


def as_written(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads at called sites (``chrom, pos, ref, alts``), their bases and reference as the site's alleles are."""
    own = pileup.where(~F.upper("read_base").startswith("N")).join(sites.select(*SITE, "ref", "alts"), SITE)
    return own.withColumn("read_base", moved(F.col("ref_base"), F.col("ref"), F.col("read_base"))).withColumn("ref_base", F.col("ref")).drop("ref", "alts")


def _of_genotypes(calls: DataFrame, gt: str, ending: str) -> DataFrame:
    """Per alternative and in all, the alleles of ``gt``: ``ac, an, af`` with an ending."""
    n = F.size("alts")
    each = calls.select(*SITE, n.alias("m"), F.explode(F.filter(gt, lambda a: a >= 0)).alias("a")).groupBy(*SITE, "m", "a").agg(F.count("*").alias("n"))
    per = each.groupBy(*SITE, "m").agg(F.sum("n").alias("an"), F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("c"))
    ac = F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0).cast("long")))
    return per.withColumn("ac", ac).select(*SITE, F.col("ac").alias(f"ac{ending}"), F.col("an").alias(f"an{ending}"), F.transform("ac", lambda x: x / F.col("an")).alias(f"af{ending}"))


def annotated(pileup: DataFrame, sites: DataFrame, n_samples: int, groups: DataFrame | None = None, alt_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``sites`` with ``info``, and sample fields ``chrom, pos, sample_id, gt, gq, pl, ad, dp``.

    ``sites``: ``chrom, pos, ref, alts, qual, dp, af``; ``groups``: ``chrom, pos, group, dp, af``.
    Samples without reads enter allele counts and equilibrium by their number.  Rank sums stand at
    sites of one alternative that show both alleles.
    """
    reads = as_written(pileup, sites)
    own = genotype.counted(reads)
    first = calls(own, sites, alt_share)
    post = genotype.with_posterior(first.withColumnRenamed("gt", "gt_obs").drop("gq"), sites).withColumn("dose", allele_dosages(F.col("posterior"), F.size("alts") + 1))
    an = 2 * n_samples
    prior = allele_dosages(G.normalised(G.hw_prior(G.allele_freqs(F.col("af")))), F.size("alts") + 1)
    seen = post.select(*SITE, F.posexplode("dose").alias("i", "x")).groupBy(*SITE, "i").agg(F.sum("x").alias("x"), F.count("*").alias("covered"))
    seen = seen.groupBy(*SITE).agg(F.first("covered").alias("covered"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y.x).alias("dose"))
    total = F.zip_with("dose", prior, lambda x, p: x + p * (F.lit(n_samples) - F.col("covered")))
    strand = strands(reads, sites).select(*SITE, F.struct(F.col("alt"), F.struct("af", "ar", "fs", "sor").alias("v")).alias("e"))
    strand = strand.groupBy(*SITE).agg(F.map_from_entries(F.collect_list("e")).alias("s"))
    ref = reads.where("read_base = ref_base").groupBy(*SITE).agg(F.count_if(F.col("strand") == "+").alias("rf"), F.count_if(F.col("strand") == "-").alias("rr"))
    out = sites.join(seen, SITE).join(strand, SITE).join(ref, SITE, "left").join(_of_genotypes(post, "gt_obs", "_obs"), SITE).join(_of_genotypes(post, "gt", "_gt"), SITE).join(hwe(first, n_samples).select(*SITE, F.col("p").alias("hwe")), SITE)
    single = sites.where(F.size("alts") == 1).select(*SITE, F.get("alts", F.lit(0)).alias("alt"))
    for v in ("bq", "mapq", "rpr"):
        out = out.join(genotype.rank_sum(reads, single, v).where("n1 > 0 and n2 > 0").select(*SITE, F.col("z").alias(f"z_{v}")), SITE, "left")
    out = out.withColumn("total", total).withColumn("strand", F.transform("alts", lambda a: F.element_at("s", a)))
    ints = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    key = lambda k, v: F.concat(F.lit(k + "="), v)
    four = F.flatten(F.concat(F.array(F.array(F.coalesce("rf", F.lit(0)), F.coalesce("rr", F.lit(0)))), F.transform("strand", lambda x: F.array(x.af, x.ar))))
    fields = [
        key("AF", listed(F.transform("total", lambda x: x / an))), key("AC", ints(F.transform("total", lambda x: F.round(x).cast("long")))), F.lit(f"AN={an}"), key("DP", F.col("dp").cast("string")), key("DP4", ints(four)),
        key("FS", listed(F.transform("strand", lambda x: x.fs))), key("SOR", listed(F.transform("strand", lambda x: x.sor))),
        *[key(f"{a}_{t}", v) for t in ("obs", "GT") for a, v in (("AC", ints(F.col(f"ac_{t}"))), ("AN", F.col(f"an_{t}").cast("string")), ("AF", listed(F.col(f"af_{t}"))))],
        key("HWE", written("hwe", F.lit("%.6g"))), *[key(k, written(f"z_{v}", F.lit("%.3f"))) for k, v in (("BaseQRankSum", "bq"), ("MQRankSum", "mapq"), ("ReadPosRankSum", "rpr"))],
    ]
    if groups is not None:
        own_groups = groups.withColumn("text", listed("af")).groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("group", "dp", "text"))).alias("g"))
        out = out.join(own_groups, SITE, "left")
        fields.append(F.array_join(F.transform("g", lambda x: F.concat(F.lit("DP_"), x.group, F.lit("="), x.dp.cast("string"))), ";"))
        fields.append(F.array_join(F.transform("g", lambda x: F.concat(F.lit("AF_"), x.group, F.lit("="), x.text)), ";"))
    return out.select(*sites.columns, F.concat_ws(";", *fields).alias("info")), post.select(*SITE, "sample_id", "gt", "gq", "pl", "ad", "dp")
