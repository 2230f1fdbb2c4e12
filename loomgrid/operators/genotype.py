"""Per-sample genotypes and the counts that sites report of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import genotypes as G

SITE = ["chrom", "pos"]


def counted(pileup: DataFrame) -> DataFrame:
    """Reads of equal sample, base and quality in one row with their number ``reads``, and all rows of
    a site together.  The steps of this module take such tables as well as single reads."""
    return pileup.groupBy(*SITE, "sample_id", "ref_base", "read_base", "bq").agg(F.count("*").alias("reads")).repartition(*SITE)


def at_sites(pileup: DataFrame) -> DataFrame:
    """``counted`` reads at biallelic sites with the alternative ``alt`` and its share ``af`` of the reads
    that show REF or it.  Both come from windows over the site, so all that follows by site or below
    (``calls``, ``with_posterior``) needs neither a join nor a further shuffle."""
    site = Window.partitionBy(*SITE)
    base, ref, alt, n = F.col("read_base"), F.col("ref_base"), F.col("alt"), F.col("reads")
    rows = counted(pileup).withColumn("depth", F.sum(n).over(Window.partitionBy(*SITE, "read_base")))
    deepest = F.max_by(F.when(base != ref, base), F.when(base != ref, F.struct("depth", (-F.ascii(base)).alias("order"))))
    rows = rows.withColumn("alt", deepest.over(site)).where("alt is not null")
    of_alt, of_ref = (F.sum(F.when(base == x, n).otherwise(0)).over(site) for x in (alt, ref))
    return rows.withColumn("af", F.array(of_alt / (of_alt + of_ref))).drop("depth")


def _reads(pileup: DataFrame) -> Column:
    return F.col("reads") if "reads" in pileup.columns else F.lit(1)


def biallelic_sites(pileup: DataFrame) -> DataFrame:
    """Sites with reads off the reference: REF and the deepest other base (the first of equals)."""
    depth = pileup.groupBy(*SITE, "ref_base", "read_base").agg(F.sum(_reads(pileup)).alias("depth"))
    alt = F.max_by("read_base", F.struct("depth", (-F.ascii("read_base")).alias("order")))
    return depth.where(F.col("read_base") != F.col("ref_base")).groupBy(*SITE, "ref_base").agg(alt.alias("alt"))


def calls(pileup: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """``chrom, pos, sample_id, ad, dp, pl`` of covered samples at biallelic sites, which are given or come
    with the reads (``at_sites``, whose ``af`` is kept).

    Log-likelihoods of the three genotypes are sums over reads, so they are formed before the
    shuffle; no read list is gathered.
    """
    own, n = pileup if sites is None else pileup.join(sites.select(*SITE, "alt"), SITE), _reads(pileup)
    of_site = ["ref_base", "alt", *(["af"] if sites is None else [])]
    alleles = F.array("ref_base", "alt")
    pair = {"l0": (0, 0), "l1": (0, 1), "l2": (1, 1)}
    sums = [F.sum(n * G.read_log10(F.col("read_base"), F.col("bq"), F.get(alleles, F.lit(a)), F.get(alleles, F.lit(b)))).alias(x) for x, (a, b) in pair.items()]
    shown = lambda c: F.sum(F.when(F.col("read_base") == F.col(c), n).otherwise(0))
    got = own.groupBy(*SITE, "sample_id", *of_site).agg(*sums, shown("ref_base").alias("ref_n"), shown("alt").alias("alt_n"))
    pl = G.phred(F.array("l0", "l1", "l2"))
    return got.select(*SITE, "sample_id", *of_site, F.array("ref_n", "alt_n").alias("ad"), (F.col("ref_n") + F.col("alt_n")).alias("dp"), pl.alias("pl"))


def observed_genotype(pl: Column) -> Column:
    """``array<int>`` of the genotype with the smallest PL."""
    n = F.floor((F.sqrt(F.size(pl) * 8.0 + 1.0) - 1.0) / 2.0).cast("int")
    g = F.get(G.pairs(n), G.argmin_genotype(pl))
    return F.array(g.k, g.j)


def with_posterior(calls: DataFrame, afs: DataFrame | None = None) -> DataFrame:
    """Adds ``posterior, gt, gq, dosage`` under a Hardy-Weinberg prior of the site's frequencies
    (``afs``: ``chrom, pos, af array``, one per alternative; without it the calls' own ``af``)."""
    freqs = G.allele_freqs(F.col("af"))
    post = G.posterior(G.from_pl(F.col("pl")), G.hw_prior(freqs))
    out = (calls if afs is None else calls.join(afs.select(*SITE, "af"), SITE)).withColumn("posterior", post)
    best = G.argmax(F.transform("posterior", lambda x: F.round(x, 12)))  # the first of equals, whatever the order of the products
    pair = F.get(G.pairs(F.size(freqs)), best)
    return out.withColumns({"gt": F.array(pair.k, pair.j), "gq": G.quality(F.array_max("posterior")), "dosage": G.dosage(F.col("posterior"), F.size(freqs))})


def read_af(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """The alternative's share of the reads that show REF or it."""
    own, n = pileup.join(sites.select(*SITE, "alt"), SITE), _reads(pileup)
    own = own.where((F.col("read_base") == F.col("ref_base")) | (F.col("read_base") == F.col("alt")))
    return own.groupBy(*SITE).agg((F.sum(F.when(F.col("read_base") == F.col("alt"), n).otherwise(0)) / F.sum(n)).alias("f")).select(*SITE, F.array("f").alias("af"))


def counts(calls: DataFrame, gt: str = "gt", names: tuple[str, str, str] = ("ac", "an", "af")) -> DataFrame:
    """AC per alternative, AN and AF out of genotype arrays; missing alleles (-1) don't count."""
    alleles = F.filter(F.col(gt), lambda a: a >= 0)
    per = calls.groupBy(*SITE).agg(F.sum(F.size(F.filter(alleles, lambda a: a == 1))).alias(names[0]), F.sum(F.size(alleles)).alias(names[1]))
    return per.withColumn(names[2], F.when(F.col(names[1]) > 0, F.col(names[0]) / F.col(names[1])).otherwise(0.0))


def dosage_counts(posts: DataFrame, n_samples: int) -> DataFrame:
    """AC, AN and AF from dosages of all samples.

    A sample without reads has flat likelihoods, so its posterior is the prior, normalised; those
    are added by their number instead of as rows.
    """
    prior = G.hw_prior(G.allele_freqs(F.col("af")))
    own = posts.groupBy(*SITE).agg(F.sum("dosage").alias("seen"), F.count("*").alias("covered"), F.first("af").alias("af"))
    absent = (F.lit(n_samples) - F.col("covered")) * G.dosage(G.normalised(prior), F.size("af") + 1)
    total = F.col("seen") + absent
    return own.select(*SITE, F.round(total).cast("long").alias("ac"), F.lit(2 * n_samples).cast("long").alias("an"), (total / (2.0 * n_samples)).alias("af"))


def legacy_counts(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """AC: samples that show the alternative; AN: alleles seen, summed over samples, REF among them."""
    own = pileup.join(sites.select(*SITE, "alt"), SITE)
    each = own.groupBy(*SITE, "sample_id").agg(F.max((F.col("read_base") == F.col("alt")).cast("int")).alias("a"), F.max((F.col("read_base") == F.col("ref_base")).cast("int")).alias("r"))
    return each.groupBy(*SITE).agg(F.sum("a").alias("ac"), F.sum(F.col("a") + F.col("r")).alias("an"))


def hwe(calls: DataFrame, n_samples: int) -> DataFrame:
    """Soft genotype counts from PL likelihoods, a third each for samples without reads; chi-square."""
    lik = G.from_pl(F.col("pl"))
    own = calls.withColumn("lik", lik).groupBy(*SITE).agg(*[F.sum(F.get("lik", F.lit(i))).alias(f"s{i}") for i in range(3)], F.count("*").alias("covered"))
    each = [F.col(f"s{i}") + (F.lit(n_samples) - F.col("covered")) / 3.0 for i in range(3)]
    return own.select(*SITE, *[e.alias(f"n{i}") for i, e in enumerate(each)]).withColumn("chi2", G.hwe_chi2(F.col("n0"), F.col("n1"), F.col("n2")))


def strand_table(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads of REF and of the alternative by strand: ``rf, rr, af, ar``."""
    own = pileup.join(sites.select(*SITE, "alt"), SITE)
    n = lambda base, s: F.count_if((F.col("read_base") == F.col(base)) & (F.col("strand") == s))
    return own.groupBy(*SITE).agg(n("ref_base", "+").alias("rf"), n("ref_base", "-").alias("rr"), n("alt", "+").alias("af"), n("alt", "-").alias("ar"))


def rank_sum(pileup: DataFrame, sites: DataFrame, value: str) -> DataFrame:
    """Z of REF against ALT reads: ranks fall with the value, ties share their mean, no tie correction.

    Ranks come from the counts of distinct values, so the window runs over a site's values.
    """
    own = pileup.join(sites.select(*SITE, "alt"), SITE).where((F.col("read_base") == F.col("ref_base")) | (F.col("read_base") == F.col("alt")))
    per = own.groupBy(*SITE, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("read_base") == F.col("ref_base")).alias("n_ref"))
    above = F.sum("n").over(Window.partitionBy(*SITE).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = per.withColumn("rank", F.coalesce(above, F.lit(0)) + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*SITE).agg(F.sum(F.col("rank") * F.col("n_ref")).alias("r1"), F.sum("n_ref").cast("double").alias("n1"), F.sum(F.col("n") - F.col("n_ref")).cast("double").alias("n2"))
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") * (n + 1.0) / 12.0
    z = F.when(var < 1e-10, 0.0).otherwise((F.col("r1") - F.col("n1") * (n + 1.0) / 2.0) / F.sqrt(var))
    return sums.select(*SITE, "n1", "n2", "r1", z.alias("z"))
