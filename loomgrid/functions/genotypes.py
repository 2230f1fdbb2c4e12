"""Genotype likelihoods, priors and posteriors as column expressions.

Genotypes of n alleles are ordered (0,0), (0,1), (1,1), (0,2), ...: for each j all k <= j.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PL_FLOOR = 1e-6


def pairs(n: int | Column) -> Column:
    """``array<struct<k,j>>`` of all genotypes of ``n`` alleles."""
    last = (F.lit(n) if isinstance(n, int) else n) - 1
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda j: F.transform(F.sequence(F.lit(0), j), lambda k: F.struct(k.alias("k"), j.alias("j")))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside lambdas an expression is evaluated again
    for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _error(bq: Column) -> Column:
    return F.when(bq < 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -bq / 10.0))


def _shown(base: Column, error: Column, allele: Column) -> Column:
    """P(read | allele): an error falls on three others."""
    return F.when(base == allele, 1.0 - error).otherwise(error / 3.0)


def read_log10(base: Column, bq: Column, a: Column, b: Column) -> Column:
    """log10 P(read | genotype a/b): the mean of both alleles."""
    e = _error(bq)
    return F.log10((_shown(base, e, a) + _shown(base, e, b)) / 2.0)


def likelihoods(reads: Column, alleles: Column, alt_share: float = 0.5, counted: bool = False) -> Column:
    """Summed log10 likelihood per genotype of ``reads`` (array of ``base, bq``, and ``n`` if they are
    ``counted``); N is left out.

    ``alt_share`` is the share of reads that a heterozygote of the reference shows of its other allele.
    """
    if not 0.0 <= alt_share <= 1.0:
        raise ValueError("the share must lie between 0 and 1")
    used = F.transform(F.filter(reads, lambda r: ~F.upper(r.base).startswith("N")), lambda r: F.struct(r.base.alias("base"), _error(r.bq).alias("e"), (r.n if counted else F.lit(1)).alias("n")))

    def of(rs: Column, names: Column) -> Column:
        share = lambda g: F.when((g.k == 0) & (g.j > 0), F.lit(alt_share)).otherwise(F.lit(0.5))
        each = F.transform(pairs(F.size(names)), lambda g: F.struct(F.get(names, g.k).alias("a"), F.get(names, g.j).alias("b"), share(g).alias("w")))
        return F.transform(each, lambda g: F.aggregate(rs, F.lit(0.0), lambda s, r: s + r.n * F.log10((1.0 - g.w) * _shown(r.base, r.e, g.a) + g.w * _shown(r.base, r.e, g.b))))

    return let(used, lambda rs: let(alleles, lambda names: of(rs, names)))


def phred(logs: Column) -> Column:
    """Integer Phred scores relative to the best genotype."""
    return let(logs, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.round((top - x) * 10.0).cast("int"))))


def argmin_genotype(pl: Column) -> Column:
    """Index of the first smallest PL, from 0."""
    return (F.array_position(pl, F.array_min(pl)) - 1).cast("int")


def second_smallest(pl: Column) -> Column:
    return F.get(F.array_sort(pl), F.lit(1))


def from_pl(pl: Column) -> Column:
    """Normalised likelihoods 10^(-(PL - min)/10)."""
    return normalised(let(F.array_min(pl), lambda low: F.transform(pl, lambda x: F.pow(F.lit(10.0), -(x - low) / 10.0))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def normalised(values: Column) -> Column:
    return let(values, lambda v: let(_total(v), lambda total: F.transform(v, lambda x: x / total)))


def hw_prior(freqs: Column) -> Column:
    """f_k^2 and 2 f_k f_j for clamped frequencies; the sum isn't forced to 1."""
    clamped = F.transform(freqs, lambda x: F.least(F.greatest(x, F.lit(PL_FLOOR)), F.lit(1.0 - PL_FLOOR)))
    return let(clamped, lambda f: F.transform(pairs(F.size(f)), lambda g: F.when(g.k == g.j, F.get(f, g.k) * F.get(f, g.k)).otherwise(2.0 * F.get(f, g.k) * F.get(f, g.j))))


def allele_freqs(afs: Column) -> Column:
    """[max(1e-6, 1 - sum), af...] from the alternative alleles' frequencies."""
    return F.concat(F.array(F.greatest(F.lit(PL_FLOOR), F.lit(1.0) - _total(afs))), afs)


def posterior(likelihood: Column, prior: Column) -> Column:
    """Normalised product; the prior where the product vanishes; empty for mismatched sizes."""

    def of(lik: Column, pri: Column) -> Column:
        shares = let(F.zip_with(lik, pri, lambda a, b: a * b), lambda v: let(_total(v), lambda total: F.when(total > 0, F.transform(v, lambda x: x / total)).otherwise(pri)))
        fine = (F.size(lik) == F.size(pri)) & (F.size(lik) > 0)
        return F.when(fine, shares).otherwise(F.array().cast("array<double>"))

    return let(likelihood, lambda lik: let(prior, lambda pri: of(lik, pri)))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dosage(post: Column, n: int | Column) -> Column:
    """Expected number of alternative alleles."""
    weighted = F.zip_with(post, pairs(n), lambda p, g: p * ((g.k > 0).cast("int") + (g.j > 0).cast("int")))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def allele_dosage(post: Column, n: int | Column, allele: Column) -> Column:
    weighted = F.zip_with(post, pairs(n), lambda p, g: p * ((g.k == allele).cast("int") + (g.j == allele).cast("int")))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def quality(p: Column) -> Column:
    """-10 log10(1 - p), at most 1000 and at least 0."""
    return F.when(p >= 1.0, 1000.0).when(p <= 0.0, 0.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.log10(1.0 - p) * -10.0)))


def hwe_chi2(n0: Column, n1: Column, n2: Column) -> Column:
    """Chi-square of soft genotype counts against Hardy-Weinberg; 0 without counts."""
    n = n0 + n1 + n2
    p = (2.0 * n0 + n1) / (2.0 * n)
    q = 1.0 - p
    parts = [(n0, n * p * p), (n1, 2.0 * n * p * q), (n2, n * q * q)]
    total = sum((F.when(e > 1e-10, (o - e) * (o - e) / e).otherwise(0.0) for o, e in parts), F.lit(0.0))
    return F.when(n < 1e-10, 0.0).otherwise(total)
