"""Variant tables: subsets, unions, allele clean-up, matching and evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITE = ["chrom", "pos"]


def unknown(kept: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted samples that the table doesn't have."""
    return kept.select("sample_id").distinct().join(known.select("sample_id"), "sample_id", "left_anti")


def check_names(kept: DataFrame, known: DataFrame) -> None:
    """Every wanted sample must exist."""
    missing = [r[0] for r in unknown(kept, known).limit(5).collect()]
    if missing:
        raise ValueError(f"unknown samples: {missing}")


def subset(calls: DataFrame, samples: list[str]) -> DataFrame:
    return calls.where(F.col("sample_id").isin(samples))


def allele_counts(calls: DataFrame) -> DataFrame:
    """Per site ``an`` and ``ac`` by allele number (a map) over alleles that aren't missing."""
    each = calls.select(*SITE, F.explode(F.filter("gt", lambda a: a >= 0)).alias("allele")).groupBy(*SITE, "allele").agg(F.count("*").alias("n"))
    return each.groupBy(*SITE).agg(F.sum("n").alias("an"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("allele", "n")))).alias("ac"))


def called_counts(calls: DataFrame) -> DataFrame:
    """Samples with a call: diploid ones count as called even if both alleles are the reference."""
    called = F.size(F.filter("gt", lambda a: a >= 0)) > 0
    return calls.groupBy(*SITE).agg(F.count_if(called).alias("called"), F.count("*").alias("samples"))


def prune(sites: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop alternatives that no sample shows, and renumber genotypes.

    A site whose alternatives would all go keeps them.  Missing alleles stay missing.
    """
    counts = allele_counts(calls)
    used = sites.join(counts, SITE, "left").withColumn("used", F.filter(F.sequence(F.lit(1), F.size("alts")), lambda i: F.coalesce(F.try_element_at("ac", i), F.lit(0)) > 0))
    keep = F.when(F.size("used") > 0, F.col("used")).otherwise(F.sequence(F.lit(1), F.size("alts")))
    used = used.withColumn("keep", keep)
    new_sites = used.select(*[c for c in sites.columns if c != "alts"], F.transform("keep", lambda i: F.get("alts", i - 1)).alias("alts"))
    renumbered = F.transform("gt", lambda a: F.when(a <= 0, a).otherwise(F.array_position("keep", a).cast("int")))
    new_calls = calls.join(used.select(*SITE, "keep"), SITE).withColumn("gt", renumbered).drop("keep")
    return new_sites, new_calls


def recount(sites: DataFrame, calls: DataFrame, keep_all: bool = False) -> DataFrame:
    """AC, AN and AF of a subset; sites without a called allele go unless all are kept."""
    c = allele_counts(calls)
    out = sites.join(c, SITE, "left").withColumn("an", F.coalesce("an", F.lit(0)))
    ac = F.transform(F.sequence(F.lit(1), F.size("alts")), lambda i: F.coalesce(F.try_element_at("ac", i), F.lit(0)))
    out = out.withColumn("ac", ac).withColumn("af", F.transform("ac", lambda x: F.when(F.col("an") > 0, x / F.col("an")).otherwise(0.0)))
    return out if keep_all else out.where("an > 0")


def unphased(gt: Column) -> Column:
    """``0/1`` text of a genotype, missing alleles as dots."""
    return F.array_join(F.transform(gt, lambda a: F.when(a < 0, F.lit(".")).otherwise(a.cast("string"))), "/")


def trim(ref: Column, alt: Column, pos: Column) -> list[Column]:
    """Strip the common suffix, then, for equal lengths, the common prefix, one letter staying.

    ``pos, ref, alt`` of a biallelic site; both are found from the letters' first difference.
    """
    # the longest head that both texts begin with, found by matching it again after the line break
    shared = lambda a, b, most: F.greatest(F.lit(0), F.least(F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1)), most))
    most = F.least(F.length(ref), F.length(alt)) - 1
    tail = shared(F.reverse(ref), F.reverse(alt), most)
    r, a = F.substring(ref, F.lit(1), F.length(ref) - tail), F.substring(alt, F.lit(1), F.length(alt) - tail)
    head = F.when(F.length(r) == F.length(a), shared(r, a, F.length(r) - 1)).otherwise(0)
    return [(pos + head).alias("pos"), F.substring(r, head + 1, F.length(r)).alias("ref"), F.substring(a, head + 1, F.length(a)).alias("alt")]


def sort_alleles(alleles: Column) -> Column:
    """Distinct alleles by (length, letters)."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(alleles), lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))), lambda s: s.a)


def normalise(ref: Column, raw: Column) -> Column:
    """Alleles as the caller writes them, from raw ones (letters, ``+inserted``, ``-deleted``):
    ``struct<ref, alts>`` with the longest reference shared by all."""
    longest = F.array_max(F.concat(F.array(F.struct(F.length(ref).alias("n"), ref.alias("s"))), F.transform(F.filter(raw, lambda a: a.startswith("-")), lambda a: F.struct(F.length(a).alias("n"), F.concat(F.left(ref, F.lit(1)), F.substring(a, F.lit(2), F.length(a))).alias("s"))))).s
    beyond = lambda n: F.substring(longest, n + 1, F.length(longest))
    one = lambda a: (
        F.when(a.startswith("-"), F.concat(F.left(ref, F.lit(1)), beyond(F.length(a))))
        .when(a.startswith("+"), F.concat(F.left(ref, F.lit(1)), F.substring(a, F.lit(2), F.length(a)), beyond(F.lit(1))))
        .otherwise(F.concat(a, beyond(F.length(a))))
    )
    return F.struct(longest.alias("ref"), F.filter(sort_alleles(F.transform(raw, one)), lambda a: a != longest).alias("alts"))


def concat(tables: list[DataFrame], check: bool = False) -> DataFrame:
    """All rows, in the first table's columns; ``check`` demands equal columns in equal order."""
    first, *rest = tables
    for t in rest:
        if check and t.columns != first.columns:
            raise ValueError(f"headers differ: {first.columns} and {t.columns}")
    out = first
    for t in rest:
        out = out.unionByName(t.select(*first.columns))
    return out


def duplicates(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")


def annotate(sites: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``info`` with ``;key=value`` appended where the other table has the position."""
    return sites.join(values.select(*SITE, F.col("value")), SITE, "left").withColumn("info", F.when(F.col("value").isNotNull(), F.concat("info", F.lit(f";{key}="), F.col("value").cast("string"))).otherwise(F.col("info"))).drop("value")


def match_truth(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """The call for each true variant (``variant_id, chrom, pos, ref, alt``).

    Letters match at their position; others within their length plus one, the nearest first and
    before after; alleles must be equal, or for indels change the length alike.
    """
    reach = F.when((F.length("ref") == 1) & (F.length("alt") == 1), 0).otherwise(F.greatest(F.length("ref"), F.length("alt")) + 1)
    near = truth.withColumn("reach", reach).withColumn("at", F.explode(F.sequence(F.col("pos") - F.col("reach"), F.col("pos") + F.col("reach"))))
    c = calls.select("chrom", F.col("pos").alias("at"), F.col("ref").alias("c_ref"), F.col("alt").alias("c_alt"))
    same = (F.col("c_ref") == F.col("ref")) & (F.col("c_alt") == F.col("alt"))
    alike = (F.col("reach") > 0) & (F.length("c_ref") - F.length("c_alt") == F.length("ref") - F.length("alt"))
    met = near.join(c, ["chrom", "at"]).where(same | alike).withColumn("offset", F.col("at") - F.col("pos"))
    w = Window.partitionBy("variant_id").orderBy(F.abs("offset"), "offset", "c_ref", "c_alt")
    return met.withColumn("k", F.row_number().over(w)).where("k = 1").select("variant_id", "chrom", "pos", "at", "offset")


def detection(n_true: int, n_called: int, n_matched: int) -> dict[str, float]:
    fn, fp = n_true - n_matched, n_called - n_matched
    recall = n_matched / n_true if n_true else 0.0
    precision = n_matched / n_called if n_called else 0.0
    return {"tp": n_matched, "fp": fp, "fn": fn, "sensitivity": recall, "precision": precision, "f1": 2 * recall * precision / (recall + precision) if recall + precision else 0.0}


def detected(truth: DataFrame, calls: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: true variants found and missed, calls beyond them, and the shares of ``detection``."""
    n = truth.agg(F.count("*").alias("t")).crossJoin(calls.agg(F.count("*").alias("c"))).crossJoin(matched.agg(F.count("*").alias("tp")))  # single rows
    n = n.select("tp", (F.col("c") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"sensitivity": share(tp, tp + fn), "precision": share(tp, tp + fp), "f1": share(2.0 * tp, 2 * tp + fp + fn)})


def concordance(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Per sample: compared genotypes and equal ones; phase doesn't matter, missing calls are left out."""
    both = truth.select(*SITE, "sample_id", F.array_sort("gt").alias("t")).join(calls.select(*SITE, "sample_id", F.array_sort("gt").alias("c")), [*SITE, "sample_id"])
    fine = ~F.exists("t", lambda a: a < 0) & ~F.exists("c", lambda a: a < 0)
    return both.where(fine).groupBy("sample_id").agg(F.count("*").alias("compared"), F.count_if(F.col("t") == F.col("c")).alias("equal")).withColumn("rate", F.col("equal") / F.col("compared"))


def af_errors(pairs: DataFrame) -> DataFrame:
    """MAE, RMSE, largest error and correlation of ``truth`` and ``af``."""
    d = F.col("af") - F.col("truth")
    return pairs.agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_error"), F.corr("truth", "af").alias("r"))


def trend(table: DataFrame) -> DataFrame:
    """Cochran-Armitage trend over groups scored 0, 1, 2, ...: ``id, score, hits, n`` to ``chi2``."""
    s = table.groupBy("id").agg(F.sum("n").cast("double").alias("n"), F.sum("hits").cast("double").alias("r"), F.sum(F.col("score") * F.col("hits")).cast("double").alias("sr"), F.sum(F.col("score") * F.col("n")).cast("double").alias("sn"), F.sum(F.col("score") * F.col("score") * F.col("n")).cast("double").alias("ssn"))
    p = F.col("r") / F.col("n")
    num = F.col("sr") - p * F.col("sn")
    var = p * (1.0 - p) * (F.col("ssn") - F.col("sn") * F.col("sn") / F.col("n"))
    return s.select("id", F.when(var > 1e-12, num * num / var).otherwise(0.0).alias("chi2"))


def af_neighbours(sites: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """How many sites lie within ``[low * af, high * af]`` of each, itself included.

    Counts of whole frequency classes in bins of log(af) stand in for pairs of rows: a class meets
    the classes of its own and the next bins only.
    """
    width = math.log(high / low)
    classes = sites.where("af > 0").groupBy("af").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.log("af") / width))
    other = classes.select(F.col("af").alias("b"), F.col("n").alias("m"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = classes.join(other, "bin").where(F.col("b").between(F.col("af") * low, F.col("af") * high))
    return sites.join(near.groupBy("af").agg(F.sum("m").alias("neighbours")), "af")


def percentile_of(values: DataFrame, value: str) -> DataFrame:
    """Share of rows whose value is smaller, by counts of equal values in their order."""
    per = values.groupBy(value).agg(F.count("*").alias("n"))
    ranked = per.withColumn("before", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)))
    total = F.sum("n").over(Window.partitionBy())
    return values.join(ranked.select(value, (F.coalesce("before", F.lit(0)) / total).alias("percentile")), value)


def log_histogram(df: DataFrame, x: str, y: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts over a square grid of log10 values."""
    at = lambda c: F.floor((F.log10(c) - low) / (high - low) * bins)
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(at(x).alias("bx"), at(y).alias("by")).agg(F.count("*").alias("n")).where(F.col("bx").between(0, bins - 1) & F.col("by").between(0, bins - 1))


def is_pass(filters: Column) -> Column:
    """No filters, or the single PASS."""
    return filters.isNull() | filters.isin("", ".", "PASS")


def allowed(sites: DataFrame, passing: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Sites (``chrom, pos, alt``) of the pass list; with ``targets`` (``chrom, pos, ref, alts``), of
    those only single letters that a target of single letters names as an alternative, in any case."""
    kept = sites.join(passing.select(*SITE), SITE, "left_semi")
    if targets is None:
        return kept
    letters = targets.where((F.length("ref") == 1) & ~F.exists("alts", lambda a: F.length(a) > 1))
    named = letters.select(*SITE, F.explode(F.transform("alts", F.upper)).alias("alt"))
    return kept.join(named, [*SITE, "alt"], "left_semi")


def group_truth(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """Observed ``an`` and ``af`` (one per alternative seen in the group, one at least) of each group
    at each site; missing alleles don't count, and a group of none has 0."""
    own = calls.join(groups.select("sample_id", "group"), "sample_id")
    alleles = F.filter("gt", lambda a: a >= 0)
    each = own.select(*SITE, "group", F.explode_outer(alleles).alias("allele")).groupBy(*SITE, "group", "allele").agg(F.count("allele").alias("n"))
    per = each.groupBy(*SITE, "group").agg(F.sum("n").alias("an"), F.max("allele").alias("top"), F.map_from_entries(F.collect_list(F.when(F.col("allele").isNotNull(), F.struct("allele", "n")))).alias("seen"))
    share = lambda i: F.when(F.col("an") > 0, F.coalesce(F.try_element_at("seen", i), F.lit(0)) / F.col("an")).otherwise(0.0)
    return per.select(*SITE, "group", "an", F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("top", F.lit(1)), F.lit(1))), share).alias("af"))


def drawn(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same ones for a seed however the rows are spread: those
    whose keys' digests come first."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), *keys).limit(n)


def summary(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Count, sum, mean, deviation (n - 1), standard error, median, and the first ``order`` of the
    smallest and of the largest value.  Values are counted first, so a group is as large as its
    distinct values; deviation and error are null for a single value."""
    at = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    v, n = F.col(value).cast("double"), F.col("n")
    mean = F.sum(v * n) / F.sum("n")
    per = at.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(v * n).alias("sum"), mean.alias("mean"), F.percentile(value, 0.5, n).alias("median"), F.min_by("o", value).alias("first_min"), F.max_by("o", value).alias("first_max"))
    squares = at.join(per.select(*by, "mean"), by).groupBy(*by).agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("ss"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1)))
    return per.join(squares, by).withColumn("sd", sd).withColumn("se", F.col("sd") / F.sqrt("n")).drop("ss")


@F.pandas_udf(T.DoubleType())
def fisher_2x3(a: pd.Series, b: pd.Series, c: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """Exact p of 2 x 3 tables (first row ``a, b, c``): all tables at most as likely as the observed
    one (up to 1e-7); 1 for an empty table."""
    return pd.Series([table_2x3(*(int(v) for v in t)) for t in zip(a, b, c, x, y, z)], dtype=float)


def table_2x3(a: int, b: int, c: int, x: int, y: int, z: int) -> float:
    if min(a, b, c, x, y, z) < 0:
        raise ValueError("a table holds a negative count")
    first, columns = a + b + c, (a + x, b + y, c + z)
    if not sum(columns):
        return 1.0
    choose = [np.array([math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) for k in range(m + 1)]) for m in columns]
    i, j = np.meshgrid(np.arange(columns[0] + 1), np.arange(columns[1] + 1), indexing="ij")
    k = first - i - j
    i, j, k = (v[(k >= 0) & (k <= columns[2])] for v in (i, j, k))
    n = sum(columns)
    p = np.exp(choose[0][i] + choose[1][j] + choose[2][k] - (math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1)))
    seen = p[(i == a) & (j == b)][0]
    return float(min(1.0, p[p <= seen * (1 + 1e-7)].sum()))
