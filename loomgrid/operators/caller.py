"""The per-site model: step-down likelihood-ratio tests over EM fits, one packed row per site."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.phred import chi2_tail

#: The model's constants.
THRESHOLD, EM_ROUNDS, EM_STOP = 24.0, 100, np.float32(0.001)
LN10_10, QUAL_CAP, GLOBAL_CAP, GENES = 0.2302585093, 100000.0, 10000.0, "ACGT"


def fit(lik: np.ndarray, n: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, float]:
    """EM from ``f``; reads alike stand in one row with their number ``n``.

    Stops when the marginals' logarithms change by less than ``EM_STOP`` in all.  The frequencies
    are those after the last step, the likelihood that before it.
    """
    total = n.sum()
    w = lik * f
    m = w.sum(1)
    f = (w / m[:, None] * n[:, None]).sum(0) / total
    log = np.log(m)
    for _ in range(EM_ROUNDS):
        w = lik * f
        m = w.sum(1)
        f = (w / m[:, None] * n[:, None]).sum(0) / total
        new = np.log(m)
        if (np.abs(new - log) * n).sum() < EM_STOP:
            log = new
            break
        log = new
    return f, float((log * n).sum())


class Site:
    """Reads of one site in rows (base, quality, number), and the model fitted to them."""

    def __init__(self, bases: list[str], quals: np.ndarray, n: np.ndarray) -> None:
        use = [i for i, b in enumerate(bases) if b and b[0] not in "Nn"]
        self.total = float(n[use].sum())
        use = [i for i in use if bases[i][0] != "*"]
        self.read = [bases[i] for i in use]
        self.n, q = n[use].astype(float), quals[use].astype(float)
        self.alleles = sorted({*self.read, *GENES}, key=lambda b: (len(b), b))
        e = np.exp(-LN10_10 * q)
        self.lik = np.repeat((e / (len(self.alleles) - 1))[:, None], len(self.alleles), 1)
        for i, b in enumerate(self.read):
            self.lik[i, self.alleles.index(b)] = 1.0 - e[i]
        self.depth = {b: 0.0 for b in self.alleles}
        for b, k in zip(self.read, self.n):
            self.depth[b] += k
        self.error = e

    def _fit(self, subset: tuple[str, ...], start: np.ndarray) -> tuple[np.ndarray, float]:
        if start.sum() <= 0:
            raise ValueError("no reads of any of the alleles")
        return fit(self.lik[:, [self.alleles.index(b) for b in subset]], self.n, start)

    def step_down(self, min_af: float, max_alleles: int, among: list[str] | None = None) -> dict | None:
        """Drop alleles one at a time while the best smaller model isn't rejected; None: no call."""
        active = [b for b in (among or self.alleles) if b in self.depth and self.depth[b] > 0 and self.depth[b] / self.total >= np.float32(min_af)] if self.total else []
        if not active or len(active) > max_alleles:
            return None
        keep = tuple(active)
        freq, full = self._fit(keep, np.array([self.depth[b] / self.total for b in keep]))
        lr, chi = full, 0.0
        known = dict(zip(keep, freq))
        for k in range(len(keep) - 1, 0, -1):
            tried = []
            for sub in combinations(keep, k):
                start = np.array([known[b] for b in sub])
                if start.sum() <= 0:
                    start = np.array([self.depth[b] for b in sub])
                f, log = self._fit(sub, start / start.sum())
                tried.append((2.0 * (lr - log), sub, f, log))
            chi, sub, f, log = min(tried, key=lambda t: round(t[0], 6))  # the first of equals, whatever the order of the sums
            lr = log
            if chi >= THRESHOLD:
                break
            keep, known = sub, dict(zip(sub, f))
        return {"active": keep, "af": known, "chi": chi, "lr": lr, "full": full, "first": active}

    def ref_only(self, ref: str) -> float:
        p = np.array([1.0 - e if b[0] == ref[0] else e / 3.0 for b, e in zip(self.read, self.error)])
        return float((np.log(np.maximum(p, 1e-300)) * self.n).sum())

    def quality(self, got: dict, ref: str) -> int:
        """The larger of the last step's and of the global test's scores, rounded to whole ones."""
        chi = got["chi"]
        if len(got["active"]) == 1 and chi <= 0:
            chi = 2.0 * (got["lr"] - self.ref_only(ref))
        p = chi2_tail(chi, 1)
        p = 1.0 if math.isnan(p) else p
        last = min(QUAL_CAP, -10.0 * math.log10(p)) if p > 0 else QUAL_CAP
        q = chi2_tail(max(0.0, 2.0 * (got["full"] - self.ref_only(ref))), max(1, len(got["active"]) - 1))
        overall = min(GLOBAL_CAP, -10.0 * math.log10(q)) if q > 0 else GLOBAL_CAP
        return max(int(max(last, 0.0) + 0.5), int(max(overall, 0.0) + 0.5))


def normalise(ref: str, alts: list[str]) -> tuple[str, list[str]]:
    """One REF for all alleles: the longest deletion, or the reference letter; insertions and
    letters take what REF has beyond theirs; alleles by (length, letters), each once."""
    long = max([ref, *(ref[:1] + a[1:] for a in alts if a[0] == "-")], key=len)
    out = {_moved(ref, long, a) for a in alts} - {long}
    return long, sorted(out, key=lambda b: (len(b), b))


SCHEMA = "chrom string, pos long, ref string, alts array<string>, qual int, dp long, af array<double>, depth array<long>"


def packed_reads(pileup: DataFrame, by: list[str]) -> DataFrame:
    """One row per group; reads of equal base and quality are counted before the shuffle, so a deep
    site is no larger than its distinct (base, quality) pairs."""
    alike = pileup.groupBy(*by, "ref_base", "read_base", "bq").agg(F.count("*").alias("n"))
    return alike.groupBy(*by, "ref_base").agg(F.array_sort(F.collect_list(F.struct("read_base", "bq", "n"))).alias("reads"))


def call_sites(pileup: DataFrame, min_af: float = 0.001, max_alleles: int = 6) -> DataFrame:
    """Variant sites: ``chrom, pos, ref, alts, qual, dp, af, depth`` (the last two per alternative).

    A site is a variant if more than one allele stays active, or one whose first letter isn't the
    reference's.  Sites with reads of the reference alone can't be, and skip the model.
    """
    packed = packed_reads(pileup.where(~F.upper("read_base").startswith("N")), ["chrom", "pos"])
    packed = packed.where(~F.upper("ref_base").startswith("N") & F.exists("reads", lambda r: r.read_base != F.col("ref_base")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                reads = row["reads"]
                site = Site([r["read_base"] for r in reads], np.array([r["bq"] for r in reads]), np.array([r["n"] for r in reads]))
                got = site.step_down(min_af, max_alleles)
                ref = row["ref_base"]
                if got is None or (len(got["active"]) == 1 and got["active"][0][0] == ref[0]):
                    continue
                raw = [a for a in got["active"] if a != ref]
                long, alts = normalise(ref, raw)
                # a later allele that comes to the same letters takes its place
                of = {_moved(ref, long, a): a for a in raw}
                out.append((row["chrom"], row["pos"], long, alts, site.quality(got, ref), int(sum(site.depth[a] for a in got["active"])), [float(got["af"][of[a]]) for a in alts], [int(site.depth[of[a]]) for a in alts]))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["chrom", "pos", "ref", "alts", "qual", "dp", "af", "depth"])

    return packed.mapInArrow(run, SCHEMA)


def moved(ref: Column, long: Column, base: Column) -> Column:
    """``_moved`` of a read's base: as an allele beside the reference ``long``."""
    beyond = lambda n: F.substring(long, n + 1, F.length(long))
    first = F.left(ref, F.lit(1))
    return (
        F.when(base.startswith("-"), F.concat(first, beyond(F.length(base))))
        .when(base.startswith("+"), F.concat(first, F.substring(base, F.lit(2), F.length(base)), beyond(F.lit(1))))
        .otherwise(F.concat(base, beyond(F.length(base))))
    )


def _moved(ref: str, long: str, allele: str) -> str:
    if allele[0] == "-":
        return ref[:1] + long[len(allele) :]
    if allele[0] == "+":
        return ref[:1] + allele[1:] + long[1:]
    return allele + long[len(allele) :]


def group_af(pileup: DataFrame, sites: DataFrame, groups: DataFrame, min_af: float = 0.001, max_alleles: int = 6) -> DataFrame:
    """The model again for each population at each called site, among the site's alleles:
    ``chrom, pos, group, dp, af`` with one frequency per alternative, 0 where it isn't active.

    Reads are first written as the site's alleles are, so that indels and letters beside them meet
    the alternatives."""
    own = pileup.where(~F.upper("read_base").startswith("N")).join(groups, "sample_id").join(sites.select("chrom", "pos", "ref", "alts"), ["chrom", "pos"])
    own = own.withColumn("read_base", moved(F.col("ref_base"), F.col("ref"), F.col("read_base")))
    packed = packed_reads(own, ["chrom", "pos", "group", "ref", "alts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                reads = row["reads"]
                site = Site([r["read_base"] for r in reads], np.array([r["bq"] for r in reads]), np.array([r["n"] for r in reads]))
                got = site.step_down(min_af, max_alleles, sorted({row["ref"], *row["alts"]}, key=lambda x: (len(x), x)))
                af = got["af"] if got else {}
                out.append((row["chrom"], row["pos"], row["group"], int(site.total), [float(af.get(a, 0.0)) for a in row["alts"]]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64())])], ["chrom", "pos", "group", "dp", "af"])

    return packed.mapInArrow(run, "chrom string, pos long, group string, dp long, af array<double>")
