"""The model's numbers: expectations of published formulas, and a plain version of the calling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import genotypes as G
from loomgrid.functions import phred, sequence
from loomgrid.operators import caller, fetal, fragments, intervals, pileup, simulate, variants


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*x, kind="double"):
    return F.array(*[F.lit(v).cast(kind) for v in x])


def test_tails():
    assert math.isnan(phred.chi2_tail(-0.1, 1)) and phred.chi2_tail(0, 3) == 1.0
    for x in (0.5, 3.84, 10.0, 50.0):
        assert phred.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert phred.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert phred.chi2_tail(x, 3) == pytest.approx(math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), rel=1e-10)
    assert phred.normal_tail(0.0) == 0.5


def test_tail_series(spark):
    for x in (0.0, 0.3, 2.0, 11.0, 45.0, 59.0, 61.0, 500.0, 5000.0):
        assert one(spark, p=phred.chi2_tail_series(F.lit(x))).p == pytest.approx(phred.chi2_tail(x, 1), abs=1e-8)


def test_fisher():
    a, b, c, d = (np.array(x) for x in zip((8, 4, 4, 9), (10, 5, 4, 9), (3, 4, 4, 5), (1, 1, 1, 1)))
    assert phred.fisher_two_sided(a, b, c, d)[3] == pytest.approx(1.0)
    assert phred.fisher_two_sided(np.array([3]), np.array([0]), np.array([0]), np.array([3]))[0] == pytest.approx(0.1)
    less, greater = (phred.fisher_two_sided(a, b, c, d, s) for s in ("less", "greater"))
    assert ((less + greater) >= 1.0).all()
    with pytest.raises(ValueError):
        phred.fisher_two_sided(np.array([-1]), b[:1], c[:1], d[:1])


def test_priors_and_posteriors(spark):
    got = one(spark, h=G.hw_prior(arr(0.7, 0.2, 0.1)))
    assert got.h == pytest.approx([0.49, 0.28, 0.04, 0.14, 0.04, 0.01])

    def post(pl, af):
        f = arr(1 - af, af)
        p = G.posterior(G.from_pl(arr(*pl, kind="int")), G.hw_prior(f))
        return one(spark, p=p, g=G.argmax(p), d=G.dosage(p, 2))

    assert post((100, 0, 100), 0.5).g == 1
    assert post((3, 0, 5), 0.001).g == 0
    flat = post((0, 0, 0), 0.3)
    assert flat.p == pytest.approx([0.49, 0.42, 0.09]) and flat.d == pytest.approx(0.6)
    assert one(spark, p=G.posterior(arr(1.0), arr(0.5, 0.5))).p == []


def test_genotype_likelihoods_of_any_alleles(spark):
    reads = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(30).alias("bq")) for b in "AAACCN"])
    got = one(spark, pl=G.phred(G.likelihoods(reads, arr("A", "C", "G", kind="string"))))
    assert len(got.pl) == 6 and got.pl[1] == 0 and min(got.pl[3:]) > 30
    assert one(spark, n=G.pairs(3)).n == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def test_equilibrium(spark):
    chi = lambda *n: one(spark, c=G.hwe_chi2(*(F.lit(float(x)) for x in n))).c
    assert phred.chi2_tail(chi(25, 50, 25), 1) > 0.5
    assert phred.chi2_tail(chi(100, 0, 100), 1) < 1e-10
    assert chi(0, 0, 0) == 0.0


def test_sequences(spark):
    got = one(spark, a=sequence.reverse_complement(F.lit("acgtNx")), m=sequence.end_motif(F.lit("ACGTT"), F.lit(True), 4), s=sequence.end_motif(F.lit("ACG"), F.lit(False), 4), c=sequence.strip_chr(F.lit("CHR7")), y=sequence.is_y(F.lit("chrY")), n=sequence.is_autosome(F.lit("chr23")))
    assert (got.a, got.m, got.s, got.c, got.y, got.n) == ("NNACGT", "AACG", "", "7", True, False)
    assert sequence.parse_region(" chr1:5-9 ") == ("chr1", 5, 9) and sequence.parse_region("chr1", {"chr1": 70}) == ("chr1", 1, 70) and sequence.parse_region("") is None
    for bad in ("chr1:9-5", "chr1:x", "chr1:0-5", "chr1:1-99", "chrX", "chr1:5-"):
        with pytest.raises(ValueError):
            sequence.parse_region(bad, {"chr1": 70})


def test_best_subset_is_kept():
    q = np.array([30] * 4)
    hom = caller.Site(["A", "A"], q[:2], np.array([20, 5]))
    got = hom.step_down(0.001, 6)
    assert got["active"] == ("A",) and hom.quality(got, "A") == 0 and hom.quality(got, "C") > 100
    het = caller.Site(["A", "C"], q[:2], np.array([10, 10]))
    got = het.step_down(0.001, 6)
    assert got["active"] == ("A", "C") and got["af"]["C"] == pytest.approx(0.5, abs=0.01) and het.quality(got, "A") > 50
    noise = caller.Site(["A", "C"], q[:2], np.array([200, 1]))
    assert noise.step_down(0.001, 6)["active"] == ("A",)
    assert caller.Site(["N"], q[:1], np.array([3])).step_down(0.001, 6) is None
    assert caller.Site(["A", "C"], q[:2], np.array([5, 5])).step_down(0.001, 1) is None


def test_alleles(spark):
    assert caller.normalise("A", ["-CG", "C", "+TT"]) == ("ACG", ["A", "CCG", "ATTCG"])
    got = one(spark, n=variants.normalise(F.lit("A"), arr("-CG", "C", "+TT", kind="string")))
    assert (got.n.ref, got.n.alts) == ("ACG", ["A", "CCG", "ATTCG"])


def test_calls_of_simulated_reads(spark):
    truth = spark.createDataFrame([("chr1", 100 * i, "A", "C" if i % 2 else "G", 0.1 * (i % 9)) for i in range(1, 40)], "chrom string, pos long, ref string, alt string, af double")
    reads = simulate.draw_pileup(spark, truth, 40, 4).cache()
    sites = {(s.chrom, s.pos): s for s in caller.call_sites(reads, 0.01).collect()}
    shown = {(r.chrom, r.pos): r.af for r in reads.groupBy("chrom", "pos").agg(F.avg((F.col("read_base") != F.col("ref_base")).cast("int")).alias("af")).collect()}
    real = [t for t in truth.collect() if t.af >= 0.1]
    found = [t for t in real if (t.chrom, t.pos) in sites and sites[t.chrom, t.pos].alts[0] == t.alt]
    assert len(found) >= 0.95 * len(real)
    assert np.mean([abs(sites[t.chrom, t.pos].af[0] - shown[t.chrom, t.pos]) for t in found]) < 0.02
    assert not [s for s in sites if s not in {(t.chrom, t.pos) for t in truth.collect() if t.af > 0}]
    changed = simulate.ancient(reads).where("read_base = 'T'").count()
    assert changed > reads.where("read_base = 'T'").count()
    groups = spark.createDataFrame([(f"S{i}", "even" if i % 2 == 0 else "odd") for i in range(40)], "sample_id string, group string")
    g = caller.group_af(reads, caller.call_sites(reads, 0.01), groups).collect()
    assert {x.group for x in g} == {"even", "odd"} and all(len(x.af) >= 1 for x in g)


def test_group_frequencies_of_indels(spark):
    rows = [("chr1", 5, "A", "+TT" if i % 2 else "A", 30, f"S{i}") for i in range(60)] + [("chr1", 9, "A", ("-CG", "C", "A")[i % 3], 30, f"S{i}") for i in range(60)]
    reads = spark.createDataFrame(rows, "chrom string, pos long, ref_base string, read_base string, bq int, sample_id string")
    groups = spark.createDataFrame([(f"S{i}", "low" if i < 30 else "high") for i in range(60)], "sample_id string, group string")
    sites = caller.call_sites(reads, 0.01)
    af = {s.pos: (s.ref, s.alts, s.af) for s in sites.collect()}
    assert af[5][:2] == ("A", ["ATT"]) and af[9][:2] == ("ACG", ["A", "CCG"])
    got = {(x.pos, x.group): x.af for x in caller.group_af(reads, sites, groups, 0.01).collect()}
    assert len(got) == 4
    for (pos, _), x in got.items():
        assert x == pytest.approx(af[pos][2], abs=0.02)


def test_cigars(spark):
    df = spark.createDataFrame([("10H5S3M2I4M1D2M", 100), ("5H0M5H", 7), ("0I0D0P", 3), ("*", 0), ("2P3M", 5)], "cigar string, pos0 long")
    got = [[tuple(b) for b in r.b] for r in df.select(pileup.aligned_blocks(F.col("cigar"), F.col("pos0")).alias("b")).collect()]
    assert got == [[(100, 103), (103, 107), (108, 110)], [], [], [], [(5, 8)]]
    walked = pileup.walk(df.limit(1), []).collect()
    assert [(w.op, w.rpos, w.qpos) for w in walked[:5]] == [("S", 100, 0), ("M", 100, 5), ("M", 101, 6), ("M", 102, 7), ("I", 103, 8)]


def test_elements_and_relocation(spark):
    reads = spark.createDataFrame([("s", "chr1", 0, 60, "3M1I2M2D1M", "ACGTACG", "IIIIIII", "+")], "sample_id string, chrom string, pos0 long, mapq int, cigar string, seq string, qual string, strand string")
    ref = spark.createDataFrame([("chr1", 0, "ACGACTTG")], "chrom string, chunk long, seq string")
    rows = {(r.pos, r.read_base): r for r in pileup.elements(reads, ref).collect()}
    assert rows[4, "+T"].ref_base == "G" and rows[6, "-TT"].ref_base == "C" and rows[8, "G"].ref_base == "G" and rows[6, "-TT"].bq == 40 and rows[8, "G"].rpr == 7
    moved = {(r.pos, r.read_base) for r in pileup.relocate_indels(pileup.elements(reads, ref)).collect()}
    assert (3, "+T") in moved and (3, "G") not in moved and (5, "-TT") in moved and (5, "C") not in moved


def test_deletions_longer_than_a_chunk(spark):
    letters = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(400))
    ref = spark.createDataFrame([("chr1", i, letters[40 * i : 40 * i + 50]) for i in range(10)], "chrom string, chunk long, seq string")
    cases = [(5, 8), (35, 11), (30, 90), (2, 300), (39, 41)]  # where the deletion begins (from 0), and its length
    reads = spark.createDataFrame([(f"s{i}", "chr1", at - 2, 60, f"2M{n}D2M", "ACGT", "IIII", "+") for i, (at, n) in enumerate(cases) for _ in range(2)], "sample_id string, chrom string, pos0 long, mapq int, cigar string, seq string, qual string, strand string")
    got = [(r.sample_id, r.pos, r.read_base, r.ref_base) for r in pileup.elements(reads, ref, 40, 10).where("read_base like '-%'").collect()]
    assert sorted(got) == sorted((f"s{i}", at + 1, "-" + letters[at : at + n], letters[at - 1]) for i, (at, n) in enumerate(cases) for _ in range(2))


def test_intervals(spark):
    iv = spark.createDataFrame([("a", 101, 200), ("a", 151, 301), ("a", 302, 310), ("b", 1, 5)], "chrom string, start long, end long")
    assert sorted(map(tuple, intervals.merge(iv).select("chrom", "start", "end").collect())) == [("a", 101, 301), ("a", 302, 310), ("b", 1, 5)]
    assert [r.end for r in intervals.tiles(spark.createDataFrame([("a", 1, 25)], "chrom string, start long, end long"), 10).orderBy("start").collect()] == [10, 20, 25]
    text = intervals.commands(iv.limit(1), "call", "-f x", "out").first().command
    assert text == "call -f x -r a:101-200 -o out/a.101-200.vcf.gz"
    assert intervals.batches(spark.createDataFrame([(str(i),) for i in range(7)], "sample_id string"), 3).agg(F.max("batch")).first()[0] == 2


def test_mixtures():
    assert fragments.simplex(np.array([0.5, 0.5, 2.0])).tolist() == [0.0, 0.0, 1.0]
    p = fragments.even_profiles()
    w = np.array([0.1, 0.2, 0.3, 0.1, 0.1, 0.2])
    got = fragments.mixture(p, p @ w)
    assert got.sum() == pytest.approx(1.0) and (got >= 0).all()
    assert ((p @ got - p @ w) ** 2).sum() < 1e-9
    assert fragments.mixture(np.zeros((4, 2)), np.ones(4)).tolist() == [0.5, 0.5]


def test_sex_calls(spark):
    c = spark.createDataFrame([(1, 0, 0), (2, 10, 100000), (3, 20, 100000), (4, 0, 10)], "sample_id long, y long, auto long")
    got = {r.sample_id: (r.sex, round(r.fetal_fraction, 6)) for r in fetal.fraction(c, 100.0, 0.0001).collect()}
    assert got == {1: ("UNDETERMINED", -1.0), 2: ("FEMALE", -1.0), 3: ("MALE", 0.01), 4: ("FEMALE", -1.0)}
    assert fetal.fraction(c, 100.0, threshold=0.0).where("sample_id = 4").first().sex == "FEMALE"
    assert fetal.scale_of("none") == fetal.FALLBACK_SCALE
    bed = spark.createDataFrame([("chrY", 10001, 10100), ("chrY", 3000001, 3000100), ("chr1", 1, 1000)], "chrom string, start long, end long")
    assert fetal.scale_of("hg38", bed) == 20.0


def test_metrics():
    assert variants.detection(10, 8, 8) == {"tp": 8, "fp": 0, "fn": 2, "sensitivity": 0.8, "precision": 1.0, "f1": pytest.approx(8 / 9)}
    assert variants.detection(0, 0, 0)["f1"] == 0.0


@pytest.mark.parametrize("listed", [2, 5, 10_000])
def test_every_sample_at_every_site(spark, monkeypatch, listed):
    monkeypatch.setattr(pileup, "LISTED", listed, raising=False)
    sites = spark.createDataFrame([("c", 1), ("c", 2), ("d", 1)], "chrom string, pos long")
    samples = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("d",), ("e",)], "sample_id string")
    reads = spark.createDataFrame([("c", 1, "e"), ("c", 1, "e"), ("d", 1, "a"), ("d", 9, "a")], "chrom string, pos long, sample_id string")
    got = sorted(tuple(x) for x in pileup.densify(sites, samples, reads).collect())
    depth = {("c", 1, "e"): 2, ("d", 1, "a"): 1}
    assert got == [(c, p, s, depth.get((c, p, s), 0)) for c, p in (("c", 1), ("c", 2), ("d", 1)) for s in "abcde"]
    assert pileup.densify(sites, samples.where("false"), reads).count() == 0
