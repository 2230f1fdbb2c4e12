"""Site records, evaluation and interval windows against plain Python."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import genotypes as G
from loomgrid.functions import phred
from loomgrid.operators import genotype, intervals, records, variants


def plain_union(iv):
    out = []
    for c, s, e in sorted(iv):
        if out and out[-1][0] == c and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [4, 64, 1 << 14])
def test_windows_carry_over_bins(spark, width):
    rng = random.Random(width)
    iv = [(c, s, s + rng.choice([0, 1, 3, 90])) for c in "ab" for s in (rng.randint(-40, 700) for _ in range(60))]
    iv += [("a", 5, 9)] * 300 + [("b", 900, 901)]
    df = spark.createDataFrame(iv, "chrom string, start long, end long")
    assert sorted(map(tuple, intervals.merge(df, width).collect())) == plain_union(iv)
    points = [(i, rng.choice("abc"), rng.randint(-60, 1000)) for i in range(200)] + [(1000 + i, "a", 7) for i in range(300)] + [(2000, None, 7), (2001, "a", None)]
    got = {x.id: (x.start, x.end, x.inside) for x in intervals.last_start(spark.createDataFrame(points, "id long, chrom string, pos long"), df, width=width).collect()}
    assert len(got) == len(points)
    for i, c, p in points:
        before = [(s, e) for k, s, e in iv if k == c and p is not None and s <= p]
        want = max(before) if before else (None, None)
        assert got[i] == (*want, bool(before) and p <= want[1])


def test_windows_of_nothing(spark):
    none = spark.createDataFrame([], "chrom string, start long, end long")
    points = spark.createDataFrame([(1, "a", 5)], "id long, chrom string, pos long")
    assert intervals.merge(none).collect() == []
    assert [tuple(x) for x in intervals.last_start(points, none).collect()] == [(1, "a", 5, None, None, False)]


def plain_pl(reads, alleles, share):
    logs = []
    for j in range(len(alleles)):
        for k in range(j + 1):
            w = share if k == 0 and j > 0 else 0.5
            total = 0.0
            for base, q, n in reads:
                e = 1.0 if q < 0 else 10 ** (-q / 10)
                p = lambda a: 1 - e if a == base else e / 3  # noqa: B023, E731
                total += n * math.log10((1 - w) * p(alleles[k]) + w * p(alleles[j]))
            logs.append(total)
    return [math.floor((max(logs) - x) * 10 + 0.5) for x in logs]


@pytest.mark.parametrize("share", [0.5, 0.35])
def test_records_of_several_alleles(spark, share):
    rng = random.Random(5)
    rows = [("c", pos, f"s{rng.randint(0, 4)}", "A", rng.choice(["A", "A", "C", "G", "+TT", "N"]), rng.choice([10, 20, 37]), rng.choice("+-")) for pos in (1, 2, 3) for _ in range(60)]
    df = spark.createDataFrame(rows, "chrom string, pos long, sample_id string, ref_base string, read_base string, bq int, strand string")
    sites = records.seen_sites(df)
    assert {x.pos: x.alts for x in sites.collect()} == {p: ["C", "G", "+TT"] for p in (1, 2, 3)}
    single, counted = (records.calls(p, sites, share).orderBy("pos", "sample_id").collect() for p in (df, genotype.counted(df)))
    assert single == counted
    for c in single:
        own = [(b, q, 1) for _, p, s, _, b, q, _ in rows if (p, s) == (c.pos, c.sample_id) and b != "N"]
        assert c.pl == plain_pl(own, ["A", *c.alts], share)
        assert c.ad == [sum(b == a for b, _, _ in own) for a in ["A", *c.alts]] and c.dp == len(own)
        pairs = [(k, j) for j in range(4) for k in range(j + 1)]
        assert tuple(c.gt) == pairs[c.pl.index(0)] and c.gq == sorted(c.pl)[1]
    with pytest.raises(ValueError):
        G.likelihoods(F.col("x"), F.col("y"), 1.5)


def test_strands_of_the_deepest_allele(spark):
    rows = [("c", 1, "A", b, s) for b, s in [("C", "+")] * 9 + [("C", "-")] * 4 + [("A", "+")] * 2 + [("G", "-")]]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref_base string, read_base string, strand string")
    got = {x.alt: x for x in records.strands(df, records.seen_sites(df)).collect()}
    assert (got["C"].major, got["C"].af, got["C"].ar, got["G"].af, got["G"].ar) == ("C", 9, 4, 0, 1)
    # the alternative is the deepest: seven reads on each strand stand in for it
    s = 9 * 7 / (4 * 7) + 4 * 7 / (9 * 7)
    assert got["C"].sor == pytest.approx(math.log(s) * (4 / 9 - 7 / 7))
    assert got["G"].fs == pytest.approx(-10 * math.log10(phred.fisher_two_sided(*(__import__("numpy").array([v]) for v in (9, 4, 0, 1)))[0]))


def test_symmetric_odds_by_hand(spark):
    x = spark.range(1).select(phred.sor(*(F.lit(v) for v in (8, 2, 3, 9))).alias("s")).first().s
    assert x == pytest.approx(math.log(8 * 9 / (2 * 3) + 2 * 3 / (8 * 9)) * (2 / 8 - 9 / 3))


def test_tables_of_three_columns():
    a, b, c, x, y, z = 3, 1, 4, 1, 5, 2
    n1, cols = a + b + c, (a + x, b + y, c + z)
    ways = {t: math.prod(math.comb(m, k) for m, k in zip(cols, t)) for t in product(*(range(m + 1) for m in cols)) if sum(t) == n1}
    want = sum(w for w in ways.values() if w <= ways[a, b, c]) / math.comb(sum(cols), n1)
    assert variants.table_2x3(a, b, c, x, y, z) == pytest.approx(want)
    assert variants.table_2x3(0, 0, 0, 0, 0, 0) == 1.0
    with pytest.raises(ValueError):
        variants.table_2x3(-1, 0, 0, 0, 0, 0)


def test_truth_of_groups(spark):
    calls = spark.createDataFrame([("c", 1, "s1", [0, 1]), ("c", 1, "s2", [2, 2]), ("c", 1, "s3", [-1, -1]), ("c", 1, "s4", [0, 0])], "chrom string, pos long, sample_id string, gt array<int>")
    groups = spark.createDataFrame([("s1", "x"), ("s2", "x"), ("s3", "y"), ("s4", "z")], 'sample_id string, `group` string')
    got = {x.group: (x.an, x.af) for x in variants.group_truth(calls, groups).collect()}
    assert got == {"x": (4, [0.25, 0.5]), "y": (0, [0.0]), "z": (2, [0.0])}


def test_drawn_rows_are_the_same_for_a_seed(spark):
    df = spark.range(1000)
    one, two, other = ({x.id for x in variants.drawn(d, 10, ["id"], seed).collect()} for d, seed in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert one == two and len(one) == 10 and one != other


def test_written_as_in_c(spark):
    x = spark.createDataFrame([(1234567.0, "%.6g"), (0.00001234, "%.6g"), (0.5, "%.6g"), (28.5625, "%.3f"), (None, "%.3f")], "v double, p string")
    assert [y.t for y in x.select(records.written("v", "p").alias("t")).collect()] == ["1.23457e+06", "1.234e-05", "0.5", "28.562", None]


def test_caller_writes_records(spark, tmp_path):
    from loomgrid import cli
    from loomgrid.sources import vcf

    rng = random.Random(3)
    rows = []
    for pos, shown in ((5, "AC"), (50, "AACG"), (70, "A"), (90, ["A", "+TT"])):
        rows += [("chr1", pos, "A", rng.choice(shown), rng.choice([25, 30, 35]), 60, f"S{i % 10}", rng.choice("+-"), rng.randint(1, 90), False) for i in range(60)]
    spark.createDataFrame(rows, "chrom string, pos long, ref_base string, read_base string, bq int, mapq int, sample_id string, strand string, rpr long, is_dup boolean").write.parquet(str(tmp_path / "p"))
    (tmp_path / "g.txt").write_text("".join(f"S{i}\t{'EU' if i < 5 else 'AS'}\n" for i in range(10)))
    cli.run(["caller", "-I", str(tmp_path / "p"), "-o", str(tmp_path / "o.vcf"), "-G", str(tmp_path / "g.txt")])
    text = [x.value for x in spark.read.text([str(tmp_path / "o.vcf/header"), str(tmp_path / "o.vcf/body")]).collect()]
    (tmp_path / "one.vcf").write_text("\n".join(sorted(text, key=lambda t: (not t.startswith("##"), not t.startswith("#")))) + "\n")
    sites, names = vcf.read_vcf(spark, str(tmp_path / "one.vcf"))
    assert names == [f"S{i}" for i in range(10)]
    got = {x.pos: x for x in sites.collect()}
    assert {p: (x.ref, x.alts) for p, x in got.items()} == {5: ("A", ["C"]), 50: ("A", ["C", "G"]), 90: ("A", ["ATT"])}
    calls = {(x.pos, x.sample_id): x for x in vcf.calls_of(sites, names).collect()}
    for pos, site in got.items():
        raw = {"ATT": "+TT"}
        alleles = ["A", *[raw.get(a, a) for a in site.alts]]
        own = [r for r in rows if r[1] == pos]
        strands = [sum(r[3] == a and r[7] == s for r in own) for a in alleles for s in "+-"]
        assert site.info["DP4"] == ",".join(map(str, strands)) and site.info["AN"] == "20" and int(site.info["DP"]) == len(own)
        assert len(site.info["AF"].split(",")) == len(site.alts) == len(site.info["AF_EU"].split(",")) and int(site.info["DP_EU"]) + int(site.info["DP_AS"]) == len(own)
        assert ("BaseQRankSum" in site.info) == (len(site.alts) == 1) and 0 <= float(site.info["HWE"]) <= 1
        obs = [0] * len(alleles)
        for i in range(10):
            mine = [r for r in own if r[6] == f"S{i}"]
            pl = plain_pl([(r[3], r[4], 1) for r in mine], alleles, 0.5)
            f = calls[pos, f"S{i}"].fields
            assert f["PL"] == ",".join(map(str, pl)) and f["AD"] == ",".join(str(sum(r[3] == a for r in mine)) for a in alleles)
            for a in [(k, j) for j in range(len(alleles)) for k in range(j + 1)][pl.index(0)]:
                obs[a] += 1
        assert site.info["AC_obs"] == ",".join(map(str, obs[1:])) and site.info["AN_obs"] == "20"
        gts = [a for i in range(10) for a in calls[pos, f"S{i}"].gt]
        assert site.info["AC_GT"] == ",".join(str(gts.count(i + 1)) for i in range(len(site.alts)))


def test_lengths_of_sequences(spark, tmp_path):
    from loomgrid.sources import text

    (tmp_path / "r.fa").write_text(">b\n" + "ACGT" * 3000 + "\n>a\nACG\n")
    chunks = text.read_fasta(spark, str(tmp_path / "r.fa"))
    assert text.lengths(chunks) == {"a": 3, "b": 12000}
    (tmp_path / "r.fa.fai").write_text("b\t12000\t3\t12000\t12001\na\t3\t12007\t3\t4\n")
    assert list(text.lengths(chunks, str(tmp_path / "r.fa.fai"))) == ["b", "a"]
