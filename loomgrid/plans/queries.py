"""Queries over the operators, each with SQL that DuckDB answers from the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import flags, phred, sequence
from loomgrid.functions import genotypes as G
from loomgrid.operators import caller, fetal, fragments, genotype, intervals, pileup, variants
from loomgrid.plans import model
from loomgrid.plans.views import view, view_sql
from loomgrid.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SITE = ["chrom", "pos"]
N_SAMPLES, K = 50, 4


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def reads(spark, d):
    return pileup.kept_reads(view(spark, d, "pileup"))


def r(c, n: int = 6):
    return F.round(c, n)


# ------------------------------------------------------------------ pileups and sites

KEPT = view_sql("pileup") + ", kept as (select * from pileup where not is_dup and mapq >= 5 and bq >= 10)"
DEPTH = KEPT + ", depth as (select chrom, pos, ref_base, read_base, count(*) depth from kept group by all)"
TOTAL = DEPTH + ", total as (select *, cast(sum(depth) over (partition by chrom, pos) as bigint) total from depth)"


@query(f"with {DEPTH} select chrom, pos, ref_base, read_base, depth from depth")
def pileup_base_depth(spark, d):
    return pileup.base_depth(reads(spark, d))


@query(f"with {TOTAL} select chrom, pos, read_base, depth, total, round(depth / cast(total as double), 6) freq from total")
def site_allele_freq(spark, d):
    s = pileup.site_freqs(reads(spark, d))
    return s.select(*SITE, "total", F.inline("bases")).select(*SITE, F.col("base").alias("read_base"), "depth", "total", r("freq").alias("freq"))


@query(f"with {TOTAL} select chrom, pos, read_base major, depth, total from total qualify row_number() over (partition by chrom, pos order by depth desc, read_base) = 1")
def site_major_allele(spark, d):
    return pileup.major_allele(pileup.site_freqs(reads(spark, d)))


@query(f"with {TOTAL} select chrom, pos, string_agg(read_base, ',' order by read_base) active from total where depth / cast(total as double) >= 0.2 group by all")
def active_alleles_min_af(spark, d):
    a = pileup.active_alleles(pileup.site_freqs(reads(spark, d)), 0.2).where(F.size("active") > 0)
    return a.select(*SITE, F.array_join(F.transform("active", lambda b: b.base), ",").alias("active"))


@query(f"with {TOTAL} select chrom, pos, count(*) n_active from total where depth / cast(total as double) >= 0.1 group by all having count(*) <= 1")
def max_alleles_filter(spark, d):
    a = pileup.at_most(pileup.active_alleles(pileup.site_freqs(reads(spark, d)), 0.1), 1)
    return a.select(*SITE, F.size("active").cast("long").alias("n_active"))


def _em_sql(by: str, source: str, rounds: int = 20) -> str:
    lik = ", ".join(f"case when read_base = '{b}' then 1 - e else e / 3 end {b.lower()}" for b in "ACGT")
    start = ", ".join(f"sum(case when read_base = '{b}' then n else 0 end) / cast(sum(n) as double) f{b.lower()}" for b in "ACGT")
    total = " + ".join(f"x.{b} * f{b}" for b in "acgt")
    steps = ", ".join(f"list_sum(list_transform(rs, lambda x: x.n * x.{b} * f{b} / ({total}))) / depth f{b}" for b in "acgt")
    return f""", alike as (select {by}, read_base, bq, count(*) n from {source} group by all),
lik as (select *, {lik} from (select *, exp(bq * -0.2302585093) e from alike)),
packed as (select {by}, sum(n) depth, list(struct_pack(n := n, a := a, c := c, g := g, t := t)) rs, {start} from lik group by all),
em as (select 0 k, * from packed union all select k + 1, {by}, depth, rs, {steps} from em where k < {rounds})"""


@query(f"with recursive {KEPT}{_em_sql('chrom, pos', 'kept')} select chrom, pos, cast(depth as bigint) depth, round(fa, 6) fa, round(fc, 6) fc, round(fg, 6) fg, round(ft, 6) ft from em where k = 20")
def em_allele_freq(spark, d):
    e = pileup.em_freqs(reads(spark, d), SITE)
    return e.select(*SITE, "depth", *[r(F.get("f", F.lit(i))).alias(f"f{b}") for i, b in enumerate("acgt")])


V4 = """, groups as (select sample_id, r_name "group" from (select concat('S', cast(s_suppkey % 50 as varchar)) sample_id, r_name, row_number() over (partition by s_suppkey % 50 order by s_suppkey) k from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) where k = 1)"""


def sample_groups(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    s = t("supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 50).alias("b"))
    first = s.groupBy("b").agg(F.min_by("s_nationkey", "s_suppkey").alias("n_nationkey"))
    named = first.join(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey").join(t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    return named.select(F.concat(F.lit("S"), F.col("b").cast("string")).alias("sample_id"), F.col("r_name").alias("group"))


@query(f"with recursive {KEPT}{V4}, grouped as (select k.*, g.\"group\" from kept k join groups g using (sample_id)){_em_sql('chrom, pos, \"group\"', 'grouped')} select chrom, pos, \"group\", cast(depth as bigint) depth, round(fa, 6) fa, round(fc, 6) fc, round(fg, 6) fg, round(ft, 6) ft from em where k = 20")
def group_dp_af(spark, d):
    e = pileup.em_freqs(reads(spark, d).join(sample_groups(spark, d), "sample_id"), [*SITE, "group"])
    return e.select(*SITE, "group", "depth", *[r(F.get("f", F.lit(i))).alias(f"f{b}") for i, b in enumerate("acgt")])


def _listed(c):
    return F.array_join(F.transform(c, lambda x: F.format_string("%.4f", F.round(x, 4))), ",")


def sites_sql(source: str) -> str:
    """Called sites of the reads in ``source``, as ``called``; sites with reference reads alone are none."""
    return f"""m_off as (select chrom, pos from {source} group by all having count(*) filter (where read_base <> ref_base) > 0),
m_reads as (select s.* from {source} s join m_off using (chrom, pos)), {model.step_down("chrom, pos", "m_reads", 0.05)}, {model.quality()},
called as (select *, replace(keep, ref_base, '') alts, cast(list_sum(list_transform(string_split(keep, ''), lambda l: case l when 'A' then da when 'C' then dc when 'G' then dg else dt end)) as bigint) dp from scored where length(keep) > 1 or keep <> ref_base)"""


SITES = f"select chrom, pos, ref_base \"ref\", array_to_string(string_split(alts, ''), ',') alts, qual, dp, {model.listed('alts', model.FREQ)} af from called"


def _sites(p):
    c = caller.call_sites(p, min_af=0.05)
    return c.select(*SITE, "ref", F.array_join("alts", ",").alias("alts"), "qual", "dp", _listed("af").alias("af"))


def group_af_sql(source: str) -> str:
    """The model of each population among a called site's alleles; alleles that aren't kept have 0."""
    names = [f"{c}_{i}" for c in ("cut", "held", "start", "em", "fit", "pick", "state") for i in range(4)] + ["m_alike", "m_lik", "m_site", "m_active", "m_start"]
    again = model.step_down('chrom, pos, "group"', "g_reads", 0.05, "among_alleles")
    for n in names:
        again = re.sub(rf"\b{n}\b", f"g_{n}", again)
    return f"""{sites_sql(source)}, g_reads as (select k.*, g."group", concat(c.ref_base, c.alts) among_alleles from {source} k join groups g using (sample_id) join called c using (chrom, pos)), {again},
g_all as (select chrom, pos, "group", count(*) dp from g_reads group by all)
select a.chrom, a.pos, a."group", a.dp, {model.listed('c.alts', f"case when s.keep is not null and contains(s.keep, l) then {model.FREQ.replace(' f', ' s.f')} else 0 end")} af from g_all a join called c using (chrom, pos) left join g_state_3 s using (chrom, pos, "group")"""


@query(f"with recursive {KEPT}, {sites_sql('kept')} {SITES}")
def caller_sites(spark, d):
    return _sites(reads(spark, d))


@query(f"with recursive {KEPT}{V4}, {group_af_sql('kept')}")
def caller_group_af(spark, d):
    p = reads(spark, d)
    g = caller.group_af(p, caller.call_sites(p, min_af=0.05), sample_groups(spark, d), min_af=0.05)
    return g.select(*SITE, "group", "dp", _listed("af").alias("af"))


@query(f"""with recursive {KEPT}{_em_sql('chrom, pos', 'kept')},
ll as (select chrom, pos, list_sum(list_transform(rs, lambda x: x.n * ln(x.a * fa + x.c * fc + x.g * fg + x.t * ft))) l, greatest(
  list_sum(list_transform(rs, lambda x: x.n * ln(x.a))), list_sum(list_transform(rs, lambda x: x.n * ln(x.c))), list_sum(list_transform(rs, lambda x: x.n * ln(x.g))), list_sum(list_transform(rs, lambda x: x.n * ln(x.t)))) l1 from em where k = 20)
select chrom, pos, round(l, 4) log_full, round(l1, 4) log_single, round(2 * (l - l1), 4) chi2 from ll""")
def lrt_candidate_loglik(spark, d):
    """Log-likelihoods of the full model and of the best single-allele one."""
    p = reads(spark, d)
    f = pileup.em_freqs(p, SITE)
    e = F.exp(F.col("bq") * -0.2302585093)
    lik = [F.when(F.col("read_base") == b, 1.0 - e).otherwise(e / 3.0) for b in "ACGT"]
    both = p.join(f.select(*SITE, "f"), SITE)
    s = both.groupBy(*SITE).agg(F.sum(F.log(sum((x * F.get("f", F.lit(i)) for i, x in enumerate(lik)), F.lit(0.0)))).alias("l"), *[F.sum(F.log(x)).alias(f"l{i}") for i, x in enumerate(lik)])
    one = F.greatest("l0", "l1", "l2", "l3")
    return s.select(*SITE, r("l", 4).alias("log_full"), r(one, 4).alias("log_single"), r(2.0 * (F.col("l") - one), 4).alias("chi2"))


# ------------------------------------------------------------------ genotypes

BI = DEPTH + """, bi as (select chrom, pos, read_base alt from depth where read_base <> ref_base qualify row_number() over (partition by chrom, pos order by depth desc, read_base) = 1),
own as (select k.*, b.alt from kept k join bi b using (chrom, pos))"""
CALLS = BI + """, ll as (select chrom, pos, sample_id, ref_base, alt, sum(log10(pr)) l0, sum(log10((pr + pa) / 2)) l1, sum(log10(pa)) l2, count(*) filter (where read_base = ref_base) rn, count(*) filter (where read_base = alt) an
  from (select *, case when read_base = ref_base then 1 - e else e / 3 end pr, case when read_base = alt then 1 - e else e / 3 end pa from (select *, pow(10, -bq / 10.0e0) e from own)) group by all),
calls as (select *, cast(round((m - l0) * 10) as int) p0, cast(round((m - l1) * 10) as int) p1, cast(round((m - l2) * 10) as int) p2 from (select *, greatest(l0, l1, l2) m from ll))"""
LIK = CALLS + """, lik as (select *, a0 / (a0 + a1 + a2) q0, a1 / (a0 + a1 + a2) q1, a2 / (a0 + a1 + a2) q2 from (select *, pow(10, -p0 / 10.0e0) a0, pow(10, -p1 / 10.0e0) a1, pow(10, -p2 / 10.0e0) a2 from calls)),
freq as (select chrom, pos, count(*) filter (where read_base = alt) / cast(count(*) as double) f from own where read_base = ref_base or read_base = alt group by all),
prior as (select *, r * r h0, 2 * r * a h1, a * a h2 from (select *, least(greatest(greatest(1e-6, 1 - f), 1e-6), 1 - 1e-6) r, least(greatest(f, 1e-6), 1 - 1e-6) a from freq)),
post as (select *, q0 * h0 / t z0, q1 * h1 / t z1, q2 * h2 / t z2 from (select l.*, h0, h1, h2, f, q0 * h0 + q1 * h1 + q2 * h2 t from lik l join prior using (chrom, pos)))"""


def _calls(spark, d):
    return genotype.calls(genotype.at_sites(reads(spark, d)))


def _post(spark, d):
    return genotype.with_posterior(_calls(spark, d))


@query(f"with {CALLS} select chrom, pos, sample_id, p0, p1, p2, rn ref_depth, an alt_depth from calls")
def genotype_pl(spark, d):
    c = _calls(spark, d)
    return c.select(*SITE, "sample_id", *[F.get("pl", F.lit(i)).alias(f"p{i}") for i in range(3)], F.get("ad", F.lit(0)).alias("ref_depth"), F.get("ad", F.lit(1)).alias("alt_depth"))


@query(f"with {CALLS} select chrom, pos, sample_id, case when p0 = 0 then '0/0' when p1 = 0 then '0/1' else '1/1' end gt, p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2) gq from calls")
def genotype_legacy_gt_gq(spark, d):
    c = _calls(spark, d)
    return c.select(*SITE, "sample_id", variants.unphased(genotype.observed_genotype(F.col("pl"))).alias("gt"), G.second_smallest(F.col("pl")).alias("gq"))


@query(f"with {LIK} select chrom, pos, sample_id, round(q0, 6) q0, round(q1, 6) q1, round(q2, 6) q2 from lik")
def pl_to_likelihood(spark, d):
    c = _calls(spark, d).withColumn("q", G.from_pl(F.col("pl")))
    return c.select(*SITE, "sample_id", *[r(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(3)])


@query(f"with {LIK} select chrom, pos, round(h0, 6) h0, round(h1, 6) h1, round(h2, 6) h2 from prior")
def hw_prior(spark, d):
    a = genotype.at_sites(reads(spark, d)).select(*SITE, "af").distinct().withColumn("h", G.hw_prior(G.allele_freqs(F.col("af"))))
    return a.select(*SITE, *[r(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(3)])


@query(f"with {LIK} select chrom, pos, sample_id, round(z0, 6) z0, round(z1, 6) z1, round(z2, 6) z2, case when z0 >= z1 and z0 >= z2 then '0/0' when z1 >= z2 then '0/1' else '1/1' end gt, round(z1 + 2 * z2, 6) dosage from post")
def genotype_posterior(spark, d):
    c = _post(spark, d)
    return c.select(*SITE, "sample_id", *[r(F.get("posterior", F.lit(i))).alias(f"z{i}") for i in range(3)], variants.unphased(F.col("gt")).alias("gt"), r("dosage").alias("dosage"))


@query(f"""with {LIK}, tot as (select chrom, pos, sum(z1 + 2 * z2) + ({N_SAMPLES} - count(*)) * (any_value(h1) + 2 * any_value(h2)) / (any_value(h0) + any_value(h1) + any_value(h2)) s from post group by all)
select chrom, pos, cast(round(s) as bigint) ac, cast({2 * N_SAMPLES} as bigint) an, round(s / {2 * N_SAMPLES}.0e0, 6) af from tot""")
def dosage_ac_an(spark, d):
    return genotype.dosage_counts(_post(spark, d), N_SAMPLES).withColumn("af", r("af"))


@query(f"with {CALLS} select chrom, pos, cast(sum(case when p0 = 0 then 0 when p1 = 0 then 1 else 2 end) as bigint) ac, 2 * count(*) an, round(sum(case when p0 = 0 then 0 when p1 = 0 then 1 else 2 end) / (2.0e0 * count(*)), 6) af from calls group by all")
def ac_obs_an_obs(spark, d):
    c = _calls(spark, d).withColumn("gt", genotype.observed_genotype(F.col("pl")))
    return genotype.counts(c).withColumn("af", r("af"))


@query(f"with {LIK} select chrom, pos, cast(sum(g) as bigint) ac, 2 * count(*) an, round(sum(g) / (2.0e0 * count(*)), 6) af from (select *, case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end g from post) group by all")
def ac_gt_an_gt(spark, d):
    return genotype.counts(_post(spark, d)).withColumn("af", r("af"))


@query(f"with {BI}, each as (select chrom, pos, sample_id, max(case when read_base = alt then 1 else 0 end) a, max(case when read_base = ref_base then 1 else 0 end) r from own group by all) select chrom, pos, cast(sum(a) as bigint) ac, cast(sum(a + r) as bigint) an from each group by all")
def legacy_ac_an(spark, d):
    p = reads(spark, d)
    return genotype.legacy_counts(p, genotype.biallelic_sites(p))


@query(f"with {KEPT}, s as (select distinct chrom, pos from kept), n as (select distinct sample_id from pileup), c as (select chrom, pos, sample_id, count(*) depth from kept group by all) select chrom, pos, sample_id, coalesce(depth, 0) depth from s cross join n left join c using (chrom, pos, sample_id)")
def zero_depth_densify(spark, d):
    p = reads(spark, d)
    return pileup.densify(p.select(*SITE).distinct(), view(spark, d, "pileup").select("sample_id").distinct(), p)


HWE = LIK + f""", hw as (select chrom, pos, sum(q0) + ({N_SAMPLES} - count(*)) / 3.0e0 n0, sum(q1) + ({N_SAMPLES} - count(*)) / 3.0e0 n1, sum(q2) + ({N_SAMPLES} - count(*)) / 3.0e0 n2 from lik group by all),
chi as (select *, case when n * p * p > 1e-10 then pow(n0 - n * p * p, 2) / (n * p * p) else 0 end + case when 2 * n * p * (1 - p) > 1e-10 then pow(n1 - 2 * n * p * (1 - p), 2) / (2 * n * p * (1 - p)) else 0 end + case when n * (1 - p) * (1 - p) > 1e-10 then pow(n2 - n * (1 - p) * (1 - p), 2) / (n * (1 - p) * (1 - p)) else 0 end chi2
  from (select *, n0 + n1 + n2 n, (2 * n0 + n1) / (2 * (n0 + n1 + n2)) p from hw))"""


@query(f"with {HWE} select chrom, pos, round(n0, 6) n0, round(n1, 6) n1, round(n2, 6) n2, round(chi2, 6) chi2 from chi")
def hwe_chi2(spark, d):
    h = genotype.hwe(_calls(spark, d), N_SAMPLES)
    return h.select(*SITE, *[r(c).alias(c) for c in ("n0", "n1", "n2", "chi2")])


@query(f"""with recursive {HWE}, tail as (select chrom, pos, chi2, 0 k, sqrt(chi2 / 2) t, sqrt(chi2 / 2) s from chi union all select chrom, pos, chi2, k + 1, t * chi2 / (2.0e0 * (k + 1) + 1), s + t * chi2 / (2.0e0 * (k + 1) + 1) from tail where k < 120)
select chrom, pos, round(greatest(0, 1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * s), 6) p from tail where k = 120""")
def hwe_pvalue(spark, d):
    h = genotype.hwe(_calls(spark, d), N_SAMPLES)
    return h.select(*SITE, r(phred.chi2_tail_series(F.col("chi2"))).alias("p"))


STRAND = BI + """, st as (select chrom, pos, count(*) filter (where read_base = ref_base and strand = '+') rf, count(*) filter (where read_base = ref_base and strand = '-') rr, count(*) filter (where read_base = alt and strand = '+') af, count(*) filter (where read_base = alt and strand = '-') ar from own group by all)"""


@query(f"with {STRAND} select chrom, pos, rf, rr, af, ar, concat_ws(',', rf, rr, af, ar) dp4 from st")
def strand_table_dp4(spark, d):
    p = reads(spark, d)
    return genotype.strand_table(p, genotype.biallelic_sites(p)).withColumn("dp4", F.concat_ws(",", "rf", "rr", "af", "ar"))


@query(f"with {STRAND}, c as (select chrom, pos, rf + o rf, rr + o rr, af + o af, ar + o ar from (select *, case when rf = 0 or rr = 0 or af = 0 or ar = 0 then 1.0e0 else 0.0e0 end o from st)) select chrom, pos, round(ln(rf * ar / (rr * af) + rr * af / (rf * ar)) * (rr / rf - ar / af), 6) sor from c")
def strand_sor(spark, d):
    p = reads(spark, d)
    return genotype.strand_table(p, genotype.biallelic_sites(p)).select(*SITE, r(phred.sor(*(F.col(c) for c in ("rf", "rr", "af", "ar")))).alias("sor"))


@query(f"""with {STRAND}, lf as (select n, coalesce(sum(ln(n)) over (order by n rows between unbounded preceding and current row), 0) v from (select unnest(range(1, 2000)) n) union all select 0, 0),
ks as (select *, unnest(range(greatest(0, rf + af - (af + ar)), least(rf + rr, rf + af) + 1)) i from st),
ps as (select k.*, exp(a.v - b.v - c.v + e.v - f.v - g.v - h.v + m.v + o.v) p from ks k join lf a on a.n = rf + rr join lf b on b.n = i join lf c on c.n = rf + rr - i join lf e on e.n = af + ar join lf f on f.n = rf + af - i join lf g on g.n = af + ar - rf - af + i join lf h on h.n = rf + rr + af + ar join lf m on m.n = rf + af join lf o on o.n = rr + ar),
obs as (select chrom, pos, p po from ps where i = rf)
select chrom, pos, round(least(1, sum(case when p <= po * (1 + 1e-7) then p else 0 end)), 6) p from ps join obs using (chrom, pos) group by all""")
def strand_fisher_fs(spark, d):
    p = reads(spark, d)
    t = genotype.strand_table(p, genotype.biallelic_sites(p))
    return t.select(*SITE, r(phred.fisher_udf("rf", "rr", "af", "ar")).alias("p"))


def _rank_sql(v: str) -> str:
    return f"""with {BI}, rk as (select chrom, pos, read_base = ref_base is_ref, rank() over (partition by chrom, pos order by {v} desc) + (count(*) over (partition by chrom, pos, {v}) - 1) / 2.0e0 k from own where read_base = ref_base or read_base = alt),
s as (select chrom, pos, sum(case when is_ref then k else 0 end) r1, cast(count(*) filter (where is_ref) as double) n1, cast(count(*) filter (where not is_ref) as double) n2 from rk group by all)
select chrom, pos, round(case when n1 * n2 * (n1 + n2 + 1) / 12 < 1e-10 then 0 else (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) end, 6) z from s"""


def _rank(spark, d, v):
    p = reads(spark, d)
    return genotype.rank_sum(p, genotype.biallelic_sites(p), v).select(*SITE, r("z").alias("z"))


@query(_rank_sql("bq"))
def ranksum_baseq(spark, d):
    return _rank(spark, d, "bq")


@query(_rank_sql("mapq"))
def ranksum_mapq(spark, d):
    return _rank(spark, d, "mapq")


@query(_rank_sql("rpr"))
def ranksum_readpos(spark, d):
    return _rank(spark, d, "rpr")


# ------------------------------------------------------------------ reads

AL = view_sql("alignments")
_B = {n: f"(flag & {v}) <> 0" for n, v in flags.BITS.items()}
_PRIMARY = f"not ({_B['unmapped']}) and not ({_B['duplicate']} or {_B['qc_fail']} or {_B['secondary']} or {_B['supplementary']})"
_COUNTED = f"{_PRIMARY} and mapq >= 30 and (not ({_B['paired']}) or ({_B['proper_pair']})) and (not ({_B['paired']}) or abs(isize) <= 500)"


@query(f"with {AL} select event_id from alignments where mapq >= 5 and (({_B['unmapped']}) or not ({_B['duplicate']} or {_B['qc_fail']} or {_B['secondary']} or {_B['supplementary']}))")
def read_filter_caller(spark, d):
    return view(spark, d, "alignments").where(flags.caller_reads(F.col("flag"), F.col("mapq"))).select("event_id")


@query(f"with {AL} select event_id from alignments where {_COUNTED} and (not ({_B['paired']}) or ({_B['read1']}))")
def read_filter_motif(spark, d):
    return view(spark, d, "alignments").where(flags.motif_reads(F.col("flag"), F.col("mapq"), F.col("isize"), proper_pair=True, max_insert=500)).select("event_id")


@query(f"with {AL} select event_id from alignments where {_COUNTED}")
def read_filter_fetal(spark, d):
    return view(spark, d, "alignments").where(flags.counted_reads(F.col("flag"), F.col("mapq"), F.col("isize"), proper_pair=True, max_insert=500)).select("event_id")


_M = f"not ({_B['unmapped']})"


@query(f"""with {AL} select event_id, {_B['paired']} is_paired, ({_B['paired']}) and ({_B['proper_pair']}) is_proper_pair, {_M} is_mapped, ({_B['paired']}) and not ({_B['mate_unmapped']}) is_mate_mapped, {_B['reverse']} is_reverse, ({_B['paired']}) and ({_B['mate_reverse']}) is_mate_reverse,
{_B['read1']} is_read1, {_B['read2']} is_read2, {_M} and ({_B['secondary']}) is_secondary, {_M} and ({_B['qc_fail']}) is_qc_fail, {_M} and ({_B['duplicate']}) is_duplicate, {_M} and ({_B['supplementary']}) is_supplementary from alignments""")
def flag_decode(spark, d):
    return view(spark, d, "alignments").select("event_id", *[c.alias(n) for n, c in flags.decoded(F.col("flag")).items()])


_OPS = view_sql("cigar_reads") + """, parts as (select read_id, pos0, cast(regexp_extract(p, '^[0-9]+') as int) n, right(p, 1) op, i from (select read_id, pos0, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]')) p, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]'), 1) i from cigar_reads)),
blocks as (select read_id, op, n, i, cast(pos0 + coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then n else 0 end) over w, 0) as bigint) rpos, cast(coalesce(sum(case when op in ('M', '=', 'X', 'I', 'S', 'P') then n else 0 end) over w, 0) as bigint) qpos
  from parts window w as (partition by read_id order by i rows between unbounded preceding and 1 preceding)),
walked as (select read_id, op, rpos + j rpos, qpos + j qpos, 1 len from (select *, unnest(range(n)) j from blocks where op in ('M', '=', 'X')) union all select read_id, op, rpos, qpos, n len from blocks where op not in ('M', '=', 'X', 'H'))"""


@query(f"with {_OPS} select read_id, op, cast(rpos as bigint) rpos, cast(qpos as bigint) qpos, len from walked")
def cigar_walk(spark, d):
    return pileup.walk(view(spark, d, "cigar_reads"), ["read_id"]).select("read_id", "op", "rpos", "qpos", "len")


@query(f"with {_OPS} select read_id, rpos \"start\", rpos + n \"end\" from blocks where op in ('M', '=', 'X')")
def cigar_blocks(spark, d):
    return view(spark, d, "cigar_reads").select("read_id", F.inline(pileup.aligned_blocks(F.col("cigar"), F.col("pos0"))))


@query(f"""with {_OPS}, els as (select w.read_id, c.sample_id, case when op = 'I' then '+' when op = 'D' then '-' else 'A' end read_base, w.rpos + 1 - case when op in ('I', 'D') then 1 else 0 end pos, qpos, op in ('I', 'D') is_indel from walked w join cigar_reads c using (read_id) where op in ('M', '=', 'X', 'I', 'D'))
select sample_id, cast(pos as bigint) pos, read_base, read_id, cast(qpos as bigint) qpos from els qualify is_indel or not max(is_indel) over (partition by sample_id, pos)""")
def indel_relocate(spark, d):
    w = pileup.walk(view(spark, d, "cigar_reads"), ["read_id", "sample_id"]).where(F.col("op").isin("M", "=", "X", "I", "D"))
    rows = w.select("sample_id", F.lit("chr1").alias("chrom"), (F.col("rpos") + 1).alias("pos"), F.when(F.col("op") == "I", "+").when(F.col("op") == "D", "-").otherwise("A").alias("read_base"), "read_id", "qpos")
    return pileup.relocate_indels(rows).select("sample_id", "pos", "read_base", "read_id", "qpos")


# ------------------------------------------------------------------ fragment ends

_FR = view_sql("fragments") + f""", motifs as (select doc_id, sample_id, mapq, seq, case when length(seq) < {K} then '' when is_rev then reverse(translate(right(seq, {K}), 'ACGTN', 'TGCAN')) else substr(seq, 1, {K}) end motif from fragments),
pure as (select * from motifs where regexp_full_match(motif, '[ACGT]+'))"""
_DENSE = _FR + f""", ks as (select concat(a, b, c, e) motif from (select unnest(['A','C','G','T']) a) cross join (select unnest(['A','C','G','T']) b) cross join (select unnest(['A','C','G','T']) c) cross join (select unnest(['A','C','G','T']) e)),
cnt as (select sample_id, motif, count(*) n from pure group by all), dense as (select s.sample_id, k.motif, coalesce(n, 0) "count" from (select distinct sample_id from motifs) s cross join ks k left join cnt using (sample_id, motif))"""


def _motifs(spark, d):
    return view(spark, d, "fragments").withColumn("motif", sequence.end_motif(F.col("seq"), F.col("is_rev"), K))


@query(f"with {_FR} select doc_id, motif from motifs")
def kmer_from_read(spark, d):
    return _motifs(spark, d).select("doc_id", "motif")


@query(f"with {_DENSE} select sample_id, motif, \"count\" from dense")
def motif_counts_dense(spark, d):
    return fragments.motif_counts(_motifs(spark, d).select("sample_id", "motif"), K)


@query(f"with {_DENSE} select sample_id, motif, \"count\", round(case when sum(\"count\") over (partition by sample_id) > 0 then \"count\" / cast(sum(\"count\") over (partition by sample_id) as double) else 0 end, 6) frequency from dense")
def motif_frequency(spark, d):
    return fragments.frequencies(fragments.motif_counts(_motifs(spark, d).select("sample_id", "motif"), K)).withColumn("frequency", r("frequency"))


@query(f"with {_DENSE}, fr as (select sample_id, \"count\" / cast(sum(\"count\") over (partition by sample_id) as double) p from dense where \"count\" > 0) select sample_id, round(sum(-p * log2(p)) / {2 * K}, 6) mds from fr group by all")
def motif_mds(spark, d):
    return fragments.diversity(fragments.motif_counts(_motifs(spark, d).select("sample_id", "motif"), K, zeros=False), K).withColumn("mds", r("mds"))


@query(f"with {_FR} select sample_id, count(*) total, count(*) filter (where mapq < 30) filtered, count(*) filter (where mapq >= 30 and regexp_full_match(motif, '[ACGT]+')) used, count(*) filter (where mapq >= 30 and not regexp_full_match(motif, '[ACGT]+')) with_n from motifs group by all")
def read_counters(spark, d):
    return fragments.read_counters(_motifs(spark, d).withColumn("kept", F.col("mapq") >= 30), "kept", "motif")


@query(f"""with {view_sql('fragments')}, ev as (select event_id, event_id % (select max(doc_id) + 1 from fragments) doc_id, event_id % 2 = 1 is_rev from events),
placed as (select event_id, ev.is_rev, seq, 1 + (event_id * 7919) % length(seq) pos from ev join fragments using (doc_id) where length(seq) > 0)
select event_id, case when is_rev then reverse(translate(substr(seq, pos, {K}), 'ACGTN', 'TGCAN')) else substr(seq, pos, {K}) end motif from placed""")
def motif_from_reference(spark, d):
    """Motifs out of all documents as references, in chunks by document, each with the letters that follow."""
    chunk = 500
    docs = view(spark, d, "fragments").select("doc_id", "seq", F.length("seq").alias("n")).where("n > 0")
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))
    chunks = docs.select("doc_id", "seq", F.explode(starts).alias("at")).select("doc_id", (F.col("at") / chunk).cast("long").alias("chunk"), F.substring(F.col("seq"), F.col("at") + 1, F.lit(chunk + K)).alias("letters"))
    ids = (view(spark, d, "fragments").agg(F.max("doc_id")).first()[0] or 0) + 1
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % ids).alias("doc_id"), (F.col("event_id") % 2 == 1).alias("is_rev"))
    placed = ev.join(docs.select("doc_id", "n"), "doc_id").withColumn("pos0", F.col("event_id") * 7919 % F.col("n"))
    met = placed.withColumn("chunk", F.floor(F.col("pos0") / chunk)).join(chunks, ["doc_id", "chunk"])
    m = F.substring(F.col("letters"), (F.col("pos0") - F.col("chunk") * chunk + 1).cast("int"), F.lit(K))
    return met.select("event_id", F.when(F.col("is_rev"), sequence.reverse_complement(m)).otherwise(m).alias("motif"))


@query(f"with {AL} select sample_id, count(*) n from (select distinct sample_id, qname, case when {_B['read1']} then 1 when {_B['read2']} then 2 else 0 end m from alignments) group by all")
def motif_region_dedupe(spark, d):
    return fragments.once(view(spark, d, "alignments")).groupBy("sample_id").agg(F.count("*").alias("n"))


def _weights(spark, d):
    listed = [x.motif for x in sequence.all_motifs(spark, K).orderBy("motif").collect()]
    return fragments.decompose(fragments.motif_counts(_motifs(spark, d).select("sample_id", "motif"), K, zeros=False), fragments.even_profiles(), listed)


_J = range(1, 7)
_MIX = f"""{_DENSE}, fr as (select sample_id, row_number() over (partition by sample_id order by motif) i, "count" / cast(sum("count") over (partition by sample_id) as double) f from dense qualify sum("count") over (partition by sample_id) > 0),
raw as (select i, {", ".join(f"1 + 3 * pow(cos(i * {j} * 0.37e0), 2) r{j}" for j in _J)} from (select unnest(range(1, {4**K + 1})) i)),
pr as (select i, {", ".join(f"r{j} / sum(r{j}) over () p{j}" for j in _J)} from raw),
gram as (select [{", ".join("[" + ", ".join(f"sum(p{a} * p{b})" for b in _J) + "]" for a in _J)}] g, {" + ".join(f"sum(p{j} * p{j})" for j in _J)} tr from pr),
aim as (select sample_id, [{", ".join(f"sum(p{j} * f)" for j in _J)}] c, sum(f * f) ff from fr join pr using (i) group by all),
mix as (select sample_id, 0 k, list_transform(range(6), lambda i: 1 / 6.0e0) w, false done from aim
  union all select sample_id, k + 1, nw, sqrt(list_sum(list_transform(list_zip(nw, w), lambda z: pow(z[1] - z[2], 2)))) < 1e-12
  from (select *, list_transform(v, lambda x: greatest(x - (list_sum(u[1:rho]) - 1) / rho, 0)) nw
    from (select *, list_max(list_filter(range(1, 7), lambda i: u[i] - (list_sum(u[1:i]) - 1) / i > 0)) rho
      from (select *, list_reverse_sort(v) u
        from (select m.*, list_transform(range(1, 7), lambda i: w[i] - (list_sum(list_transform(range(1, 7), lambda j: g[i][j] * w[j])) - c[i]) / tr) v from mix m join aim using (sample_id) cross join gram where not done and k < 10000)))) ),
best as (select m.sample_id, w, ff - 2 * list_sum(list_transform(range(1, 7), lambda i: w[i] * c[i])) + list_sum(list_transform(range(1, 7), lambda i: w[i] * list_sum(list_transform(range(1, 7), lambda j: g[i][j] * w[j])))) residual
  from mix m join aim using (sample_id) cross join gram where done or k = 10000)"""


@query(f"with recursive {_MIX} select sample_id, {', '.join(f'round(w[{j}], 6) p{j}' for j in _J)} from best")
def fprofile_weights(spark, d):
    w = _weights(spark, d)
    return w.select("sample_id", *[r(F.get("weights", F.lit(i))).alias(f"p{i + 1}") for i in range(6)])


@query(f"with recursive {_MIX} select sample_id, round(residual, 8) residual from best")
def fprofile_residual(spark, d):
    return _weights(spark, d).select("sample_id", r("residual", 8).alias("residual"))


# ------------------------------------------------------------------ fetal fraction

_PAR = " or ".join(f"pos between {a} and {b}" for a, b in fetal.PAR["hg38"])
_FC = AL + f""", fc as (select sample_id, count(*) total, count(*) filter (where k and chrom = 'chrY' and not ({_PAR})) y, count(*) filter (where k and chrom = 'chrY' and ({_PAR})) par, count(*) filter (where k and auto) auto, count(*) filter (where not k or (chrom <> 'chrY' and not auto)) filtered
from (select *, {_PRIMARY} and mapq >= 30 k, regexp_full_match(chrom, 'chr[0-9]+') auto from alignments) group by all),
ff as (select *, case when auto > 0 then y / cast(auto as double) else 0 end y_ratio from fc)"""
_SCALE = 2.0 * fetal.LENGTHS["hg38"][0] / fetal.LENGTHS["hg38"][1]


def _fetal(spark, d):
    return fetal.counters(view(spark, d, "alignments"), flags.counted_reads(F.col("flag"), F.col("mapq"), F.col("isize")))


@query(f"with {_FC} select * from fc")
def fetal_counts(spark, d):
    return _fetal(spark, d)


@query(f"with {_FC} select sample_id, round(y_ratio, 8) y_ratio, case when auto = 0 then 'UNDETERMINED' when y_ratio > 0.0001 then 'MALE' else 'FEMALE' end sex, round(case when auto > 0 and y_ratio > 0.0001 then greatest(0, y_ratio - 0.001) * {_SCALE!r} else -1 end, 6) fetal_fraction from ff")
def fetal_fraction(spark, d):
    f = fetal.fraction(_fetal(spark, d), fetal.scale_of("hg38"), noise=0.001)
    return f.select("sample_id", r("y_ratio", 8).alias("y_ratio"), "sex", r("fetal_fraction").alias("fetal_fraction"))


@query(f"with {_FC}, m as (select count(*) n, avg(y_ratio) a, avg(greatest(0, y_ratio - 0.001)) m, stddev_pop(greatest(0, y_ratio - 0.001)) s from ff) select n, round(a, 8) mean_raw, round(m, 8) mean, round(s, 8) sd, round(s / m * 100, 6) cv_percent, round(1 / m, 6) scale from m")
def fetal_calibrate(spark, d):
    c = fetal.calibrate(fetal.fraction(_fetal(spark, d), 1.0), 0.001)
    return c.select("n", *[r(x, 8).alias(x) for x in ("mean_raw", "mean", "sd")], r("cv_percent").alias("cv_percent"), r("scale").alias("scale"))


@query("select build, round(2.0e0 * a / y, 8) scale from (values ('hg38', 2875001522, 54126423), ('hg19', 2881033286, 56404529)) t(build, a, y)")
def geometric_scale(spark, d):
    return spark.createDataFrame([(b, fetal.scale_of(b)) for b in fetal.LENGTHS], "build string, scale double").select("build", r("scale", 8).alias("scale"))


# ------------------------------------------------------------------ intervals

_IV = """iv as (select concat('chr', cast(user_id % 5 + 1 as varchar)) chrom, 1 + (event_id * 7919) % 900000 "start", 1 + (event_id * 7919) % 900000 + event_id % 400 "end" from events),
pt as (select event_id, concat('chr', cast(event_id % 6 + 1 as varchar)) chrom, 1 + (event_id * 104729) % 900000 pos from events)"""
_MERGED = _IV + """, mk as (select *, case when "start" <= max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end f from iv),
isl as (select *, sum(f) over (partition by chrom order by "start", "end" rows unbounded preceding) i from mk), merged as (select chrom, min("start") "start", max("end") "end" from isl group by chrom, i)"""


def _iv(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    iv = e.selectExpr("concat('chr', cast(user_id % 5 + 1 as string)) chrom", "1 + (event_id * 7919) % 900000 start", "1 + (event_id * 7919) % 900000 + event_id % 400 end")
    return iv, e.selectExpr("event_id", "concat('chr', cast(event_id % 6 + 1 as string)) chrom", "1 + (event_id * 104729) % 900000 pos")


@query(f'with {_MERGED} select chrom, "start", "end" from merged')
def interval_merge(spark, d):
    return intervals.merge(_iv(spark, d)[0])


@query(f'with {_MERGED} select chrom, cast(sum("end" - "start" + 1) as bigint) bases from merged group by all')
def interval_total_length(spark, d):
    return intervals.total_length(intervals.merge(_iv(spark, d)[0]))


@query(f"""with {_MERGED}, w as (select distinct chrom, 1 + 50000 * k "start", 50000 * k + 20000 "end" from iv cross join (select unnest(range(18)) k))
select m.chrom, cast(sum(least(m."end", w."end") - greatest(m."start", w."start") + 1) as bigint) bases from merged m join w on m.chrom = w.chrom and greatest(m."start", w."start") <= least(m."end", w."end") group by all""")
def interval_overlap_length(spark, d):
    iv = _iv(spark, d)[0]
    w = iv.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("k")).selectExpr("chrom", "1L + 50000 * k start", "50000L * k + 20000 end")
    return intervals.overlap_lengths(intervals.merge(iv), w, 1 << 14)


@query(f'with {_MERGED} select event_id, p.chrom, pos from pt p where exists (select 1 from merged m where m.chrom = p.chrom and pos between m."start" and m."end")')
def interval_semi(spark, d):
    iv, pt = _iv(spark, d)
    return intervals.points_in(pt, intervals.merge(iv), "left_semi", width=1 << 14).select("event_id", "chrom", "pos")


@query(f'with {_MERGED} select event_id, p.chrom, pos from pt p where not exists (select 1 from merged m where m.chrom = p.chrom and pos between m."start" and m."end")')
def interval_anti(spark, d):
    iv, pt = _iv(spark, d)
    return intervals.points_in(pt, intervals.merge(iv), "left_anti", width=1 << 14).select("event_id", "chrom", "pos")


@query(f'with {_MERGED} select p.event_id, m."start", m."end", coalesce(p.pos <= m."end", false) inside from pt p asof left join merged m on p.chrom = m.chrom and p.pos >= m."start"')
def asof_interval(spark, d):
    iv, pt = _iv(spark, d)
    return intervals.last_start(pt, intervals.merge(iv)).select("event_id", "start", "end", "inside")


# ------------------------------------------------------------------ planning

@query("""with t as (select n_name chrom, cast(unnest(range(1, 1000000 * (n_nationkey + 1) + 1, 300000)) as bigint) "start", cast(1000000 * (n_nationkey + 1) as bigint) stop from nation) select chrom, "start", least("start" + 299999, stop) "end" from t""")
def genome_tiles(spark, d):
    regions = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_name chrom", "1L start", "cast(1000000 * (n_nationkey + 1) as bigint) end")
    return intervals.tiles(regions, 300_000)


@query("""with x as (select p_partkey, concat('chr', cast(p_partkey % 22 + 1 as varchar), case p_partkey % 3 when 0 then '' when 1 then concat(':', cast(p_partkey as varchar)) else concat(':', cast(p_partkey % 500 as varchar), '-', cast(p_partkey % 700 as varchar)) end) region, p_partkey % 3 k from part)
select p_partkey, case when ok then concat('chr', cast(p_partkey % 22 + 1 as varchar)) end chrom, cast(case when ok then case k when 0 then 1 when 1 then p_partkey else p_partkey % 500 end end as bigint) "start", cast(case when ok and k = 2 then p_partkey % 700 end as bigint) "end"
from (select *, case k when 0 then true when 1 then p_partkey >= 1 else p_partkey % 500 >= 1 and p_partkey % 500 <= p_partkey % 700 end ok from x)""")
def region_parse(spark, d):
    text = "concat('chr', cast(p_partkey % 22 + 1 as string), case p_partkey % 3 when 0 then '' when 1 then concat(':', cast(p_partkey as string)) else concat(':', cast(p_partkey % 500 as string), '-', cast(p_partkey % 700 as string)) end) region"
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", text).select("p_partkey", *sequence.region_columns(F.col("region")))


@query("select n_name chrom, cast(n_nationkey * 1000 + 1 as bigint) length from nation where n_nationkey in (1, 7, 16)")
def fai_filter(spark, d):
    """The lines of an index of the nations, read by the reader's own parser and cut to three names."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    names = [x.n_name for x in nation.where("n_nationkey in (1, 7, 16)").select("n_name").collect()]
    lines = nation.selectExpr("concat_ws('\t', n_name, n_nationkey * 1000 + 1, 6, 60, 61) value")
    return text.parse_fai(lines, names)


# ------------------------------------------------------------------ variant tables

V6 = """g as (select l_partkey % 22 chrom, l_partkey pos, l_suppkey % 50 sample_id, case when count(*) filter (where l_returnflag <> 'R') = 0 then -1 else min(l_orderkey % 3) end a0, case when count(*) filter (where l_returnflag <> 'R') = 0 then -1 else max(l_linenumber % 3) end b0 from lineitem group by all),
calls as (select chrom, pos, sample_id, least(a0, b0) a, greatest(a0, b0) b from g),
sub as (select * from calls where sample_id in (1, 2, 3, 5, 8, 13)),
al as (select chrom, pos, a x from sub where a >= 0 union all select chrom, pos, b x from sub where b >= 0),
cnt as (select chrom, pos, count(*) an, count(*) filter (where x = 1) c1, count(*) filter (where x = 2) c2 from al group by all)"""


def calls_view(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey % 22 chrom", "l_partkey pos", "l_suppkey % 50 sample_id", "l_orderkey % 3 a", "l_linenumber % 3 b", "l_returnflag <> 'R' used")
    g = t.groupBy(*SITE, "sample_id").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count_if("used").alias("n"))
    a, b = (F.when(F.col("n") == 0, -1).otherwise(F.col(c)).cast("int") for c in "ab")
    return g.select(*SITE, "sample_id", F.array(F.least(a, b), F.greatest(a, b)).alias("gt"))


def _sub(spark, d):
    return variants.subset(calls_view(spark, d), [1, 2, 3, 5, 8, 13])


def _alts(calls):
    return calls.select(*SITE).distinct().withColumn("alts", F.array(F.lit("C"), F.lit("G")))


@query(f"with {V6} select chrom, pos, sample_id, replace(concat(cast(a as varchar), '/', cast(b as varchar)), '-1', '.') gt from sub")
def subset_samples(spark, d):
    return _sub(spark, d).select(*SITE, "sample_id", variants.unphased(F.col("gt")).alias("gt"))


@query(f"""with {V6} select s.chrom, s.pos, sample_id, case when c1 > 0 and c2 > 0 or c1 is null or c1 + c2 = 0 then 'C,G' when c1 > 0 then 'C' else 'G' end alts,
replace(concat(cast(case when c1 = 0 and a = 2 then 1 else a end as varchar), '/', cast(case when c1 = 0 and b = 2 then 1 else b end as varchar)), '-1', '.') gt from sub s left join cnt using (chrom, pos)""")
def subset_prune_alleles(spark, d):
    calls = _sub(spark, d)
    sites, renumbered = variants.prune(_alts(calls), calls)
    return renumbered.join(sites, SITE).select(*SITE, "sample_id", F.array_join("alts", ",").alias("alts"), variants.unphased(F.col("gt")).alias("gt"))


@query(f"with {V6} select chrom, pos, an, c1 ac1, c2 ac2, round(c1 / cast(an as double), 6) af1, round(c2 / cast(an as double), 6) af2 from cnt where an > 0")
def subset_ac_an_af(spark, d):
    calls = _sub(spark, d)
    c = variants.recount(_alts(calls), calls)
    at = lambda n, i: F.get(n, F.lit(i))
    return c.select(*SITE, "an", at("ac", 0).alias("ac1"), at("ac", 1).alias("ac2"), r(at("af", 0)).alias("af1"), r(at("af", 1)).alias("af2"))


_TRIM = """x as (select p_partkey pos, concat(p, 'A', s) ref, concat(p, q, s) alt, length(p) np, q from (select p_partkey, repeat('G', cast(p_partkey % 4 as int)) p, repeat('T', cast(p_partkey % 3 as int)) s, case when p_partkey % 5 = 0 then 'AC' else 'C' end q from part))"""


@query(f"with {_TRIM} select x.pos id, cast(case when q = 'C' then x.pos + np else x.pos end as bigint) pos, case when q = 'C' then 'A' else concat(repeat('G', np), 'A') end ref, case when q = 'C' then 'C' else concat(repeat('G', np), 'AC') end alt from x")
def allele_trim(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "repeat('G', cast(p_partkey % 4 as int)) p", "repeat('T', cast(p_partkey % 3 as int)) s", "case when p_partkey % 5 = 0 then 'AC' else 'C' end q")
    x = x.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.concat("p", F.lit("A"), "s").alias("ref"), F.concat("p", "q", "s").alias("alt"))
    return x.select("id", *variants.trim(F.col("ref"), F.col("alt"), F.col("pos")))


@query("""select p_partkey id, case p_partkey % 3 when 0 then 'ACG' else 'A' end ref, case p_partkey % 3 when 0 then 'A,CCG,ATTCG' when 1 then 'C,ATT' else 'C' end alts from part""")
def allele_normalise(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("-CG"), F.lit("C"), F.lit("+TT"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("+TT"), F.lit("C"))).otherwise(F.array(F.lit("C"), F.lit("C")))
    n = variants.normalise(F.lit("A"), F.col("raw"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", raw.alias("raw")).withColumn("n", n).select(F.col("p_partkey").alias("id"), F.col("n.ref").alias("ref"), F.array_join("n.alts", ",").alias("alts"))


@query(f"with {DEPTH} select chrom, string_agg(distinct_base, ',' order by length(distinct_base), distinct_base) alleles from (select distinct chrom, repeat(read_base, cast(depth % 3 + 1 as int)) distinct_base from depth) group by all")
def allele_sort(spark, d):
    x = pileup.base_depth(reads(spark, d)).select("chrom", F.expr("repeat(read_base, cast(depth % 3 + 1 as int))").alias("a"))
    return x.groupBy("chrom").agg(F.collect_set("a").alias("a")).select("chrom", F.array_join(variants.sort_alleles(F.col("a")), ",").alias("alleles"))


@query(f"with {V6} select chrom, pos, sample_id, a, b from calls where sample_id < 10 union all select chrom, pos, sample_id, a, b from calls where sample_id >= 5")
def concat_union(spark, d):
    c = calls_view(spark, d).select(*SITE, "sample_id", F.get("gt", F.lit(0)).cast("long").alias("a"), F.get("gt", F.lit(1)).cast("long").alias("b"))
    return variants.concat([c.where("sample_id < 10"), c.where("sample_id >= 5").select("b", "a", "sample_id", "pos", "chrom")])


@query("select 'same' pair, true compatible union all select 'other order', false")
def header_compat(spark, d):
    def fine(tables):
        try:
            variants.concat(tables, check=True)
        except ValueError:
            return False
        return True

    c = calls_view(spark, d)
    return spark.createDataFrame([("same", fine([c, c])), ("other order", fine([c, c.select(*reversed(c.columns))]))], "pair string, compatible boolean")


_TRUTH = """t as (select p_partkey variant_id, 'chr1' chrom, p_partkey * 10 pos, 'A' ref, case when p_partkey % 4 = 0 then 'AGG' else 'C' end alt from part), c as (select 'chr1' chrom, p_partkey * 10 + case when p_partkey % 4 = 0 then p_partkey % 7 - 3 else case when p_partkey % 5 = 0 then 1 else 0 end end pos, 'A' ref, case when p_partkey % 4 = 0 then 'ATT' else 'C' end alt from part where p_partkey % 9 <> 0)"""


@query(f"""with {_TRUTH}, m as (select t.variant_id, t.chrom, t.pos, c.pos "at", c.pos - t.pos "offset", t.alt ta, c.ref cr, c.alt ca from t join c on t.chrom = c.chrom and ((length(t.alt) = 1 and c.pos = t.pos and c.alt = t.alt) or (length(t.alt) = 3 and abs(c.pos - t.pos) <= 4 and length(c.alt) = 3)))
select variant_id, chrom, pos, "at", "offset" from m qualify row_number() over (partition by variant_id order by abs("offset"), "offset", cr, ca) = 1""")
def truth_match(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    t = p.selectExpr("p_partkey variant_id", "'chr1' chrom", "p_partkey * 10 pos", "'A' ref", "case when p_partkey % 4 = 0 then 'AGG' else 'C' end alt")
    c = p.where("p_partkey % 9 <> 0").selectExpr("'chr1' chrom", "p_partkey * 10 + case when p_partkey % 4 = 0 then p_partkey % 7 - 3 else case when p_partkey % 5 = 0 then 1 else 0 end end pos", "'A' ref", "case when p_partkey % 4 = 0 then 'ATT' else 'C' end alt")
    return variants.match_truth(t, c)


_PERT = ", other as (select chrom, pos, sample_id, case when (pos + sample_id) % 7 = 0 then b else a end a, case when (pos + sample_id) % 11 = 0 then -1 else b end b from calls)"


def _other(c):
    a, b = F.get("gt", F.lit(0)), F.get("gt", F.lit(1))
    k = F.col("pos") + F.col("sample_id")
    return c.withColumn("gt", F.array(F.when(k % 7 == 0, b).otherwise(a), F.when(k % 11 == 0, -1).otherwise(b)))


@query(f"""with {V6}{_PERT}, m as (select c.sample_id, (least(c.a, c.b) = least(o.a, o.b) and greatest(c.a, c.b) = greatest(o.a, o.b)) e from calls c join other o using (chrom, pos, sample_id) where least(c.a, c.b, o.a, o.b) >= 0)
select sample_id, count(*) compared, count(*) filter (where e) equal, round(count(*) filter (where e) / cast(count(*) as double), 6) rate from m group by all""")
def gt_concordance(spark, d):
    c = calls_view(spark, d)
    return variants.concordance(c, _other(c)).withColumn("rate", r("rate"))


_AFP = """, ta as (select chrom, pos, sum(case when a > 0 then 1 else 0 end + case when b > 0 then 1 else 0 end) / (2.0e0 * count(*)) truth, sum(case when a > 0 then 1 else 0 end) / cast(count(*) as double) af from calls where a >= 0 and b >= 0 group by all)"""


def _af_pairs(spark, d):
    a, b = (F.get("gt", F.lit(i)) for i in (0, 1))
    return calls_view(spark, d).where((a >= 0) & (b >= 0)).groupBy(*SITE).agg(((F.sum((a > 0).cast("int")) + F.sum((b > 0).cast("int"))) / (2.0 * F.count("*"))).alias("truth"), (F.sum((a > 0).cast("int")) / F.count("*")).alias("af"))


@query(f"with {V6}{_AFP} select count(*) n, round(avg(abs(af - truth)), 6) mae, round(sqrt(avg((af - truth) * (af - truth))), 6) rmse, round(max(abs(af - truth)), 6) max_error, round(corr(truth, af), 6) r from ta")
def af_error_metrics(spark, d):
    return variants.af_errors(_af_pairs(spark, d)).select("n", *[r(c).alias(c) for c in ("mae", "rmse", "max_error", "r")])


@query(f"with {V6}{_AFP}, s as (select chrom, pos, round(truth, 3) af from ta where truth > 0), cl as (select af, count(*) n from s group by all) select s.chrom, s.pos, s.af, cast((select sum(n) from cl where cl.af between s.af * 0.9 and s.af * 1.1) as bigint) neighbours, round((select count(*) from s z where z.af < s.af) / cast((select count(*) from s) as double), 6) percentile from s")
def af_neighbour_rank(spark, d):
    s = _af_pairs(spark, d).where("truth > 0").select(*SITE, r("truth", 3).alias("af"))
    n = variants.af_neighbours(s)
    return variants.percentile_of(n, "af").select(*SITE, "af", "neighbours", r("percentile").alias("percentile"))


@query(f"""with {KEPT}, x as (select chrom, pos, cast(substr(sample_id, 2) as int) % 3 score, count(*) n, count(*) filter (where read_base <> ref_base) hits from kept group by all),
s as (select chrom, pos, cast(sum(n) as double) n, cast(sum(hits) as double) r, cast(sum(score * hits) as double) sr, cast(sum(score * n) as double) sn, cast(sum(score * score * n) as double) ssn from x group by all), v as (select *, r / n p, (r / n) * (1 - r / n) * (ssn - sn * sn / n) var from s)
select chrom, pos, round(case when var > 1e-12 then (sr - p * sn) * (sr - p * sn) / var else 0 end, 6) chi2 from v""")
def trend_test_stat(spark, d):
    p = reads(spark, d).withColumn("score", F.substring("sample_id", 2, 9).cast("int") % 3).withColumn("id", F.struct(*SITE))
    t = p.groupBy("id", "score").agg(F.count("*").alias("n"), F.count_if(F.col("read_base") != F.col("ref_base")).alias("hits"))
    return variants.trend(t).select("id.*", r("chi2").alias("chi2"))


@query(f"with {BI}, v as (select chrom, pos, count(*) value from own group by all) select b.chrom, b.pos, case when value is null then 'DP=1' else concat('DP=1;DM=', cast(value as varchar)) end info from bi b left join v using (chrom, pos)")
def annotate_info(spark, d):
    p = reads(spark, d)
    s = genotype.biallelic_sites(p)
    v = p.join(s.select(*SITE), SITE).groupBy(*SITE).agg(F.count("*").alias("value"))
    return variants.annotate(s.select(*SITE, F.lit("DP=1").alias("info")), v, "DM").select(*SITE, "info")


@query("with x as (select cast(floor(log10(l_quantity) / 2 * 20) as bigint) bx, cast(floor(log10(l_partkey) / 2 * 20) as bigint) \"by\" from lineitem where l_partkey > 0) select bx, \"by\", count(*) n from x where bx between 0 and 19 and \"by\" between 0 and 19 group by all")
def hist2d_log(spark, d):
    return variants.log_histogram(spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_partkey"), "l_quantity", "l_partkey", 20, 0.0, 2.0)


@query("select concat('S', cast(s_suppkey % 50 as varchar)) sample_id, count(*) n from supplier group by all having count(*) > 1")
def multi_sample_duplicates(spark, d):
    return variants.duplicates(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('S', cast(s_suppkey % 50 as string)) sample_id"))
