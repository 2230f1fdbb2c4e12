"""Queries of site records with several alternatives, evaluation, planning and read projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import flags, phred
from loomgrid.functions import genotypes as G
from loomgrid.operators import caller, fragments, genotype, intervals, pileup, records, variants
from loomgrid.plans.queries import _TRUTH, AL, BI, K, N_SAMPLES, QUERIES, SITE, SITES, V4, V6, _B, _DENSE, _alts, _listed, _motifs, _rank_sql, _sites, calls_view, group_af_sql, query, r, reads, sample_groups, sites_sql
from loomgrid.plans.views import view, view_sql

_BEFORE = set(QUERIES)
KEPT4 = view_sql("pileup4") + ", kept as (select * from pileup4 where not is_dup and mapq >= 5 and bq >= 10)"


def reads4(spark, d):
    return pileup.kept_reads(view(spark, d, "pileup4"))


# ------------------------------------------------------------------ the model with several alternatives

@query(f"with recursive {KEPT4}, {sites_sql('kept')} {SITES}")
def caller_sites_multi(spark, d):
    """Sites of up to four letters, so that alleles are dropped in several steps."""
    return _sites(reads4(spark, d))


@query(f"with recursive {KEPT4}{V4}, {group_af_sql('kept')}")
def caller_group_af_multi(spark, d):
    p = reads4(spark, d)
    g = caller.group_af(p, caller.call_sites(p, min_af=0.05), sample_groups(spark, d), min_af=0.05)
    return g.select(*SITE, "group", "dp", _listed("af").alias("af"))


# ------------------------------------------------------------------ genotypes

def _multi_sql(share: float) -> str:
    shown = lambda i: f"case when k.read_base = {i} then 1 - e else e / 3 end"
    return f"""{KEPT4}, alleles as (select chrom, pos, any_value(ref_base) ref_base, list(distinct read_base order by read_base) filter (where read_base <> ref_base) alts from kept group by all having count(*) filter (where read_base <> ref_base) > 0),
named as (select chrom, pos, list_concat([ref_base], alts) al, alts from alleles),
gts as (select *, unnest(list_transform(range(1, len(al) + 1), lambda j: list_transform(range(1, j + 1), lambda i: struct_pack(i := i, j := j))), recursive := false) row_j from named),
gt as (select chrom, pos, al, g.i i, g.j j, al[g.i] x, al[g.j] y, cast(g.j * (g.j - 1) / 2 + g.i as int) g from (select *, unnest(row_j) g from gts)),
ll as (select k.chrom, k.pos, k.sample_id, g, i, j, sum(log10((1 - w) * ({shown('x')}) + w * ({shown('y')}))) l from (select *, pow(10, -bq / 10.0e0) e from kept) k join (select *, case when i = 1 and j > 1 then {share}e0 else 0.5e0 end w from gt) t using (chrom, pos) group by all),
pl as (select chrom, pos, sample_id, g, i, j, cast(round((max(l) over (partition by chrom, pos, sample_id) - l) * 10) as int) p from ll),
pls as (select chrom, pos, sample_id, list(p order by g) pl, list(struct_pack(i := i, j := j) order by g) gg from pl group by all),
ads as (select chrom, pos, sample_id, list_transform(any_value(al), lambda a: len(list_filter(list(read_base), lambda b: b = a))) ad from kept join named using (chrom, pos) group by all),
called as (select chrom, pos, sample_id, alts, pl, ad, list_sum(ad) dp, gg[list_position(pl, list_min(pl))] best, list_sort(pl)[2] gq from pls join ads using (chrom, pos, sample_id) join named using (chrom, pos))"""


_SHOWN = "select chrom, pos, sample_id, array_to_string(alts, ',') alts, array_to_string(pl, ',') pl, array_to_string(ad, ',') ad, cast(dp as bigint) dp, concat(best.i - 1, '/', best.j - 1) gt, gq from called"


def _multi(spark, d, share=0.5):
    p = genotype.counted(reads4(spark, d))
    s = records.seen_sites(p)
    return p, s, records.calls(p, s, share)


def _shown(c):
    return c.select(*SITE, "sample_id", F.array_join("alts", ",").alias("alts"), *[F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x) for x in ("pl", "ad")], "dp", variants.unphased(F.col("gt")).alias("gt"), "gq")


@query(f"with {_multi_sql(0.5)} {_SHOWN}")
def genotype_pl_multi(spark, d):
    return _shown(_multi(spark, d)[2])


@query(f"with {_multi_sql(0.4)} {_SHOWN}")
def genotype_ref_bias(spark, d):
    """Heterozygotes of the reference show their other allele in 40 % of their reads."""
    return _shown(_multi(spark, d, 0.4)[2])


_POST = f"""{_multi_sql(0.5)}, af as (select chrom, pos, list_transform(al, lambda a: len(list_filter(bs, lambda b: b = a)) / cast(len(bs) as double)) f from (select chrom, pos, any_value(al) al, list(read_base) bs from kept join named using (chrom, pos) group by all)),
cl as (select chrom, pos, list_transform(f, lambda x: least(greatest(x, 1e-6), 1 - 1e-6)) f from af),
lk as (select c.*, f, list_transform(pl, lambda x: pow(10, -(x - list_min(pl)) / 10.0e0)) q, gg from called c join pls using (chrom, pos, sample_id, pl) join cl using (chrom, pos)),
ps as (select *, list_transform(list_zip(q, gg), lambda z: z[1] * case when z[2].i = z[2].j then f[z[2].i] * f[z[2].i] else 2 * f[z[2].i] * f[z[2].j] end) z from lk),
pn as (select *, list_transform(z, lambda x: x / list_sum(z)) n from ps),
ds as (select *, gg[list_position(list_transform(n, lambda x: round(x, 12)), list_max(list_transform(n, lambda x: round(x, 12))))] top, list_max(n) m, list_transform(range(2, len(f) + 1), lambda a: list_sum(list_transform(list_zip(n, gg), lambda y: y[1] * (case when y[2].i = a then 1 else 0 end + case when y[2].j = a then 1 else 0 end)))) dd from pn)"""


@query(f"with {_POST} select chrom, pos, sample_id, concat(top.i - 1, '/', top.j - 1) gt, round(least(1000, greatest(0, case when m >= 1 then 1000 else -10 * log10(1 - m) end)), 4) gq, round(dd[1], 6) dose1, round(dd[2], 6) dose2, round(dd[3], 6) dose3 from ds")
def genotype_posterior_multi(spark, d):
    p, s, c = _multi(spark, d)
    got = genotype.with_posterior(c.drop("gt", "gq"), records.allele_shares(p, s))
    got = got.withColumn("dose", records.allele_dosages(F.col("posterior"), F.size("alts") + 1))
    return got.select(*SITE, "sample_id", variants.unphased(F.col("gt")).alias("gt"), r("gq", 4).alias("gq"), *[r(F.get("dose", F.lit(i))).alias(f"dose{i + 1}") for i in range(3)])


_TAIL = """tail as (select chrom, pos, x, 0 k, sqrt(x / 2) t, sqrt(x / 2) s from stat union all select chrom, pos, x, k + 1, t * x / (2.0e0 * (k + 1) + 1), s + t * x / (2.0e0 * (k + 1) + 1) from tail where k < 120),
ps as (select chrom, pos, x, case when x > 60 then 0 else greatest(0, 1 - 2 / sqrt(pi()) * exp(-x / 2) * s) end p from tail where k = 120)"""
_HWE = f"""{_multi_sql(0.5)}, soft as (select chrom, pos, len(alts) + 1 m, list_transform(pl, lambda x: pow(10, -(x - list_min(pl)) / 10.0e0)) q from called),
part as (select chrom, pos, m, q[1] / list_sum(q) a, list_sum(list_transform(range(1, m), lambda j: q[cast(j * (j + 1) / 2 + 1 as int)])) / list_sum(q) b, list_sum(list_transform(range(1, m), lambda j: q[cast(j * (j + 1) / 2 + j + 1 as int)])) / list_sum(q) c from soft),
tot as (select chrom, pos, sum(a) + any_value(e) n0, sum(b) + any_value(e) * (m - 1) n1, sum(c) + any_value(e) * (m - 1) n2 from (select *, ({N_SAMPLES} - count(*) over (partition by chrom, pos)) * 2.0e0 / (m * (m + 1)) e from part) group by chrom, pos, m),
stat as (select chrom, pos, case when n * q * q > 1e-10 then pow(n0 - n * q * q, 2) / (n * q * q) else 0 end + case when 2 * n * q * p > 1e-10 then pow(n1 - 2 * n * q * p, 2) / (2 * n * q * p) else 0 end + case when n * p * p > 1e-10 then pow(n2 - n * p * p, 2) / (n * p * p) else 0 end x
  from (select *, n0 + n1 + n2 n, (n1 + 2 * n2) / (2 * (n0 + n1 + n2)) p, 1 - (n1 + 2 * n2) / (2 * (n0 + n1 + n2)) q from tot)), {_TAIL}"""


@query(f"with recursive {_HWE} select chrom, pos, round(x, 6) chi2, round(p, 6) p from ps")
def hwe_multi(spark, d):
    h = records.hwe(_multi(spark, d)[2], N_SAMPLES)
    return h.select(*SITE, r("chi2").alias("chi2"), r("p").alias("p"))


@query(_rank_sql("bq").replace("with ", "with recursive ", 1).rsplit("select chrom, pos, round(", 1)[0] + f""", stat as (select chrom, pos, pow(case when n1 * n2 * (n1 + n2 + 1) / 12 < 1e-10 then 0 else (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) end, 2) x from s), {_TAIL} select chrom, pos, round(p, 6) p from ps""")
def ranksum_p(spark, d):
    p = genotype.counted(reads(spark, d))
    z = genotype.rank_sum(reads(spark, d), genotype.biallelic_sites(p), "bq")
    return z.select(*SITE, r(records.rank_p(F.col("z"))).alias("p"))


# ------------------------------------------------------------------ strands against the deepest allele

_STRAND = f"""{KEPT4}, bs as (select chrom, pos, ref_base, read_base, count(*) filter (where strand = '+') f, count(*) filter (where strand = '-') r from kept group by all),
mj as (select * from bs qualify row_number() over (partition by chrom, pos order by f + r desc, read_base) = 1),
st as (select a.chrom, a.pos, m.read_base major, a.read_base alt, m.f mf, m.r mr, a.f af, a.r ar, case when m.read_base = a.read_base then cast(round((m.f + m.r) / 2.0e0) as bigint) else a.f end xf, case when m.read_base = a.read_base then cast(round((m.f + m.r) / 2.0e0) as bigint) else a.r end xr from bs a join mj m using (chrom, pos) where a.read_base <> a.ref_base)"""


def _strands(spark, d):
    p = reads4(spark, d)
    return records.strands(p, records.seen_sites(p))


@query(f"with {_STRAND} select chrom, pos, major, alt, mf, mr, af, ar from st")
def strand_major(spark, d):
    return _strands(spark, d).select(*SITE, "major", "alt", "mf", "mr", "af", "ar")


@query(f"""with {_STRAND}, lf as (select n, coalesce(sum(ln(n)) over (order by n rows between unbounded preceding and current row), 0) v from (select unnest(range(1, 2000)) n) union all select 0, 0),
ks as (select *, unnest(range(greatest(0, mf - xr), least(mf + mr, mf + xf) + 1)) i from st),
ps as (select k.*, exp(a.v - b.v - c.v + e.v - f.v - g.v - h.v + m.v + o.v) p from ks k join lf a on a.n = mf + mr join lf b on b.n = i join lf c on c.n = mf + mr - i join lf e on e.n = xf + xr join lf f on f.n = mf + xf - i join lf g on g.n = xr - mf + i join lf h on h.n = mf + mr + xf + xr join lf m on m.n = mf + xf join lf o on o.n = mr + xr),
ob as (select chrom, pos, alt, p po from ps where i = mf)
select chrom, pos, alt, round(abs(-10 * log10(least(1, sum(case when p <= po * (1 + 1e-7) then p else 0 end)))), 4) fs from ps join ob using (chrom, pos, alt) group by all""")
def strand_fs_score(spark, d):
    return _strands(spark, d).select(*SITE, "alt", r("fs", 4).alias("fs"))


@query(f"""with {_STRAND}, c as (select chrom, pos, alt, mf + o rf, mr + o rr, xf + o xf, xr + o xr from (select *, case when mf = 0 or mr = 0 or xf = 0 or xr = 0 then 1.0e0 else 0.0e0 end o from st))
select chrom, pos, alt, round(ln(rf * xr / (rr * xf) + rr * xf / (rf * xr)) * (rr / rf - xr / xf), 6) sor from c""")
def strand_sor_major(spark, d):
    return _strands(spark, d).select(*SITE, "alt", r("sor").alias("sor"))


# ------------------------------------------------------------------ variant tables and evaluation

@query("select p_partkey id, coalesce(f is null or f in ('.', 'PASS'), true) pass from (select p_partkey, case p_partkey % 5 when 0 then '.' when 1 then 'PASS' when 2 then 'q10' when 3 then 'PASS;q10' end f from part)")
def pass_filter(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey id", "case p_partkey % 5 when 0 then '.' when 1 then 'PASS' when 2 then 'q10' when 3 then 'PASS;q10' end f")
    return x.select("id", variants.is_pass(F.col("f")).alias("pass"))


@query("select distinct concat('S', cast(c_custkey % 70 as varchar)) sample_id from customer where c_custkey % 70 not in (select s_suppkey % 50 from supplier)")
def unknown_samples(spark, d):
    wanted = spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('S', cast(c_custkey % 70 as string)) sample_id")
    return variants.unknown(wanted, spark.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('S', cast(s_suppkey % 50 as string)) sample_id"))


@query(f"""with {KEPT4}, s as (select distinct chrom, pos, read_base alt from kept where read_base <> ref_base),
t as (select p_partkey + 1 pos, concat('chr', cast(p_partkey % 22 + 1 as varchar)) chrom, case when p_partkey % 7 = 0 then 'AT' else 'A' end ref, case p_partkey % 3 when 0 then 'c,G' when 1 then 'T' else 'A,CC' end alts from part)
select s.chrom, s.pos, alt from s join t using (chrom, pos) where pos % 4 <> 1 and length(ref) = 1 and not regexp_matches(alts, '[A-Za-z][A-Za-z]') and list_contains(string_split(upper(alts), ','), alt)""")
def allowed_sites(spark, d):
    s = reads4(spark, d).where("read_base <> ref_base").select(*SITE, F.col("read_base").alias("alt")).distinct()
    p = spark.read.parquet(f"{d}/part.parquet")
    t = p.selectExpr("p_partkey + 1 pos", "concat('chr', cast(p_partkey % 22 + 1 as string)) chrom", "case when p_partkey % 7 = 0 then 'AT' else 'A' end ref", "split(case p_partkey % 3 when 0 then 'c,G' when 1 then 'T' else 'A,CC' end, ',') alts")
    return variants.allowed(s, t.where("pos % 4 <> 1").select(*SITE), t)


@query(f"""with {V6}{V4}, gr as (select cast(substr(sample_id, 2) as bigint) sample_id, "group" from groups), own as (select c.*, "group" from calls c join gr using (sample_id)),
ga as (select chrom, pos, "group", unnest([a, b]) x from own), per as (select chrom, pos, "group", count(*) filter (where x >= 0) an, count(*) filter (where x = 1) c1, count(*) filter (where x = 2) c2 from ga group by all)
select chrom, pos, "group", an, round(case when an > 0 then c1 / cast(an as double) else 0 end, 6) af1, round(case when c2 > 0 then c2 / cast(an as double) end, 6) af2 from per""")
def truth_group_af(spark, d):
    g = sample_groups(spark, d).select(F.substring("sample_id", 2, 9).cast("long").alias("sample_id"), "group")
    t = variants.group_truth(calls_view(spark, d), g)
    return t.select(*SITE, "group", "an", *[r(F.get("af", F.lit(i))).alias(f"af{i + 1}") for i in range(2)])


@query(f"with {V6} select chrom, pos, sample_id, a, b from calls order by md5(concat_ws('|', '7', chrom, pos, sample_id)), chrom, pos, sample_id limit 100")
def random_top_n(spark, d):
    got = variants.drawn(calls_view(spark, d), 100, [*SITE, "sample_id"], 7)
    return got.select(*SITE, "sample_id", F.get("gt", F.lit(0)).alias("a"), F.get("gt", F.lit(1)).alias("b"))


@query("""select l_suppkey, count(*) n, round(sum(l_quantity), 6) "sum", round(avg(l_quantity), 6) mean, round(stddev_samp(l_quantity), 6) sd, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) se, round(median(l_quantity), 6) median, arg_min(o, (l_quantity, o)) first_min, arg_max(o, (l_quantity, -o)) first_max from (select *, l_orderkey * 10 + l_linenumber o from lineitem) group by all""")
def generic_stats(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey", "l_quantity", "l_orderkey * 10 + l_linenumber o")
    s = variants.summary(x, ["l_suppkey"], "l_quantity", "o")
    return s.select("l_suppkey", "n", *[r(c).alias(c) for c in ("sum", "mean", "sd", "se", "median")], "first_min", "first_max")


@query(f"""with {KEPT4}, x as (select chrom, pos, cast(substr(sample_id, 2) as int) % 3 g, read_base = ref_base rf from kept),
t as (select chrom, pos, {', '.join(f'count(*) filter (where g = {g} and rf) r{g}, count(*) filter (where g = {g} and not rf) a{g}' for g in range(3))} from x group by all),
lf as (select n, coalesce(sum(ln(n)) over (order by n rows between unbounded preceding and current row), 0) v from (select unnest(range(1, 2000)) n) union all select 0, 0),
ij as (select *, r0 + r1 + r2 - i - j k from (select *, unnest(range(0, r1 + a1 + 1)) j from (select *, unnest(range(0, r0 + a0 + 1)) i from t))),
ps as (select ij.chrom, ij.pos, i = r0 and j = r1 seen, exp(l0.v - x0.v - y0.v + l1.v - x1.v - y1.v + l2.v - x2.v - y2.v - n.v + nr.v + na.v) p from ij
  join lf l0 on l0.n = r0 + a0 join lf x0 on x0.n = i join lf y0 on y0.n = r0 + a0 - i join lf l1 on l1.n = r1 + a1 join lf x1 on x1.n = j join lf y1 on y1.n = r1 + a1 - j
  join lf l2 on l2.n = r2 + a2 join lf x2 on x2.n = k join lf y2 on y2.n = r2 + a2 - k join lf n on n.n = r0 + a0 + r1 + a1 + r2 + a2 join lf nr on nr.n = r0 + r1 + r2 join lf na on na.n = a0 + a1 + a2 where k between 0 and r2 + a2),
ob as (select chrom, pos, p po from ps where seen)
select chrom, pos, round(least(1, sum(case when p <= po * (1 + 1e-7) then p else 0 end)), 6) p from ps join ob using (chrom, pos) group by all""")
def fisher_2x3(spark, d):
    g, ref = F.substring("sample_id", 2, 9).cast("int") % 3, F.col("read_base") == F.col("ref_base")
    t = reads4(spark, d).groupBy(*SITE).agg(*[F.count_if((g == i) & ref).alias(f"r{i}") for i in range(3)], *[F.count_if((g == i) & ~ref).alias(f"a{i}") for i in range(3)])
    return t.select(*SITE, r(variants.fisher_2x3("r0", "r1", "r2", "a0", "a1", "a2")).alias("p"))


@query(f"""with {_TRUTH}, m as (select distinct t.variant_id from t join c on t.chrom = c.chrom and ((length(t.alt) = 1 and c.pos = t.pos and c.alt = t.alt) or (length(t.alt) = 3 and abs(c.pos - t.pos) <= 4 and length(c.alt) = 3))),
n as (select (select count(*) from m) tp, (select count(*) from c) - (select count(*) from m) fp, (select count(*) from t) - (select count(*) from m) fn)
select tp, fp, fn, round(tp / cast(tp + fn as double), 6) sensitivity, round(tp / cast(tp + fp as double), 6) "precision", round(2.0e0 * tp / (2 * tp + fp + fn), 6) f1 from n""")
def detection_metrics(spark, d):
    t, c = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 9 <> 0")
    t = t.selectExpr("p_partkey variant_id", "'chr1' chrom", "p_partkey * 10 pos", "'A' ref", "case when p_partkey % 4 = 0 then 'AGG' else 'C' end alt")
    c = c.selectExpr("'chr1' chrom", "p_partkey * 10 + case when p_partkey % 4 = 0 then p_partkey % 7 - 3 else case when p_partkey % 5 = 0 then 1 else 0 end end pos", "'A' ref", "case when p_partkey % 4 = 0 then 'ATT' else 'C' end alt")
    return variants.detected(t, c, variants.match_truth(t, c)).select("tp", "fp", "fn", *[r(x).alias(x) for x in ("sensitivity", "precision", "f1")])


@query(f"with {V6}, k as (select chrom, pos, sample_id, a >= 0 or b >= 0 c from calls) select chrom, pos, count(*) filter (where c) called, count(*) samples from k group by all")
def called_samples(spark, d):
    return variants.called_counts(calls_view(spark, d))


@query(f"with {V6}, n as (select distinct chrom, pos from calls) select n.chrom, n.pos, coalesce(an, 0) an, coalesce(c1, 0) ac1, coalesce(c2, 0) ac2 from n left join cnt using (chrom, pos)")
def subset_keep_all(spark, d):
    c = calls_view(spark, d)
    got = variants.recount(_alts(c), variants.subset(c, [1, 2, 3, 5, 8, 13]), keep_all=True)
    return got.select(*SITE, "an", *[F.get("ac", F.lit(i)).alias(f"ac{i + 1}") for i in range(2)])


# ------------------------------------------------------------------ planning

@query("""with t as (select n_name chrom, cast(unnest(range(1, 1000000 * (n_nationkey + 1) + 1, 300000)) as bigint) "start", cast(1000000 * (n_nationkey + 1) as bigint) stop from nation), w as (select chrom, "start", least("start" + 299999, stop) "end" from t)
select concat('run -q 5 -r ', chrom, ':', "start", '-', "end", ' -o out/', chrom, '.', "start", '-', "end", '.vcf.gz') command from w""")
def tile_commands(spark, d):
    regions = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_name chrom", "1L start", "cast(1000000 * (n_nationkey + 1) as bigint) end")
    return intervals.commands(intervals.tiles(regions, 300_000), "run", "-q 5", "out").select("command")


@query("select sample_id, cast((row_number() over (order by sample_id) - 1) // 40 as bigint) batch from (select concat('S', cast(c_custkey as varchar)) sample_id from customer)")
def sample_batches(spark, d):
    return intervals.batches(spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('S', cast(c_custkey as string)) sample_id"), 40).select("sample_id", "batch")


@query(f"with {AL} select chrom, cast(pos // 500000 as bigint) win, count(*) n from alignments group by all")
def sub_regions(spark, d):
    return view(spark, d, "alignments").groupBy("chrom", intervals.window_of(F.col("pos")).alias("win")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ reads

@query(f"""with {AL}, m as (select *, pos + isize mpos, case when event_id % 13 = 0 then 'chrM' else chrom end mchrom from alignments)
select event_id, not ({_B['unmapped']}) and ({_B['paired']}) and not ({_B['mate_unmapped']}) and chrom = mchrom and case when pos < mpos then not ({_B['reverse']}) and ({_B['mate_reverse']}) else not (not ({_B['reverse']}) and ({_B['mate_reverse']})) end proper from m""")
def proper_orientation(spark, d):
    m = F.when(F.col("event_id") % 13 == 0, "chrM").otherwise(F.col("chrom"))
    return view(spark, d, "alignments").select("event_id", flags.proper_orientation(F.col("flag"), F.col("chrom"), F.col("pos"), m, F.col("pos") + F.col("isize")).alias("proper"))


_CLIPS = "concat(case o_orderkey % 4 when 0 then '' when 1 then '3S' when 2 then '2S1S' else '5H4S' end, cast(o_orderkey % 20 + 5 as {S}), 'M', cast(o_custkey % 3 + 1 as {S}), case o_custkey % 3 when 0 then 'I' when 1 then 'D' else 'N' end, '2I3D', cast(o_orderkey % 15 + 5 as {S}), 'M', case o_custkey % 5 when 0 then '4S' when 1 then '1S2S' else '' end)"
_QUAL = "concat(repeat('I', cast(o_orderkey % 30 + 20 as int)), repeat('5', cast(o_custkey % 7 as int)))"


@query(f"""with x as (select o_orderkey read_id, {_CLIPS.format(S='varchar')} cg, o_orderkey % 30 + 20 hi, o_custkey % 7 lo, o_orderkey % 11 <> 0 mapped, case o_orderkey % 4 when 1 then 3 when 2 then 3 else 0 end head, case o_custkey % 5 when 0 then 4 when 1 then 3 else 0 end tl, o_custkey % 3 + 1 n, o_custkey % 3 k from orders)
select read_id, cast(hi + lo as int) query_length, cast(case when mapped then head else -1 end as int) query_start, cast(case when mapped then hi + lo - tl else -1 end as int) query_end, cast(case when mapped then tl else -1 end as int) query_start_reverse, cast(case when mapped then hi + lo - head else -1 end as int) query_end_reverse,
round(case when mapped then (hi * 40 + lo * 20) / cast(hi + lo as double) else -1 end, 6) mean_quality, cast(case when mapped then greatest(2, case when k = 0 then n else 0 end) else 0 end as int) longest_insertion, cast(case when mapped then greatest(3, case when k = 1 then n else 0 end) else 0 end as int) longest_deletion from x""")
def read_projections(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey read_id", f"{_CLIPS.format(S='string')} cigar", f"{_QUAL} qual", "o_orderkey % 11 <> 0 mapped")
    p = pileup.projections(F.col("cigar"), F.col("qual"), F.col("mapped"))
    return x.select("read_id", *[(r(c) if n == "mean_quality" else c).alias(n) for n, c in p.items()])


@query(f"with {_DENSE} select sample_id, motif, \"count\", printf('%.6f', \"count\" / cast(greatest(sum(\"count\") over (partition by sample_id), 1) as double)) frequency from dense where \"count\" > 0")
def motif_table(spark, d):
    """The written form: samples' motifs that occur, six decimals."""
    f = fragments.frequencies(fragments.motif_counts(_motifs(spark, d).select("sample_id", "motif"), K, zeros=False))
    return f.where("count > 0").select("sample_id", "motif", "count", records.written("frequency", F.lit("%.6f")).alias("frequency"))


@query(f"with {BI}, n as (select chrom, pos, count(*) n, sum(bq) s from own group by all) select chrom, pos, printf('%g', round(s / cast(n as double) * 1000, 6)) six, printf('%.3f', round(s / cast(n as double), 6)) three from n")
def number_formats(spark, d):
    p = reads(spark, d)
    n = p.join(genotype.biallelic_sites(p).select(*SITE), SITE).groupBy(*SITE).agg((F.sum("bq") / F.count("*")).alias("m"))
    return n.select(*SITE, records.written(F.round(F.col("m") * 1000.0, 6), F.lit("%.6g")).alias("six"), records.written(F.round("m", 6), F.lit("%.3f")).alias("three"))


NAMES = [n for n in QUERIES if n not in _BEFORE]
