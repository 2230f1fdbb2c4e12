"""From alignments to pileups and site tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = ["chrom", "pos"]
#: Samples that a plan may list.
LISTED = 10_000


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<len,op>>``."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHPX=]"), 0)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def cigar_blocks(cigar: Column, pos0: Column) -> Column:
    """Operations with the reference and query offsets where they begin: ``len, op, rpos, qpos``.

    M, = and X advance both; I, S and P the query; D and N the reference; H neither.
    """
    kind = "struct<r:bigint,q:bigint,out:array<struct<len:int,op:string,rpos:bigint,qpos:bigint>>>"
    start = F.struct(pos0.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().alias("out")).cast(kind)

    def step(acc: Column, o: Column) -> Column:
        r = acc.r + F.when(o.op.isin("M", "=", "X", "D", "N"), o.len).otherwise(0)
        q = acc.q + F.when(o.op.isin("M", "=", "X", "I", "S", "P"), o.len).otherwise(0)
        return F.struct(r.alias("r"), q.alias("q"), F.concat(acc.out, F.array(F.struct(o.len.alias("len"), o.op.alias("op"), acc.r.alias("rpos"), acc.q.alias("qpos")))).alias("out")).cast(kind)

    return F.aggregate(cigar_ops(cigar), start, step, lambda acc: acc.out)


def aligned_blocks(cigar: Column, pos0: Column) -> Column:
    """Gapless stretches ``start, end`` (0-based, end exclusive)."""
    m = F.filter(cigar_blocks(cigar, pos0), lambda b: b.op.isin("M", "=", "X") & (b.len > 0))
    return F.transform(m, lambda b: F.struct(b.rpos.alias("start"), (b.rpos + b.len).alias("end")))


def walk(reads: DataFrame, keep: list[str]) -> DataFrame:
    """One row per walked element: ``op, rpos, qpos, len``; M, = and X one per base, others one each,
    H none, and none of length 0."""
    blocks = F.filter(cigar_blocks(F.col("cigar"), F.col("pos0")), lambda b: (b.op != "H") & (b.len > 0))
    each = F.flatten(
        F.transform(blocks, lambda b: F.when(
            b.op.isin("M", "=", "X"),
            F.transform(F.sequence(F.lit(0), b.len - 1), lambda j: F.struct(b.op.alias("op"), (b.rpos + j).alias("rpos"), (b.qpos + j).alias("qpos"), F.lit(1).alias("len"))),
        ).otherwise(F.array(F.struct(b.op.alias("op"), b.rpos.alias("rpos"), b.qpos.alias("qpos"), b.len.alias("len")))))
    )
    return reads.select(*keep, F.inline(each))


def elements(reads: DataFrame, ref_chunks: DataFrame | None = None, chunk: int = 10_000, overlap: int = 1_000) -> DataFrame:
    """Pileup rows of reads (``sample_id, chrom, pos0, mapq, cigar, seq, qual, strand``).

    A base is its letter; an insertion ``+letters`` with the quality of the element before it (the
    inserted bases' mean if it comes first), a deletion ``-`` and the reference letters with the
    quality before it (the read's mean if first).  Positions are 1-based, ranks count from 1; the
    reference letter is that of the position, for an indel that of the position before.  Chunks
    carry ``overlap`` letters of the next; a deletion that is longer is put together from all the
    chunks that it spans.
    """
    walked = walk(reads, ["sample_id", "chrom", "mapq", "strand", "seq", "qual"]).where(F.col("op").isin("M", "=", "X", "I", "D"))
    q = lambda at, n: F.transform(F.split(F.substring(F.col("qual"), (at + 1).cast("int"), n), ""), lambda c: F.ascii(c) - 33)
    mean = lambda a: F.aggregate(F.filter(a, lambda x: x >= 0), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(F.filter(a, lambda x: x >= 0)), F.lit(1))
    before = F.ascii(F.substring(F.col("qual"), F.col("qpos").cast("int"), F.lit(1))) - 33
    own = F.ascii(F.substring(F.col("qual"), (F.col("qpos") + 1).cast("int"), F.lit(1))) - 33
    bq = (
        F.when(F.col("op").isin("M", "=", "X"), own)
        .when(F.col("qpos") > 0, before)
        .when(F.col("op") == "I", F.floor(mean(q(F.col("qpos"), F.col("len")))).cast("int"))
        .otherwise(F.floor(mean(q(F.lit(0), F.length("qual")))).cast("int"))
    )
    out = walked.withColumn("bq", bq).withColumn(
        "read_base",
        F.when(F.col("op") == "I", F.concat(F.lit("+"), F.upper(F.substring(F.col("seq"), (F.col("qpos") + 1).cast("int"), F.col("len")))))
        .when(F.col("op") == "D", F.lit("-"))
        .otherwise(F.upper(F.substring(F.col("seq"), (F.col("qpos") + 1).cast("int"), F.lit(1)))),
    )
    out = out.select("sample_id", "chrom", (F.col("rpos") + 1).alias("pos"), "op", "len", "read_base", "bq", "mapq", "strand", (F.col("qpos") + 1).alias("rpr"))
    if ref_chunks is None:
        return out.withColumn("ref_base", F.lit(None).cast("string"))
    # an indel is looked up from the letter before it; chunks carry the letters that follow them
    ref = ref_chunks.select("chrom", "chunk", F.col("seq").alias("letters"))
    indel = F.col("op").isin("I", "D")
    from_pos = F.col("pos") - F.when(indel, 1).otherwise(0)
    far = (F.col("op") == "D") & (F.col("len") > overlap)
    joined = out.where(~far).withColumn("chunk", F.floor((from_pos - 1) / chunk)).join(ref, ["chrom", "chunk"], "left")
    at = (from_pos - F.col("chunk") * chunk).cast("int")
    first, deleted = F.upper(F.substring("letters", at, F.lit(1))), F.upper(F.substring("letters", at + 1, F.col("len")))
    near = joined.withColumns({"ref_base": first, "read_base": F.when(F.col("op") == "D", F.concat(F.lit("-"), deleted)).otherwise(F.col("read_base"))}).drop("chunk", "letters", "op", "len")
    return near.unionByName(_far_deletions(out.where(far), ref, chunk))


def _far_deletions(rows: DataFrame, ref: DataFrame, chunk: int) -> DataFrame:
    """Deletions that reach beyond their chunk's letters; equal ones are looked up once."""
    names = rows.columns
    each = rows.groupBy(*names).agg(F.count("*").alias("times"))
    lo, hi = F.greatest(F.floor((F.col("pos") - 2) / chunk), F.lit(0)), F.floor((F.col("pos") + F.col("len") - 2) / chunk)
    met = each.withColumn("chunk", F.explode(F.sequence(lo, hi))).join(ref, ["chrom", "chunk"], "left")
    part = F.struct("chunk", F.substring("letters", 1, chunk).alias("letters"))
    whole = met.groupBy(*names, "times").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p.letters), "")
    at = (F.col("pos") - 1 - F.get("parts", F.lit(0)).chunk * chunk).cast("int")
    deleted = F.upper(F.substring("text", at + 1, F.col("len")))
    found = whole.withColumn("text", text).withColumns({"ref_base": F.upper(F.substring("text", at, F.lit(1))), "read_base": F.concat(F.lit("-"), deleted)})
    again = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return again.select(*[c for c in names if c not in ("op", "len")], "ref_base")


def relocate_indels(rows: DataFrame) -> DataFrame:
    """Indels (``+`` or ``-`` first) move to the position before; there they stand in for whatever
    the sample had.  One window over (sample, chromosome, position), whose groups are read depth."""
    from pyspark.sql import Window

    indel = F.col("read_base").rlike("^[+-]")
    moved = rows.withColumn("is_indel", indel).withColumn("pos", F.when(indel, F.col("pos") - 1).otherwise(F.col("pos")))
    w = Window.partitionBy("sample_id", "chrom", "pos")
    return moved.withColumn("any_indel", F.max("is_indel").over(w)).where(F.col("is_indel") | ~F.col("any_indel")).drop("any_indel")


def kept_reads(pileup: DataFrame, min_mapq: int = 5, min_bq: int = 10) -> DataFrame:
    return pileup.where(~F.col("is_dup") & (F.col("mapq") >= min_mapq) & (F.col("bq") >= min_bq))


def base_depth(pileup: DataFrame) -> DataFrame:
    """Depth of each base at each site, N left out."""
    return pileup.where(~F.upper("read_base").startswith("N")).groupBy(*SITE, "ref_base", "read_base").agg(F.count("*").alias("depth"))


def site_freqs(pileup: DataFrame) -> DataFrame:
    """Per site an array of ``base, depth, freq`` by (length, letters), and the total depth."""
    depth = base_depth(pileup).groupBy(*SITE, "ref_base").agg(F.sum("depth").alias("total"), F.collect_list(F.struct(F.length("read_base").alias("n"), F.col("read_base").alias("base"), "depth")).alias("bases"))
    return depth.select(*SITE, "ref_base", "total", F.transform(F.array_sort("bases"), lambda b: F.struct(b.base.alias("base"), b.depth.alias("depth"), (b.depth / F.col("total")).alias("freq"))).alias("bases"))


def major_allele(sites: DataFrame) -> DataFrame:
    """The deepest base; of equals the first."""
    best = F.filter("bases", lambda b: b.depth == F.array_max(F.transform("bases", lambda x: x.depth)))
    return sites.select(*SITE, F.get(best, F.lit(0)).base.alias("major"), F.get(best, F.lit(0)).depth.alias("depth"), "total")


def active_alleles(sites: DataFrame, min_af: float) -> DataFrame:
    return sites.select(*SITE, "ref_base", "total", F.filter("bases", lambda b: b.freq >= min_af).alias("active"))


def at_most(sites: DataFrame, k: int) -> DataFrame:
    return sites.where(F.size("active").between(1, k))


def min_af_for(n_samples: int, min_af: float = 0.001) -> float:
    return min(100.0 / n_samples, min_af)


def em(packed: Column, freqs: Column, n: int, rounds: int) -> Column:
    """``rounds`` fixed steps of expectation and maximisation over ``packed`` (array of
    ``lik array<double>, n``), from ``freqs``; ``n`` alleles."""

    def step(f: Column, _: Column) -> Column:
        zero = F.array(*[F.lit(0.0)] * n)

        def add(acc: Column, r: Column) -> Column:
            w = F.zip_with(r.lik, f, lambda a, b: a * b)
            total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
            return F.zip_with(acc, w, lambda s, x: s + x / total * r.n)

        got = F.aggregate(packed, zero, add)
        count = F.aggregate(packed, F.lit(0.0), lambda s, r: s + r.n)
        return F.transform(got, lambda x: x / count)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), freqs, step)


def em_freqs(pileup: DataFrame, by: list[str], rounds: int = 20) -> DataFrame:
    """Frequencies of A, C, G and T by a fixed number of EM rounds; reads alike are counted once."""
    letters = "ACGT"
    e = F.exp(F.col("bq") * -0.2302585093)
    lik = F.array(*[F.when(F.col("read_base") == b, 1.0 - e).otherwise(e / 3.0) for b in letters])
    alike = pileup.where(F.col("read_base").isin(*letters)).groupBy(*by, "read_base", "bq").agg(F.count("*").cast("double").alias("n"))
    packed = alike.select(*by, F.struct(lik.alias("lik"), "n").alias("r"), "read_base", "n").groupBy(*by).agg(
        F.sum("n").alias("depth"), F.collect_list("r").alias("reads"), *[F.sum(F.when(F.col("read_base") == b, F.col("n")).otherwise(0.0)).alias(f"n_{b}") for b in letters]
    )
    start = F.array(*[F.col(f"n_{b}") / F.col("depth") for b in letters])
    return packed.select(*by, F.col("depth").cast("long").alias("depth"), em(F.col("reads"), start, 4, rounds).alias("f"))


def densify(sites: DataFrame, samples: DataFrame, pileup: DataFrame) -> DataFrame:
    """Depth of every sample at every site, 0 where it has no read; one row per pair is the result.

    Repeated sample rows count once.  Up to ``LISTED`` samples are a list that goes with the plan;
    of more, every pair is made by a distributed product.
    """
    depth = pileup.groupBy(*SITE, "sample_id").agg(F.count("*").alias("depth"))
    ids = samples.select("sample_id").distinct()
    listed = [r[0] for r in ids.limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        every = sites.select(*SITE).crossJoin(ids)
    else:
        every = sites.select(*SITE).withColumn("sample_id", F.explode(F.lit(listed).cast(f"array<{ids.schema[0].dataType.simpleString()}>")))
    return every.join(depth, [*SITE, "sample_id"], "left").fillna(0, ["depth"])


def projections(cigar: Column, qual: Column, mapped: Column | None = None) -> dict[str, Column]:
    """What a read's operations and qualities tell: its length, where its aligned part begins and ends
    on the read as stored and reversed, its mean quality, and its longest insertion and deletion.

    Clips count only while nothing but soft clips stands before them.  Positions and the mean are -1
    and the longest ones 0 for unmapped reads.
    """
    mapped = F.lit(True) if mapped is None else mapped
    clip = lambda pattern: F.aggregate(F.regexp_extract_all(F.regexp_extract(cigar, pattern, 1), F.lit("[0-9]+"), 0), F.lit(0), lambda s, x: s + x.cast("int"))
    head, tail, n = clip("^((?:[0-9]+S)*)"), clip("((?:[0-9]+S)*)$"), F.length(qual)
    longest = lambda op: F.coalesce(F.array_max(F.transform(F.filter(cigar_ops(cigar), lambda o: o.op == op), lambda o: o.len)), F.lit(0))
    phreds = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    or_minus = lambda c: F.when(mapped, c).otherwise(-1)
    return {
        "query_length": n,
        "query_start": or_minus(head),
        "query_end": or_minus(n - tail),
        "query_start_reverse": or_minus(tail),
        "query_end_reverse": or_minus(n - head),
        "mean_quality": F.when(mapped & (n > 0), F.aggregate(phreds, F.lit(0), lambda s, x: s + x) / F.when(n > 0, n)).otherwise(-1.0),
        "longest_insertion": F.when(mapped, longest("I")).otherwise(0),
        "longest_deletion": F.when(mapped, longest("D")).otherwise(0),
    }
