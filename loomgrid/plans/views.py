"""Domain views over the star-schema tables, so that both engines see the same input.

Each view is a list of (name, SQL expression) over one table; ``{S}`` is the engine's text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PILEUP = ("lineitem", [
    ("chrom", "concat('chr', cast(l_partkey % 22 + 1 as {S}))"),
    ("pos", "l_partkey + 1"),
    ("sample_id", "concat('S', cast(l_suppkey % 50 as {S}))"),
    ("ref_base", "substr('ACGT', cast(l_partkey % 4 + 1 as int), 1)"),
    ("read_base", "substr('ACGT', cast((l_partkey + case when (l_orderkey * 7 + l_linenumber * 13) % 10 < l_partkey % 5 then 1 else 0 end) % 4 + 1 as int), 1)"),
    ("bq", "10 + cast(l_quantity as int) % 31"),
    ("mapq", "cast(round(l_tax * 100) as int) * 7"),
    ("strand", "case when l_linestatus = 'O' then '+' else '-' end"),
    ("rpr", "l_linenumber"),
    ("is_dup", "l_returnflag = 'R'"),
])

#: The same reads, with up to four letters at a site.
PILEUP4 = ("lineitem", [(n, e) if n != "read_base" else (n, "substr('ACGT', cast((l_partkey + case when (l_orderkey * 7 + l_linenumber * 13) % 10 < l_partkey % 5 then 1 + (l_orderkey + l_suppkey) % 3 else 0 end) % 4 + 1 as int), 1)") for n, e in PILEUP[1]])

FRAGMENTS = ("documents", [
    ("doc_id", "doc_id"),
    ("sample_id", "source"),
    ("seq", "regexp_replace(upper(text), '[^ACGTN]', ''{G})"),
    ("is_rev", "doc_id % 2 = 1"),
    ("mapq", "1 + cast(doc_id % 60 as int)"),
])

ALIGNMENTS = ("events", [
    ("event_id", "event_id"),
    ("sample_id", "user_id % 20"),
    ("chrom", "case when event_id % 100 < 3 then 'chrY' when event_id % 100 < 8 then 'chrX' else concat('chr', cast(event_id % 22 + 1 as {S})) end"),
    ("pos", "1 + (event_id * 7919) % 57000000"),
    ("mapq", "cast(event_id % 61 as int)"),
    ("flag", "cast((event_id % 2) + 2 * (event_id % 3 % 2) + 4 * (case when event_id % 17 = 0 then 1 else 0 end) + 16 * (event_id % 5 % 2) + 64 * (event_id % 7 % 2) + 128 * ((event_id % 7 + 1) % 2) + 256 * (case when event_id % 23 = 0 then 1 else 0 end) + 512 * (case when event_id % 29 = 0 then 1 else 0 end) + 1024 * (case when event_type = 'error' then 1 else 0 end) + 2048 * (case when event_id % 31 = 0 then 1 else 0 end) as int)"),
    ("isize", "(event_id * 37) % 1200 - 600"),
    ("qname", "concat('r', cast(event_id % 4000 as {S}))"),
])

CIGARS = ("orders", [
    ("read_id", "o_orderkey"),
    ("sample_id", "concat('S', cast(o_custkey % 20 as {S}))"),
    ("pos0", "o_orderkey * 3"),
    ("cigar", "concat(cast(o_orderkey % 20 + 5 as {S}), 'M', cast(o_custkey % 3 + 1 as {S}), case o_custkey % 3 when 0 then 'I' when 1 then 'D' else 'S' end, cast(o_orderkey % 15 + 5 as {S}), 'M')"),
])

VIEWS = {"pileup": PILEUP, "pileup4": PILEUP4, "fragments": FRAGMENTS, "alignments": ALIGNMENTS, "cigar_reads": CIGARS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return df.selectExpr(*[f"{e.format(S='string', G='')} as {n}" for n, e in columns])


def view_sql(name: str) -> str:
    """``name as (select ...)``, a common table expression for DuckDB."""
    source, columns = VIEWS[name]
    listed = ", ".join(f"{e.format(S='varchar', G=", 'g'")} {n}" for n, e in columns)
    return f"{name} as (select {listed} from {source})"
