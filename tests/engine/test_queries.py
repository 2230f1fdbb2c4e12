"""Every query with SQL gives the same rows in both engines; results don't follow the partitioning."""

import math
import re

import duckdb
import pytest

from loomgrid.catalog import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


def told(rows):
    one = lambda v: ("nan" if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, tiny, name):
    df = queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = told([r[c] for c in columns] for r in df.collect())
    if name not in oracle_sql():
        assert got
        return
    cur = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert got == told([r[names.index(c)] for c in columns] for r in cur.fetchall())


@pytest.mark.parametrize("name", ["caller_sites", "caller_group_af", "em_allele_freq", "motif_mds"])
def test_partitions_dont_matter(spark, tiny, name):
    columns, results = None, []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            df = queries()[name](spark, tiny)
            columns = columns or df.columns
            results.append(told([r[c] for c in columns] for r in df.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_every_site_is_densified(spark, small):
    got = queries()["zero_depth_densify"](spark, small)
    sites = duckdb.sql(f"select count(distinct l_partkey) from '{small}/lineitem.parquet' where l_returnflag <> 'R' and round(l_tax * 100) * 7 >= 5").fetchall()[0][0]
    samples = duckdb.sql(f"select count(distinct l_suppkey % 50) from '{small}/lineitem.parquet'").fetchall()[0][0]
    reads = duckdb.sql(f"select count(*) from '{small}/lineitem.parquet' where l_returnflag <> 'R' and round(l_tax * 100) * 7 >= 5").fetchall()[0][0]
    x = got.selectExpr("count(*) n", "count(distinct chrom, pos, sample_id) d", "sum(depth) depth", "max(pos) top").first()
    assert (x.n, x.d, x.depth) == (sites * samples, sites * samples, reads) and x.top > 200


def test_every_event_is_an_interval(spark, tiny):
    events = [e for e in spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "user_id").collect()]
    covered = {}
    for e in events:
        start = 1 + e.event_id * 7919 % 900000
        covered.setdefault(f"chr{e.user_id % 5 + 1}", set()).update(range(start, start + e.event_id % 400 + 1))
    assert {x.chrom: x.bases for x in queries()["interval_total_length"](spark, tiny).collect()} == {c: len(s) for c, s in covered.items()}
    assert queries()["annotate_info"](spark, tiny).where("info = 'DP=1'").count() == 0


def test_every_document_is_a_reference(spark, tiny):
    docs = {x.doc_id: re.sub("[^ACGTN]", "", (x.text or "").upper()) for x in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    want, used = {}, set()
    for (i,) in spark.read.parquet(f"{tiny}/events.parquet").select("event_id").collect():
        if s := docs.get(i % (max(docs) + 1)):
            at = i * 7919 % len(s)
            m = s[at : at + 4]
            want[i] = m[::-1].translate(str.maketrans("ACGTN", "TGCAN")) if i % 2 else m
            used.add((i % (max(docs) + 1), at // 500))
    assert {x.event_id: x.motif for x in queries()["motif_from_reference"](spark, tiny).collect()} == want and len(used) > 100
