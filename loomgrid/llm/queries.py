"""Queries that apply the operators of this subpackage to their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import fuzzy, jaccard, langid, licenses, packing, pieces, pii, tokens, topk, urls
from loomgrid.llm._common import table

#: The rules of the first query.
URL_RULES = (
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
)
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), packing.Capacities(tokens=2048))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"), 64, id_col="vec_id", vector_col="embedding")
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), keep=())
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("covered").alias("span_bytes"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    everything = pii.joined(F.array_sort(F.concat("base", "added")))
    method = [F.size(F.filter("added", lambda s: s.kind == kind)).cast("long").alias(f"n_added_{kind}") for kind in sorted(set(pii.KINDS))]  # noqa: B023
    totals = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return found.select("doc_id", *[n(k) for k in pii.BASE_KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), everything.alias("spans"), *method, *totals)


def op8_fuzzy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.compare_with_edit(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_best_fit_packing, op3_language_id, op4_exact_topk, op5_sentencepiece, op6_token_counts, op7_pii, op8_fuzzy_fingerprints, op9_ngram_jaccard, op10_license_scan)}


_OP1 = """
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path
  from pages),
rules(action, rhost, rpath) as (values ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
fits as (
  select p.page_id, r.rhost || r.rpath rule, r.action, row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc) k
  from parts p join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') verdict
from parts p left join fits f on f.page_id = p.page_id and f.k = 1
"""

_OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score
from s qualify rank <= 20
"""


_OP9 = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
sh as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 80 * (x.n + y.n - i)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id d, doc_id r from w union select reach.d, edges.b from reach join edges on reach.r = edges.a)
select w.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(reach.r) component_id
from w join reach on w.doc_id = reach.d left join n on w.doc_id = n.doc_id group by w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op4_exact_topk": _OP4, "op9_ngram_jaccard": _OP9}
