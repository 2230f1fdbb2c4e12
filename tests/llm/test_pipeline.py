"""The pipeline's stages, each against a plain version of its own."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_match_ops import brute  # noqa: E402
from test_text_ops import check_packing  # noqa: E402

from loomgrid.llm import langid, pii  # noqa: E402
from loomgrid.llm._common import stage  # noqa: E402


def test_stages_in_turn(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out("doc_id"))))
    want = {x.doc_id for x in found.collect() if x.accepted}
    results = {}
    for name, step in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in docs.collect()}
        docs = stage(step(spark, docs, tiny), name)
        results[name] = docs
        if name == "language":
            assert {x.doc_id for x in docs.collect()} == want and len(want) >= 0.98 * len(before)
        elif name == "near_duplicates":
            groups = brute({i: x.text for i, x in before.items()})
            assert {x.doc_id for x in docs.collect()} == {i for i, (_, c) in groups.items() if c == i}
        elif name == "personal_data":
            spans = {x.doc_id: bool(x.base or x.added) for x in pii.find(results["near_duplicates"]).collect()}
            after = {x.doc_id: x for x in docs.collect()}
            assert after.keys() == before.keys()
            assert all((after[i].text != before[i].text) == spans[i] for i in before)
            assert all(x.n_chars == len(x.text) for i, x in after.items() if spans[i])
        if name != "packing":
            assert docs.columns == columns
    check_packing(docs.collect(), {x.doc_id: x.text for x in results["personal_data"].collect()})
    assert corpus_pipeline.run(spark, tiny).count() == docs.count()


ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en"), (1, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", None), (None, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (None, "nobody else has these words in their text at all today", "en"), (None, "nobody else has these words in their text at all today", "en"),
    (3, "mail me at jane@example.org or at 10.0.0.1 when the fox is away", "en"), (3, "one id with another text that is not alike in any of its words", "en"),
    (4, None, "en"), (5, "", "en"), (6, "123 !?", "en"), (6, "123 !?", "en"), (7, "der schnelle braune fuchs springt und der hund ist nicht da", None),
]


@pytest.fixture(scope="module")
def odd(spark, tiny):
    """Null and repeated ids, and columns named as the operators name their own."""
    from pyspark.sql import functions as F

    known = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 3000").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang").limit(60)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").unionByName(known)
    docs = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("score", "margin", "accepted", "lang_pred", "base", "added", "id", "h", "cls", "comp", "c0", "_find_text", "n", "component_id", "keep_0"):
        docs = docs.withColumn(c, F.lit(-1.0))
    return docs.repartition(3)


def test_stages_with_odd_rows(spark, odd, tiny):
    told = corpus_pipeline.language(spark, odd, tiny)
    assert told.columns == odd.columns
    rows = told.collect()
    assert all(set(r[5:]) == {-1.0} and r.lang for r in rows)
    assert not {4, 5, 6} & {r.doc_id for r in rows} and sum(r.doc_id is None for r in rows) == 3 and sum(r.doc_id == 1 for r in rows) == 2

    near = corpus_pipeline.near_duplicates(spark, odd, tiny)
    assert near.columns == odd.columns
    rows = near.collect()
    assert all(set(r[5:]) == {-1.0} for r in rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in rows if r.doc_id is None or r.doc_id < 1000)
    want = sorted({((-1 if i is None else i), t) for i, t, _ in ODD if i != 2 and not (i is None and t.startswith("the quick"))}, key=lambda x: (x[0], x[1] or ""))
    assert sorted(got, key=lambda x: (x[0], x[1] or "")) == want
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id and r.doc_id >= 1000}
    groups = brute(texts)
    assert {r.doc_id for r in rows if r.doc_id and r.doc_id >= 1000} == {i for i, (_, c) in groups.items() if c == i}

    clean = corpus_pipeline.personal_data(spark, odd, tiny)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    rows = clean.collect()
    assert all(set(r[5:]) == {-1.0} for r in rows)
    assert any(r.doc_id == 3 and r.text == "mail me at <EMAIL> or at <IP> when the fox is away" and r.n_chars == len(r.text) for r in rows)
    assert sum(r.doc_id == 4 and r.text is None for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 3

    out = corpus_pipeline.packed(spark, odd, tiny).collect()
    assert sum(r.doc_id is None for r in out) == 3 and all(len(r.ids) == 4 * r.length for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(len(x) <= 64 and sum(r.length for r in x) <= 2048 for x in by.values()) and max(map(len, by.values())) > 1


def test_stages_of_an_empty_table(spark, odd, tiny):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, odd.where("false"), tiny).count() == 0
