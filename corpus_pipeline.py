"""From documents to packed sequences: language ID, near duplicates, personal data, packing.

Each stage takes ``documents`` with any further columns, of whatever names; all but the last return
the same columns in the same order, and change none but those that they say.  An empty table gives
an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import jaccard, langid, packing, pii
from loomgrid.llm._common import named_again, numbered, stage, table

#: Ids that rows without one take while duplicates are looked for; real ids are smaller.
NO_ID = 2**62
#: Rows that go, by id and text hash; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: What a sequence holds: tokens, documents, and attention cost (the sum of squared piece lengths).
CAPACITIES = packing.Capacities(tokens=2048, documents=64)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told.

    Texts that are null or have no letter go, and those whose best two languages are nearer than
    the margin fitted on labelled rows.  A null ``lang`` becomes the predicted language; a label
    that is there stays.  Rows with a null id are judged like others; repeated rows stay as often
    as they stand there.
    """
    own = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(own, model, id_col=at["doc_id"], text_col=at["text"], keep=own.columns).where("accepted")
    return named_again(found.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links lead through: that of the smallest id, and of
    rows with that id the one whose text hashes lowest.

    A row with a null id takes part after all others (by an id made of its text).  Documents
    without words are in no group and stay.  Of rows that repeat an id and its text one stays,
    whichever; rows that share an id with different texts are different documents.
    """
    own = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    h = F.xxhash64(at["text"])
    number = F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NO_ID) + F.pmod(h, F.lit(2**61)))
    own = own.withColumn("id", F.struct(number.alias("number"), h.alias("h")))  # orders by the id, then the text
    linked = jaccard.link(own, id_col="id", text_col=at["text"])
    judged = linked.groupBy("id").agg(F.count("*").alias("times"), F.first("n_shingles").alias("n"), F.first("component_id").alias("of"))
    judged = stage(judged.select("id", "times", ((F.col("n") == 0) | (F.col("id") == F.col("of"))).alias("stays")), "judged")
    kept = own.join(_few(judged.where("not stays").select("id")), "id", "left_anti")
    again = judged.where("stays and times > 1").select("id")
    if not again.isEmpty():
        again = _few(again)
        kept = kept.join(again, "id", "left_anti").unionByName(kept.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return named_again(kept, docs)


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast where the rows are counted to be few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind; ``text`` and, where it changes, ``n_chars``
    change and no document goes.  Null texts and ids stay null; repeated rows are changed each."""
    return pii.redact(docs, length_col="n_chars").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens and 64 documents; each row is a piece with its
    token ids.  A null text is the end token alone, a null id stays null, rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITIES, keep_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: Compression and tokenisation have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
