"""License scans by diagonal voting (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, sub_batches
from loomgrid.llm.words import WordHasher, shingles

#: Words of a k-gram; templates are at least this long.
K = 3
SLICE_BYTES = 4 << 20
#: Words of neighbouring diagonals that one span may join, and share of a template that it must cover.
DRIFT, COVER = 3, 0.7
#: Gram positions of all templates that may be broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000


@dataclass(frozen=True)
class Template:
    """``base``: the phrase counts wherever it stands word for word; else a span that covers
    ``COVER`` of it gives the label.  ``marks``: short phrases of the text, each of which the span
    must have, since other licences differ in them."""

    label: str
    text: str
    base: bool = False
    marks: tuple[str, ...] = ()


#: The phrases of the contract.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Opening words of public licences, as their own texts have them.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license", marks=("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl-3", "licensed under the gnu general public license version 3", marks=("gnu general", "version 3")),
    Template("gpl-3", "licensed under the gnu general public license v3", marks=("gnu general", "v3")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", marks=("gnu general",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0", marks=("mozilla public",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", marks=("noncommercial",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution non commercial license", marks=("non commercial",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", marks=("sharealike",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution share alike license", marks=("share alike",)),
)


def _words(text: str) -> list[str]:
    """Words of a template, split where the hasher splits them."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_grams(templates: Iterable[Template]) -> list[tuple[int, str, int, int, bool, int, int]]:
    """A row per k-gram: template, label, words, grams, base, position and hash."""
    hasher, out = WordHasher(letters=True), []
    for t, template in enumerate(templates):
        h, of, _ = hasher.words([template.text.encode()])
        grams, _, _ = shingles(h, of, 1, K)
        if len(grams) != len(h) - K + 1:
            raise ValueError(f"a template needs {K} words: {template.text!r}")
        out += [(t, template.label, len(h), len(grams), template.base, p, int(g)) for p, g in enumerate(grams.view(np.int64))]
    return out


def word_grams(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """All rolling k-gram hashes ``id, uid, pos, hash``, and a row with pos -1 and the number of words."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("uid", F.monotonically_increasing_id())
    schema = T.StructType([rows.schema["id"], T.StructField("uid", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letters=True)
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            h, of, counts = hasher.column(b.column("text"))
            grams, at, pos = shingles(h, of, b.num_rows, K)
            every = np.arange(b.num_rows)
            take = np.concatenate([every, at])
            own = b.select(["id", "uid"]).take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), own.column("uid"), pa.array(np.concatenate([np.full(b.num_rows, -1), pos]).astype(np.int32)), pa.array(np.concatenate([counts.astype(np.int64), grams.view(np.int64)]))],
                schema.names,
            )

    return rows.select("id", "uid", "text").mapInArrow(run, schema)


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    All rolling word k-gram hashes join the templates' positions.  Hits vote for the diagonal
    (place in the text minus place in the template); neighbouring diagonals of a template merge
    into a span, which is verified: a base phrase needs every gram on one diagonal, which chains
    its words in order; another template needs ``COVER`` of its grams, each counted once, within
    ``DRIFT`` words of drift in all and inside its own length and that drift, and the words that
    tell it from other licences.  ``n_base`` counts places of base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start, ``score`` is 1 with a base phrase, else the
    largest share of a template that a verified span covers, else 0.

    Words are told apart by 64-bit hashes.  A null or empty text has no words and no labels; a
    null id stays null; repeated rows are scanned each; an empty table gives an empty result;
    other columns are left behind.  Templates are few; they are broadcast only when counted.
    """
    spark = docs.sparkSession
    templates = tuple(templates)
    grams = template_grams(templates)
    known = spark.createDataFrame([g[0:1] + g[5:7] for g in grams], "template int, tpos int, hash long")
    if len(grams) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    text = word_grams(docs, id_col=id_col, text_col=text_col)
    joined = text.join(known, (F.col("pos") >= 0) & (text["hash"] == known["hash"]), "left").drop(known["hash"])
    # what hit nothing has a null template and folds, before the shuffle, into its document's own row
    hits = joined.groupBy("uid", "id", "template", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.max(F.when(F.col("pos") < 0, F.col("hash"))).alias("n_words"))
    hit = F.struct("template", "diagonal", "tpos")
    each = hits.groupBy("uid", "id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), hit))).alias("hits"))
    labels = F.array(*[F.lit(t.label) for t in templates])
    found = each.withColumn("exact", diagonals(F.col("hits"), templates, grams)).withColumn("spans", spans(F.col("hits"), templates, grams))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda v: F.get(labels, v.template)))), ",")
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min(F.transform("exact", lambda v: v.diagonal)).cast("long").alias("first_word"),
        F.array_max(F.transform("exact", lambda v: v.diagonal)).cast("long").alias("last_word"),
        listed(F.col("exact")).alias("base_labels"),
        listed(F.concat(F.transform("exact", lambda v: F.struct(v.template.alias("template"))), F.transform(F.col("spans"), lambda s: F.struct(s.template.alias("template"))))).alias("labels"),
        F.when(F.size("exact") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(F.col("spans"), lambda s: s.share)), F.lit(0.0))).alias("score"),
    )


def told_apart(templates: tuple[Template, ...], grams: list[tuple]) -> list[list[list[int]]]:
    """For each template the sets of gram positions of which a span must hit one each: the grams
    that hold a mark, and those that a template of another label lacks, where the grams it shares
    would be enough for ``COVER``."""
    own = [{g[5]: g[6] for g in grams if g[0] == i} for i in range(len(templates))]
    out = []
    for i, t in enumerate(templates):
        text = _words(t.text)
        sets = []
        for mark in map(_words, t.marks):
            sets.append([p for p in own[i] if any(text[p + j : p + j + len(mark)] == mark for j in range(K - len(mark) + 1))])
            if not sets[-1]:
                raise ValueError(f"a mark must be {K} words of its template at most: {mark!r}")
        for j, other in enumerate(templates):
            if not (t.base or other.base or t.label == other.label):
                lacks = [p for p, g in own[i].items() if g not in own[j].values()]
                if lacks and len(own[i]) - len(lacks) >= COVER * len(own[i]):
                    sets.append(lacks)
        out.append(sets)
    return out


def _window(hits: Column, h: Column, i: Column, width: int, most: int) -> Column:
    """Of hits sorted by template and diagonal, those from place ``i`` on of the same template and at most ``width`` diagonals on."""
    return F.filter(F.slice(hits, i + 1, most), lambda x: (x.template == h.template) & (x.diagonal - h.diagonal <= width))


def _opens(hits: Column, h: Column, i: Column) -> Column:
    """Whether a hit is the first of its diagonal."""
    before = F.get(hits, i - 1)
    return (i == 0) | (before.template != h.template) | (before.diagonal != h.diagonal)


def diagonals(hits: Column, templates: tuple[Template, ...], grams: list[tuple]) -> Column:
    """Places of base phrases, array of ``template, diagonal``: every gram on one diagonal."""
    needed = [sum(g[0] == i for g in grams) for i in range(len(templates))]
    base, need = F.array(*[F.lit(t.base) for t in templates]), F.array(*map(F.lit, needed))
    most = max((n for n, t in zip(needed, templates) if t.base), default=1)

    def full(x: Column) -> Column:
        return F.filter(x, lambda h, i: _opens(x, h, i) & (F.size(_window(x, h, i, 0, most)) >= F.get(need, h.template)))

    own = F.filter(hits, lambda h: F.get(base, h.template))
    # an array of one lets the hits be made once and used by name
    return F.transform(F.flatten(F.transform(F.array(own), full)), lambda h: F.struct(h.template.alias("template"), h.diagonal.alias("diagonal")))


def spans(hits: Column, templates: tuple[Template, ...], grams: list[tuple]) -> Column:
    """Verified spans of the other templates: array of ``template, share``.

    A span begins at a hit diagonal and has the hits of the ``DRIFT`` diagonals after it, so that its
    drift is bounded as a whole, and its length by the template's and ``DRIFT``.  Grams of the
    template count once each, and so do places in the text.  One of each of ``told_apart``'s sets
    must be hit.
    """
    needed = [sum(g[0] == i for g in grams) for i in range(len(templates))]
    base, need = F.array(*[F.lit(t.base) for t in templates]), F.array(*map(F.lit, needed))
    none = F.array().cast("array<array<int>>")
    apart = F.array(*[F.array(*[F.array(*map(F.lit, s)) for s in sets]) if sets else none for sets in told_apart(templates, grams)])
    most = (DRIFT + 1) * max((n for n, t in zip(needed, templates) if not t.base), default=1)

    def judged(w: Column) -> Column:
        t = F.get(w, F.lit(0)).template
        n = F.least(F.size(F.array_distinct(F.transform(w, lambda x: x.tpos))), F.size(F.array_distinct(F.transform(w, lambda x: x.diagonal + x.tpos))))
        told = F.forall(F.get(apart, t), lambda s: F.exists(w, lambda x: F.array_contains(s, x.tpos)))
        return F.struct(t.alias("template"), F.when(told, n / F.get(need, t)).otherwise(F.lit(0.0)).alias("share"))

    def each(x: Column) -> Column:
        opened = F.filter(F.transform(x, lambda h, i: F.when(_opens(x, h, i), _window(x, h, i, DRIFT, most))), lambda w: w.isNotNull())
        return F.filter(F.transform(opened, judged), lambda s: s.share >= COVER)

    own = F.filter(hits, lambda h: ~F.get(base, h.template))
    return F.flatten(F.transform(F.array(own), each))
