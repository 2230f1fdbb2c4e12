"""Language identification by compression (operator 3)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, small_batches, sub_batches, tidied

#: Bounds of the fit, whatever the table's size: labelled documents that each language's dictionary
#: is made of, code points that each of them gives, bytes of a dictionary, and labelled documents of
#: each language that the margin is fitted on.
SAMPLE_DOCS, PIECE_CHARS, DICTIONARY_BYTES, MARGIN_DOCS = 256, 256, 65_536, 400
#: Share of rightly told documents of the fit that a fitted margin may reject.
NARROW = 0.0005
UNKNOWN = "und"
#: A text is encoded in frames of so many bytes, so that each byte meets the dictionary and not
#: only what stands before it in its own text, and memory doesn't follow a text's length.
FRAME_BYTES = 2048
#: Follows a text's last frame: one too short to be worth compressing would be stored as it is,
#: and then all dictionaries would give the same size.
TAIL = b" " + b"0" * 96
SLICE_BYTES = 2 << 20


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter (Unicode's category L); digits and number signs are none."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Dictionaries:
    """Raw-content dictionaries, the most frequent language of the fit first, and the margin in
    bytes that a prediction must reach."""

    by_language: tuple[tuple[str, bytes], ...]
    margin: int = 1

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        """Small windows and tables: a dictionary and a frame are all that they must hold."""
        params = zstandard.ZstdCompressionParameters.from_level(7, min_match=3, search_log=3, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for lang, content in self.by_language:
            if len(content) < 8:  # too short for a dictionary; the library asks for 8 bytes
                out.append((lang, zstandard.ZstdCompressor(compression_params=params)))
                continue
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
        return out


def frames(text: str) -> list[bytes]:
    """The whole text in lower case, in frames."""
    data = text.lower().encode()
    starts = range(0, len(data), FRAME_BYTES)
    return [data[s : s + FRAME_BYTES] if s + FRAME_BYTES < len(data) else data[s:] + TAIL for s in starts]


def encoded_sizes(text: str, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> list[int]:
    """Bytes of the whole text under each language's dictionary."""
    parts = frames(text)
    return [sum(len(c.compress(p)) for p in parts) for _, c in compressors]


def _score(margin: int) -> float:
    return 1 / (1 + math.exp(-min(margin, 64) / 2))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, piece_chars: int = PIECE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES, margin_docs: int = MARGIN_DOCS) -> Dictionaries:
    """Fit a dictionary for every language of the labels, and the margin, on a bounded sample.

    Of each language the rows whose (id, text) hashes lowest are taken, equal ones once: a
    threshold on the hash, set from the number of distinct rows, lets a few more than are wanted
    through.  A dictionary is made of pieces that executors cut from places drawn by the hash, so
    what reaches the driver is bounded in bytes for each language.  All dictionaries are cut to one
    size where the languages allow, so none wins by its length.  Rows with a null text, label or id
    take no part; without any, nothing is learned.

    The rows that hash next give the margin: each is told by the dictionaries, and the margin is
    put above those by which wrong answers won, but no higher than what ``NARROW`` of the right
    answers fall short of.
    """
    rows = pick(labelled, id=id_col, text=text_col, lang=lang_col).where("id is not null and text is not null and lang is not null")
    rows = rows.withColumn("rank", F.xxhash64(F.col("id").cast("string"), "text"))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("rank", 0.02).alias("different")).collect()  # a row per language
    if not seen:
        return Dictionaries(())
    seen.sort(key=lambda r: (-r["n"], r["lang"]))
    wanted = sample_docs + margin_docs
    reach = lambda n: min(2**63 - 1, int(2**64 * min(1.0, 2 * wanted / n)) - 2**63)
    threshold = F.create_map(*[x for r in seen for x in (F.lit(r["lang"]), F.lit(reach(r["different"])))])
    few = rows.where(F.col("rank") <= threshold[F.col("lang")])
    at = F.pmod(F.xxhash64("rank"), F.greatest(F.length("text") - piece_chars, F.lit(1))).cast("int") + 1
    cut = few.groupBy("lang", "rank").agg(F.min(F.substring("text", at, F.lit(piece_chars))).alias("piece")).collect()
    by: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in cut:
        by[r["lang"]].append((r["rank"], r["piece"]))
    content, last = {}, {}
    for lang, pieces in by.items():
        pieces.sort()
        # where a language has few documents, half of them are left for the margin
        n = min(sample_docs, -(-len(pieces) // 2))
        content[lang] = "\n".join(p.lower() for _, p in pieces[:n]).encode()
        last[lang] = pieces[n - 1][0], pieces[min(len(pieces), n + margin_docs) - 1][0]
    size = min(dictionary_bytes, max(4096, min(map(len, content.values()))))
    model = Dictionaries(tuple((r["lang"], content[r["lang"]][:size]) for r in seen if r["lang"] in content))
    side = lambda i: F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("lang")]
    others = few.where((F.col("rank") > side(0)) & (F.col("rank") <= side(1))).dropDuplicates(["lang", "rank"])
    told = identify(others, model, id_col="rank", keep=["lang"]).where(F.col("lang_pred") != UNKNOWN).select("margin", (F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    return Dictionaries(model.by_language, narrowest(sorted((r["margin"], r["right"]) for r in told)))


def narrowest(told: list[tuple[int, bool]]) -> int:
    """The least margin to accept, from (margin, whether right), sorted."""
    right = [m for m, fine in told if fine]
    if not right:
        return 1
    most = right[int(NARROW * len(right))]
    return max(1, min(most, 1 + max((m for m, fine in told if not fine and m < most), default=0)))


def identify(docs: DataFrame, model: Dictionaries, *, id_col: str = "doc_id", text_col: str = "text", min_margin: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Identify the language of every whole text: ``doc_id, lang_pred, score, margin, accepted``.

    A text is encoded, frame by frame, with each language's dictionary; the least bytes in all win,
    and among equal ones the language seen most in the fit.  ``margin`` is how many bytes the
    second is behind; ``score`` grows with it from 0.5 to 1.  ``accepted`` is false where the
    margin is under ``min_margin`` (by default the model's own) or the language is ``und``: null
    text, no letter, or nothing learned (score 0).  Columns named in ``keep`` are carried along,
    except those whose names the result has itself.  A null id stays null; repeated rows are judged
    each; an empty table gives an empty result.
    """
    out = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.LongType()), ("accepted", T.BooleanType())]
    keep = [c for c in keep if c not in {id_col, *(n for n, _ in out)}]
    others = [c for c in keep if c != text_col]
    least = model.margin if min_margin is None else min_margin
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("0"), docs[text_col].alias("1"), *[docs[c].alias(f"{i + 2}") for i, c in enumerate(others)])
    at = [1 if c == text_col else others.index(c) + 2 for c in keep]
    schema = T.StructType([T.StructField(id_col, rows.schema["0"].dataType)] + [T.StructField(c, rows.schema[f"{i}"].dataType) for c, i in zip(keep, at)] + [T.StructField(*x) for x in out])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in sub_batches(iter(batches), "1", SLICE_BYTES):
            found = []
            for text in b.column("1").to_pylist():
                if not compressors or not has_letter(text):
                    found.append((UNKNOWN, 0.0, 0, False))
                    continue
                sizes = encoded_sizes(text, compressors)
                best = min(range(len(sizes)), key=sizes.__getitem__)
                margin = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + 64) - sizes[best]
                found.append((compressors[best][0], _score(margin), margin, margin >= least))
            cols = [b.column("0"), *(b.column(i) for i in at), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(tidied(run), schema)


def held_out(id_col: str | Column) -> Column:
    """The contract's fold: CRC-32 of the id as text, modulo 5, is 0; a null id is in no fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
