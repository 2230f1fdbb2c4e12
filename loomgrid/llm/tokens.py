"""Token counts (operator 6), and the exact segment-cached encoders that operators 2 and 5 share."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomgrid.llm._common import pick, sub_batches

#: An Arrow batch is worked on in slices of so many bytes of text.
SLICE_BYTES = 4 << 20
#: Segments kept by a worker's cache; when full it starts anew.  Longer segments are never kept.
CACHE_SEGMENTS, CACHE_CHARS = 400_000, 48

#: Fixed value: how the byte-level pre-tokenizer splits texts.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_two_blanks = re.compile(r"\s\s").search
_inner_blank = re.compile(r"(?<=\S) (?=\S)").split


class Encoder:
    """Exact ids of whole texts, from encodings of the segments between safe boundaries.

    A boundary is safe where no token can cross it for any text: then the ids of the whole text
    are those of its segments, one after the other, and repeated segments are encoded once.
    A text in which boundaries can't be proven safe goes to the library as a whole.
    """

    def __init__(self) -> None:
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def short(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments; the library's, unless there is a faster way to the same."""
        return self.library(segments) if segments else []

    def segments(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def spelled(self, segment: str, inner: bool) -> str:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text the ids as unsigned little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, str, list[str]]] = []
        whole: list[int] = []
        first, rest = self.first, self.rest
        if len(first) + len(rest) > CACHE_SEGMENTS:
            first.clear()
            rest.clear()
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.segments(text)
            if parts is None:
                whole.append(i)
            else:
                cut.append((i, parts.pop(0), parts))
        for i, ids in zip(whole, self.library([texts[i] for i in whole]), strict=True):
            out[i] = np.asarray(ids, "<u4").tobytes()
        new_first = list({head for _, head, _ in cut} - first.keys())
        seen: set[str] = set()
        for _, _, parts in cut:
            seen.update(parts)
        new_rest = [x for x in seen if x not in rest]
        ids = self.short([self.spelled(x, False) for x in new_first] + [self.spelled(x, True) for x in new_rest])
        packed = [array("I", x).tobytes() for x in ids]
        first.update(zip(new_first, packed))
        rest.update(zip(new_rest, packed[len(new_first) :]))
        get = rest.__getitem__
        for i, head, parts in cut:
            out[i] = first[head] + b"".join(map(get, parts))
        for known, fresh in ((first, new_first), (rest, new_rest)):
            for s in fresh:
                if len(s) > CACHE_CHARS:
                    known.pop(s, None)
        return out


def _merger(spec: dict):
    """An encoder with the file's own merges, where its ids are the order of its merges.

    Then ranks alone say which pair merges first, and a rank-based encoder gives the same ids for
    the same pre-tokens several times faster.  None if the file isn't of this kind.
    """
    import tiktoken

    model = spec.get("model") or {}
    vocab, merges = model.get("vocab") or {}, model.get("merges") or []
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, others for letters from U+0100
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens") or []}
    try:
        ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in special}
    except KeyError:
        return None
    order = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    singles = [i for token, i in ranks.items() if len(token) == 1]
    if len(singles) != 256 or sorted(order) != order or min(order, default=256) <= max(singles) or len({*order, *singles}) != len(ranks):
        return None
    return tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class JsonEncoder(Encoder):
    """A ``tokenizers`` file.  With byte-level pre-tokens and no normaliser, a single blank between
    two non-blank characters starts a new pre-token whatever stands around it, so it is safe."""

    def __init__(self, blob: bytes) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(blob.decode())
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(blob)
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = _merger(spec)
        self.safe = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def short(self, segments: list[str]) -> list[list[int]]:
        if not (self.fast and self.safe):
            return super().short(segments)
        # letters and signs up to U+024F are classed alike in all editions of Unicode
        slow = [i for i, x in enumerate(segments) if not x.isascii() and max(x) > "\u024f"]
        plain = self.fast.encode_ordinary
        out = [plain(x) for x in segments] if not slow else [[]] * len(segments)
        if slow:
            own = set(slow)
            out = [[] if i in own else plain(x) for i, x in enumerate(segments)]
            for i, ids in zip(slow, self.library([segments[i] for i in slow]), strict=True):
                out[i] = ids
        return out

    def segments(self, text: str) -> list[str] | None:
        if not self.safe or any(s in text for s in self.specials):
            return None
        return _inner_blank(text) if _two_blanks(text) else text.split(" ")

    def spelled(self, segment: str, inner: bool) -> str:
        return " " + segment if inner else segment


class PieceEncoder(Encoder):
    """A ``sentencepiece`` model.  Where its normaliser is the identity with a dummy prefix and no
    piece holds a word mark after another character, each single blank is safe: the library puts
    the same mark before a segment of its own."""

    def __init__(self, blob: bytes) -> None:
        super().__init__()
        import sentencepiece

        from loomgrid.llm.charmap import read_model

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.spec = read_model(blob)
        self.safe = self.spec.splits_at_blanks()

    def library(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def segments(self, text: str) -> list[str] | None:
        if not self.safe or "  " in text or text[0] == " " or text[-1] == " " or "▁" in text:
            return None
        return text.split(" ")

    def spelled(self, segment: str, inner: bool) -> str:
        return segment


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(suffix: str, blob: bytes) -> Encoder:
    """The worker's encoder for a vocabulary; made once, its cache kept between tasks."""
    key = (suffix, hash(blob))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = {".json": JsonEncoder, ".model": PieceEncoder}[suffix](blob)
    return _ENCODERS[key]


def shipped(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """Read a vocabulary file on the driver and give executors a way to its encoder.

    What is broadcast is one file of fixed size; executors need no such file of their own.
    """
    suffix = os.path.splitext(path)[1]
    if suffix not in (".json", ".model"):
        raise ValueError(f"no library for {path!r}: a .json or .model file is needed")
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return lambda: encoder(suffix, sent.value)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Count the tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Encodes in Arrow functions and returns lengths only.  Batches are cut by bytes, long texts at
    safe boundaries (see ``Encoder``), so memory follows the slice and not the text's row count.
    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted
    each; an empty table gives an empty result; other columns are left behind.
    """
    make = shipped(docs.sparkSession, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for b in sub_batches(iter(batches), "text", SLICE_BYTES):
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = pa.array([len(x) >> 2 for x in enc.encode(texts)], pa.int64())
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), n_bytes, n, pa.compute.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(run, schema)
