"""Operators 2, 3, 5 and 6 against the libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("loomgrid.llm.queries")
import public_tokenizers as P  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from loomgrid.llm import charmap, langid, packing, pieces, queries, tokens  # noqa: E402

HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "x\n y", "x \ny", "x\n \ny", "tab\tand blank　wide", "it's 'twas we'll",
    "<|endoftext|>", "so <|endoftext|> here", "café naïve ŝtraße", "数字 と 漢字", "emoji 👩‍👩‍👧 end", "▁mark ▁ x", "line\r\n\r\nnext", "1 22 333 4444 5,000.00",
    "a" * 5000, "word " * 4000, "\x1c\x1d x\x85y", "<s> </s> <unk>", "<0x41> A",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "other") for i, t in enumerate(HARD)] + [(None, "no id", None), (3, "  ", None), (3, "  ", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts_equal_the_library(spark, hard, small):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for docs in (hard, spark.read.parquet(f"{small}/documents.parquet")):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(r.text or "")
        got = tokens.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
        assert len(got) == docs.count()
        for r in got:
            text = texts[r.doc_id][0]
            n = len(t.encode(text, add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 1024), text[:40]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(hard, name):
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        want = {i: len(model.encode(t or "")) for i, t in enumerate(HARD)}
    else:
        t = Tokenizer.from_file(P.path(name))
        want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(HARD)}
    for r in tokens.count_tokens(hard, P.path(name)).where("doc_id is not null").collect():
        assert r.n_tokens == want[r.doc_id], HARD[r.doc_id]


def test_an_empty_table_and_an_unknown_vocabulary(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    assert pieces.encode_pieces(none, P.path("piece_bpe_32k.model")).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(none, "x.txt")


def test_pieces_equal_the_library(spark, hard, small):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (hard, spark.read.parquet(f"{small}/documents.parquet").limit(300)):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in pieces.encode_pieces(docs, P.path("piece_bpe_32k.model")).collect():
            text = texts[r.doc_id]
            ids = model.encode(text)
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.decoded == model.decode(ids) and r.decoded_sha256 == sha(r.decoded)
            assert r.ids_sha256 == sha(",".join(map(str, ids)))
            raw, at = text.encode(), 0
            assert r.covered == len(raw)
            for i, (start, end) in zip(ids, r.spans):
                assert start == at and end >= start
                at = end
                if not model.is_byte(i):
                    assert raw[start:end].decode().replace(" ", "▁") in (model.id_to_piece(i), model.id_to_piece(i)[1:])
            assert at == (len(raw) if ids else 0)


def test_longest_rule_wins_and_places_are_kept():
    m = charmap.Model(pieces=["<unk>"], kinds=[2], rules={b"a": b"1", b"ab": b"22", "ﬁ".encode(): b"fi", b"\t": b" "}, dummy_prefix=True, squeeze=True)
    out, at = m.normalise("  abxa\t ﬁ ")
    assert out.decode() == "▁22x1▁fi"
    assert at.tolist() == [2, 2, 2, 2, 2, 4, 5, 6, 6, 6, 8, 8, 11]


def test_a_compiled_map_is_read():
    # a trie with the single key "a" and the replacement "b": root, child for "a", value
    units = np.zeros(256 + 256, "<u4")
    units[0] = 1 << 10  # offset of the root
    child = 1 ^ ord("a")
    base = child ^ 256
    units[child] = ord("a") | 1 << 8 | 256 << 10
    units[base] = 1 << 31 | 0
    blob = len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + b"b\0"
    assert charmap.read_charmap(blob) == {b"a": b"b"}
    assert charmap.read_charmap(b"") == {}


def check_packing(rows, texts, most=2048):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted(by_doc[d], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // most) and all(r.length == most for r in own[1:])
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(by_seq), sum(r.length for r in rows)


def test_packing_is_whole_gapless_and_tight(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n, total = check_packing(queries.op2_best_fit_packing(spark, small).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert n <= 1.01 * total / 2048 + 1


def test_what_shards_leave_is_packed_again(spark, tiny, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 16)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, total = check_packing(packing.pack(docs, P.path("byte_bpe_50k.json")).collect(), texts)
    monkeypatch.setattr(packing, "FILLED", 0.0)
    once, _ = check_packing(packing.pack(docs, P.path("byte_bpe_50k.json")).collect(), texts)
    assert n < once and n <= total / 2048 + 3


def test_packing_of_odd_texts(hard):
    one = hard.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(one, P.path("byte_bpe_50k.json")).collect(), {r.doc_id: r.text or "" for r in one.collect()})
    assert packing.pack(hard, P.path("byte_bpe_50k.json")).where("doc_id is null").count() == 1
    ids = packing.pack(one, P.path("byte_bpe_50k.json"), keep_ids=True).first()
    assert zlib.crc32(ids.ids) == ids.ids_crc32


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    r = random.Random(3)
    lengths = np.array([r.randint(1, 100) for _ in range(500)])
    caps = packing.Capacities(tokens=128, documents=3, attention=10_000)
    seq, off = packing.best_fit(lengths, caps, (1.0, 0.2, 0.2), rule)
    for s in set(seq.tolist()):
        own = np.flatnonzero(seq == s)
        assert lengths[own].sum() <= 128 and len(own) <= 3 and (lengths[own] ** 2).sum() <= 10_000
        ends = np.cumsum(lengths[own][np.argsort(off[own])])
        assert sorted(off[own].tolist()) == [0, *ends[:-1].tolist()]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), caps)
    assert packing.best_fit(np.zeros(0, np.int64), caps)[0].size == 0


def test_language_of_held_out_documents(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, small).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(not r.accepted for r in rows) <= 0.01 * len(rows)


def test_languages_equal_plain_compression(spark, tiny):
    import zstandard

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    assert model == langid.fit(docs.where(~langid.held_out("doc_id")).repartition(7))  # whatever the partitions
    params = zstandard.ZstdCompressionParameters.from_level(7, min_match=3, search_log=3, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in langid.identify(docs, model).collect():
        data, sizes = texts[r.doc_id].lower().encode(), []
        for _, content in model.by_language:
            c, n = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params), 0
            for i in range(0, len(data), langid.FRAME_BYTES):
                last = i + langid.FRAME_BYTES >= len(data)
                n += len(c.compress(data[i : i + langid.FRAME_BYTES] + langid.TAIL * last))
            sizes.append(n)
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        assert r.lang_pred == model.by_language[ranked[0]][0] and r.margin == sizes[ranked[1]] - sizes[ranked[0]]
        assert r.accepted == (r.margin >= model.margin)


def test_every_language_is_learned_once_from_many_rows(spark):
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(5))
    names = [f"l{i:03d}" for i in range(300)]
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in names]
    rows = [(3 * i + j, " ".join(word(a) for _ in range(40)), n) for i, (n, a) in enumerate(zip(names, alphabets)) for j in range(3)]
    rows += [(7_777, "the very same text", names[0])] * 5000  # one row, repeated
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {n for n, _ in model.by_language} == set(names) and model.by_language[0][0] == names[0]
    assert b"".join(c for _, c in model.by_language).count(b"the very same text") <= 1
    assert all(len(c) <= langid.DICTIONARY_BYTES for _, c in model.by_language)


def test_no_letter_no_language_and_ties(spark):
    docs = spark.createDataFrame([(i, f"{w} more words here", "en") for i, w in enumerate("the and of with".split())] + [(10 + i, "der und nicht eine schon", "de") for i in range(4)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = ["½ ²", "①", "１２３ ٣", "!? \u20ac", "", "Ⅷ", "é", "x"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([*enumerate(odd), (7, "x")], "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred == "und" and not got[i].accepted and got[i].score == 0 for i in range(8)] == [True] * 6 + [False] * 2
    same = langid.Dictionaries((("b", b"one two three four"), ("a", b"one two three four")))
    tied = langid.identify(docs, same).collect()
    assert {(r.lang_pred, r.margin, r.accepted, r.score) for r in tied} == {("b", 0, False, 0.5)}
    assert langid.narrowest([(0, False), (1, False), (3, True), (9, False), (20, True)]) == 2 and langid.narrowest([]) == 1


def test_language_of_odd_texts(spark):
    words = {"en": "the and of with this that there", "de": "der und nicht eine schon ist auch"}
    rows = [(i, words[k], k, "x") for i, k in enumerate(["en", "de"] * 20)] + [(None, "the", "en", "x"), (50, None, "en", "x"), (51, "", None, "x"), (52, "123 !?", "de", "x"), (53, "the with this " * 5000, None, "x"), (54, "und nicht auch", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs.where("doc_id < 40"))
    got = {r.doc_id: r for r in langid.identify(docs, model, keep=["lang", "lang_pred"]).collect()}
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and not any(got[i].accepted for i in (50, 51, 52))
    assert (got[53].lang_pred, got[54].lang_pred) == ("en", "de")
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0
