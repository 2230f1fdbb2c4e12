"""Operators 1, 4, 7, 8, 9 and 10 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("loomgrid.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from loomgrid.llm import components, fuzzy, jaccard, licenses, pii, pii_model, queries, topk, urls, words  # noqa: E402

# ---------------------------------------------------------------- URL rules


def judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = m[1].translate({c: c + 32 for c in range(65, 91)}) if m else ""
    path = m[2] if m else ""
    fits = [(len(r.host) + len(r.path), len(r.host), r.host + r.path, r.action) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls_equal_brute_force(spark):
    r = random.Random(5)
    labels, paths = ["com", "net", "org", "a", "b", "example", "m", ""], ["/", "/en/", "/en/7", "/de/8", "", "/x/y"]
    rules = [urls.Rule(r.choice(["allow", "block"]), ".".join(r.choice(labels[:7]) for _ in range(r.randint(1, 3))), r.choice(paths)) for _ in range(40)]
    rules = list({(x.host, x.path): x for x in rules}.values())
    urls_ = ["http://" + ".".join(r.choice(labels) for _ in range(r.randint(0, 4))) + r.choice(paths) + r.choice(["", "?a=://b", "#f", "9/"]) for _ in range(3000)]
    urls_ += [None, "", "nothing", "://", "x://", "HTTP://A.COM/En/", "http://com.", "http://münchen.com/en/", "a://b\nc/d"] + ["https://m.a.com/en/7"] * 1500
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = urls.judge_urls(pages, urls.rule_table(spark, rules)).collect()
    assert len(got) == len(urls_)
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == judge(urls_[x.page_id], rules), urls_[x.page_id]
    assert urls.judge_urls(pages.where("false"), urls.rule_table(spark, rules)).count() == 0
    assert urls.judge_urls(pages, urls.rule_table(spark, []) if False else urls.rule_table(spark, rules).where("false")).where("rule is not null").count() == 0


# ---------------------------------------------------------------- top k


def test_topk_equals_brute_force(spark):
    r = random.Random(1)
    vecs = [(i, [r.choice([-1.0, -0.51, 0.0, 0.25, 1.5]) for _ in range(4)]) for i in range(300)]
    vecs += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 400)]
    odd = [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (405, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<float>")
    q = topk.quantise(df, 64, id_col="vec_id", vector_col="embedding")
    got = defaultdict(list)
    for x in topk.top_k(q, q.where("id % 20 = 0"), 20).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    whole = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v in vecs}
    for i in range(0, 400, 20):
        want = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)[:20]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert got.keys() == set(range(0, 400, 20))
    assert topk.top_k(q, q.where("false"), 20).count() == 0
    few = q.where("id in (0, 20, 40)")
    assert topk.top_k(few, few, 20).count() == 6


def test_large_products_are_exact():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**22, 5.0]])
    assert topk._scores(q, c).tolist() == [[2**60 + 1, 2**62 + 5]]
    with pytest.raises(OverflowError):
        topk._scores(q, np.array([[2.0**62, 0.0]]))


def test_topk_in_many_passes(spark, monkeypatch):
    for name, value in (("PASS_BYTES", 400), ("BLOCK_QUERIES", 4), ("TILE_ROWS", 7)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(2)
    vecs = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(120)]
    q = topk.quantise(spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(5), 1, id_col="vec_id", vector_col="embedding")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(q, q.where("id % 3 = 0"), 5).collect()}
    for i in range(0, 120, 3):
        want = sorted((-sum(a * b for a, b in zip(vecs[i][1], v)), j) for j, v in vecs if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in want]
    assert len(got) == 200


# ---------------------------------------------------------------- personal data

PY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PY.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_python(spark, small):
    r = random.Random(9)
    bits = ["a@b.c", "a@b.c_d@e.f", "x.y+z@q-r.com.", "1.2.3.4", "001.255.0.9", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (415) 555-0199", "+49.30.1234567", "+1", "é😀", " ", "@", ".", "+", "-", "7", "word"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    texts += ["", None, "1 " * 30_000, "9" * 50_000, "a.b" * 20_000 + "@", "1.2.3.4 " * 3000, "a@b.c " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1)).repartition(8)
    docs = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").limit(300).select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit(1).alias("base")))
    known = {x.doc_id: x.text or "" for x in docs.collect()}
    got = pii.find(docs).collect()
    assert len(got) == len(known)
    for x in got:
        assert [(s.start, s.rank, s.kind, s.end) for s in x.base] == base_spans(known[x.doc_id]), known[x.doc_id][:200]
        for s in x.added:
            assert not any(s.start < b.end and b.start < s.end for b in x.base)


def test_query_digest(spark, small):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for x in queries.op7_pii(spark, small).collect():
        want = base_spans(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in want).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == w[2] for w in want) for k in PY]
        assert {f"{k}:{s}:{e}" for s, _, k, e in want} <= set(x.spans.split(",")) | {""}


def test_trees_find_what_patterns_miss(spark):
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'token = "{secret}" then', "call (415) 555-0199 now", "ssn 123-45-6789.", "write to jane at mail dot com please", "plain words only and nothing else", f"commit {secret} fixed it", "in 2019-03-04 there were 1234567890123"]
    got = {x.doc_id: [(s.kind, texts[x.doc_id][s.start : s.end]) for s in x.added] for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == [("secret", secret)] and got[1] == [("phone", "(415) 555-0199")] and got[2] == [("ssn", "123-45-6789")]
    assert got[3][0][0] == "email" and got[4] == [] and got[5] == [] and got[6] == []


def test_secrets_of_any_length_and_context(spark):
    r = random.Random(6)
    drawn = lambda n: "".join(r.choice("0123456789abcdefABCDEFghijklmnopqrstuvwxyzXYZ_-") for _ in range(n - 2)) + "a7"
    contexts = [w + e for w in ("token", "secret", "password", "passwd", "api_key", "auth", "secret_key") for e in (' = "', ": ", "=", " = '", " = ")] + ["Authorization: Bearer ", "Authorization: "]
    values = [drawn(n) for n in (24, 40, 126, 129, 500, 5000)] + [f"{drawn(36)}.{drawn(200)}.{drawn(43)}"]
    rows = [(f"some words {c}", v) for c in contexts for v in values]
    clean = [f"{c}{v}" for c in ("words ", "commit ", "author: ", "sha ") for v in values[:6]] + ["a" * 300_000, "-at" * 100_000, "+/" * 100_000]
    texts = [c + v + " end" for c, v in rows] + clean
    got = {x.doc_id: [(s.kind, texts[x.doc_id][s.start : s.end]) for s in x.added] for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    assert [(c, len(v)) for i, (c, v) in enumerate(rows) if got[i] != [("secret", v)]] == []
    assert not any(got[len(rows) + i] for i in range(len(clean)))


def test_trees_in_sql_equal_trees_in_python(spark):
    r, model = random.Random(4), pii_model.train()
    rows = [pii_model.draw(r)[:3] for _ in range(200)]
    df = spark.createDataFrame([(i, k, v, c[-pii_model.CONTEXT :]) for i, (k, v, c) in enumerate(rows)], "i int, k int, v string, c string").select("i", "k", F.struct(F.col("v").alias("value"), F.col("c").alias("before")).alias("m"))
    want = model.probability(np.array([pii_model.features(k, v, c[-pii_model.CONTEXT :]) for k, v, c in rows]))
    for kind in range(4):
        for x in df.where(f"k = {kind}").select("i", F.expr(pii.probability(kind, model)).alias("p")).collect():
            assert abs(x.p - want[x.i]) < 1e-9


def test_secrets_of_the_documents_are_found(spark, small):
    """Spans labelled by hand: in these tables the only data beyond the base patterns are quoted
    tokens of forty hexadecimal digits; all are found, and nothing else is added."""
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labelled = {(i, m.start(1), m.end(1)) for i, t in docs.items() for m in re.finditer('token = "([0-9a-f]{40})"', t)}
    rows = queries.op7_pii(spark, small).collect()
    added = {(x.doc_id, s.start, s.end) for x in pii.find(spark.read.parquet(f"{small}/documents.parquet")).collect() for s in x.added}
    assert len(labelled) > 10 and labelled == added
    assert sum(x.n_added for x in rows) == len(labelled) == sum(x.n_added_secret for x in rows)
    assert all(x.n_spans == x.n_added + x.n_email + x.n_ip + x.n_card + x.n_phone == len(list(filter(None, x.spans.split(",")))) for x in rows)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com or +1 (415) 555-0199 é 1.2.3.4", 5, "s"), (2, None, None, None), (3, "clean", 5, None), (None, "x@y.z", 5, None), (5, "", 0, "")], "doc_id long, text string, n_chars long, source string")
    got = {x.doc_id: x for x in pii.redact(docs, length_col="n_chars").collect()}
    assert got[1].text == "mail <EMAIL> or <PHONE> é <IP>" and got[1].n_chars == len(got[1].text) and got[1].source == "s"
    assert got[2].text is None and got[3].text == "clean" and got[None].text == "<EMAIL>" and got[5].text == ""
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.where("false")).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_and_neighbours(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    got = {x.doc_id: x for x in queries.op8_fuzzy_fingerprints(spark, tiny).collect()}
    assert len(got) == len(docs)
    for d, e in zip(docs, docs[1:] + docs[:1]):
        x, new = got[d.doc_id], fuzzy.edited(d.text, e.text)
        assert x.n_chars == len(d.text) and x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert x.fingerprint == fuzzy.fingerprint(d.text.encode()) and x.edited_fingerprint == fuzzy.fingerprint(new.encode())
        assert x.near_edited == fuzzy.likeness(x.fingerprint, x.edited_fingerprint) and x.near_next == fuzzy.likeness(x.fingerprint, fuzzy.fingerprint(e.text.encode()))
    far = [x.near_next for x in got.values()]
    assert np.mean([x.near_edited for x in got.values()]) > np.mean(far) + 0.2


def plain_fingerprint(data):
    """Byte by byte, from the definition."""
    h = []
    for i in range(len(data)):
        x = sum((data[i - j] + 1) * pow(0x01000193, j, 2**32) for j in range(min(7, i + 1))) % 2**32
        x = x * 0x9E3779B1 % 2**32
        h.append(x ^ x >> 15)

    def signed(block):
        out, start = "", 0
        for i, x in enumerate(h):
            if i + 1 == len(data) or (x % block == block - 1 and len(out) < 63):
                c = zlib.crc32(data[start : i + 1])
                out, start = out + fuzzy.ALPHABET[(c ^ c >> 13) % 64], i + 1
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(signed(block)) < 32:
        block //= 2
    return f"{block}:{signed(block)}:{signed(2 * block)}"


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (bx, *xs), (by, *ys) = x.split(":"), y.split(":")
    both = [(a, b) for i, a in enumerate(xs) for j, b in enumerate(ys) if int(bx) << i == int(by) << j]
    best = 0.0
    for a, b in both:
        a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", s) for s in (a, b))
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, last = [i + 1], row
            for j, d in enumerate(b):
                row.append(last[j] if c == d else 1 + min(last[j + 1], row[j]))
        if a and b:
            best = max(best, 1 - row[-1] / (len(a) + len(b)))
    return best


def test_fingerprints_equal_a_plain_version(spark, tiny):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 6000").collect()}
    docs |= {10_000: "", 10_001: "a", 10_002: "ab" * 700, 10_003: "é" * 40, 10_004: docs[min(docs)] + " and more"}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    marks = {i: plain_fingerprint(t.encode()) for i, t in docs.items()}
    ids = sorted(docs)
    for x in fuzzy.compare_with_edit(rows).collect():
        other = ids[(ids.index(x.doc_id) + 1) % len(ids)]
        text, following = docs[x.doc_id], docs[other]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert (x.fingerprint, x.edited_fingerprint) == (marks[x.doc_id], plain_fingerprint(new.encode()))
        assert x.near_edited == pytest.approx(plain_likeness(x.fingerprint, x.edited_fingerprint)) and x.near_next == pytest.approx(plain_likeness(x.fingerprint, marks[other]))


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "same text here"), (None, "no id"), (4, "é" * 30_000), (5, "a b c " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(7))
    got = fuzzy.compare_with_edit(docs).collect()
    assert len(got) == 6 and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    assert fuzzy.compare_with_edit(docs.where("false")).count() == 0
    lone = fuzzy.compare_with_edit(docs.where("doc_id = 5")).collect()[0]
    assert lone.near_next == 1.0
    assert fuzzy.fingerprints(docs).count() == 6
    assert fuzzy.edits("kitten", "sitting") == 5 and fuzzy.edits("", "ab") == 2


# ---------------------------------------------------------------- similarity join


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    of = {i: i for i in texts}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_join_equals_brute_force(spark, tiny, small):
    for sf in (tiny, small):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link(docs).collect()}
        assert got == brute({x.doc_id: x.text for x in docs.collect()})


def variants(seed):
    """Chains and stars of edited copies near the limit, of all sizes, with passages that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 8, 10, 12, 14, 17, 25, 40, 90, 200]))]
        if r.random() < 0.5:
            w = w[: len(w) // 2] + passage[: r.choice([10, 40])] + w[len(w) // 2 :]
        for _ in range(r.choice([1, 2, 6])):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
    for _ in range(150):  # a hot group: near copies of one text, and of its copies
        w = passage + [word() for _ in range(4)]
        w[r.randrange(44)] = word()
        texts.append(" ".join(w))
    return texts + [None, "", " \t ", "One", "one", "ONE\vtwo", "one two"]


@pytest.mark.parametrize("seed", range(3))
def test_join_near_the_limit(spark, seed):
    texts = dict(enumerate(variants(seed)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("cls", F.lit("clash")).repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link(docs).collect()}
    want = brute(texts)
    assert {i: g for i, g in got.items() if g != want[i]} == {}


def test_join_with_all_bounds_met(spark, monkeypatch):
    for name, value in (("CHUNK", 8), ("PART_ROWS", 4), ("BROADCAST_IDS", 10), ("PACK_KEYS", 900), ("MEET_BYTES", 4000), ("SLICE_BYTES", 2000), ("MEET_ROWS", 640), ("FOLD", 4)):
        monkeypatch.setattr(jaccard, name, value)
    texts = dict(enumerate(variants(7)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link(docs).collect()} == brute(texts)


def boilerplate(seed):
    """Texts that share most of their words with very many others, without being alike, and copies of some."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [[word() for _ in range(60)] for _ in range(2)]
    texts = []
    for i in range(400):
        w = common[i % 2] + [word() for _ in range(r.choice([12, 20, 40]))]
        texts.append(" ".join(w))
        if i % 5 == 0:
            w[-1 - r.randrange(10)] = word()
            texts.append(" ".join(w))
    return texts


def test_join_of_texts_that_share_most(spark):
    texts = dict(enumerate(boilerplate(3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = brute(texts)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link(docs).collect()} == want
    assert len({c for _, c in want.values()}) > 300


def test_join_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEET_BYTES", 1 << 16)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(4))
    texts = {}
    for i in range(6):
        w = [word() for _ in range(r.choice([30_000, 60_000]))]
        texts[3 * i] = " ".join(w)
        for j, share in ((1, 200), (2, 20)):  # a near copy, and one that is too far off
            v = list(w)
            for at in range(0, len(v), share):
                v[at] = word()
            texts[3 * i + j] = " ".join(v)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link(docs).collect()}
    assert got == brute(texts) and all(got[3 * i + 1][1] == 3 * i and got[3 * i + 2][1] == 3 * i + 2 for i in range(6))


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_linked_sets_share_a_key_of_their_rarest(rounds):
    """Whatever the number of sketch rounds; those that lack blocks after the last meet by tokens."""
    texts = [t for t in variants(11) if t]
    sets = jaccard.Sets(words.WordHasher(letters=False), jaccard.pa.array(texts))
    _, rows = np.unique(sets.cls, return_index=True)
    rows = rows[sets.n[rows] > 0]
    held, spare = defaultdict(set), {}
    for own, level in sets.levels(rows):
        for key, of, todo, tag, more in sets.keys(own, level, rounds=rounds):
            for k, o in zip(key.tolist(), of.tolist()):
                held[o].add(k)
            spare |= {(r, t): m for r, t, m in zip(todo.tolist(), tag.tolist(), more.tolist())}
    df = defaultdict(int)
    for ks in held.values():
        for k in ks:
            df[k] += 1
    rare = {}
    for o, ks in held.items():
        rare[o] = set()
        for t in {k & 2047 for k in ks}:
            mine = sorted((k for k in ks if k & 2047 == t), key=lambda k: (-df[k], -k))
            rare[o] |= set(mine[max(0, spare[o, t]) :])
    n = 0
    for i, a in enumerate(rows.tolist()):
        for b in rows[:i].tolist():
            x, y = set(sets.of(a).tolist()), set(sets.of(b).tolist())
            if 100 * len(x & y) >= 80 * len(x | y):
                n += 1
                assert rare[a] & rare[b], (texts[a], texts[b])
    assert n > 100


def test_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (7, "A B C D E F"), (9, None)], "doc_id long, text string")
    got = sorted(((x.doc_id or 0), x.n_shingles, x.component_id) for x in jaccard.link(docs).where("n_shingles <> 1").collect())
    assert got == [(0, 2, 3), (3, 2, 3), (3, 2, 3), (7, 2, 3), (9, 0, 9)]
    assert jaccard.link(docs.where("false")).count() == 0


def test_sketches_bound_differences():
    r = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, 300)], r.integers(0, 2**63, r.integers(1, 900)).astype(np.uint64)]))
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (7, 7)] + [(900, 800), (800, 850)]
    got = defaultdict(set)
    for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[x.comp].add(x.node)
    assert sorted(map(len, got.values())) == [3, 61, 300]


# ---------------------------------------------------------------- licences

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_licences_equal_brute_force(spark, small):
    odd = ["Under the MIT-License! under  the mit license", "cc by nc cc by nc by nc", None, "", "cc by", "Under the MIT\x00License", "apache license, version 2.0", "ünder the mit license", "cc by nc " * 3000, licenses.NOTICES[0].text.upper()]
    extra = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(odd)] + [(None, "cc by nc"), (20_000, odd[0])], "doc_id long, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(extra).withColumn("votes", F.lit(0))
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    for x in got:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[x.doc_id].encode().lower())
        at = [(i, l) for p, l in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
        starts = [i for i, _ in at]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None)), texts[x.doc_id][:80]
        assert x.base_labels == ",".join(sorted({l for _, l in at})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
        assert 0 <= x.score <= 1 and (x.score == 1 or not at)
    assert next(x for x in got if x.doc_id == 20_009).labels == "mit"
    assert licenses.scan(docs.where("false")).count() == 0


def test_licence_spans_are_verified(spark):
    cc, gnu = "This work is licensed under a Creative Commons Attribution", "licensed under the GNU {}General Public License {}"
    isc, bsd = licenses.NOTICES[3].text, licenses.NOTICES[2].text.split()
    spread = "".join(f"{w} " + "x y " * (i % 5 == 4) for i, w in enumerate(bsd))  # two words more after each five
    want = [
        (f"{cc} 4.0 International License", ""), (f"{cc} License", ""), (f"{cc}-NoDerivatives 4.0 International License", ""),
        (f"{cc}-ShareAlike 4.0 International License", "cc-by-sa"), (f"{cc} Share Alike 4.0 License", "cc-by-sa"),
        (f"{cc}-NonCommercial 4.0 International License", "cc-by-nc"), (f"{cc}-Non-Commercial License", "cc-by-nc"),
        (gnu.format("", "version 3"), "gpl-3"), (gnu.format("", "v3.0"), "gpl-3"), (gnu.format("", "version 2"), ""), (gnu.format("Lesser ", "version 3"), ""),
        ("this work is\n" * 50, ""), ("free of charge\n" * 90, ""), (f"{isc} {isc}", "isc"), (spread, ""), (" ".join(bsd[:10] + ["x", "y"] + bsd[10:]), "bsd"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(docs).collect()}
    assert [(t, got[i].labels) for i, (t, _) in enumerate(want)] == want
    assert all((x.score >= licenses.COVER) == bool(x.labels) and x.score <= 1 for x in got.values())


def plain_scan(text):
    """Labels and score by word lists: every place of a template's three words votes for its diagonal."""
    words_of = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
    w = words_of(text or "")
    base = {label for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()}
    shares, cut = {}, [words_of(n.text) for n in licenses.NOTICES]
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    for t, (notice, tw) in enumerate(zip(licenses.NOTICES, cut)):
        grams = [tuple(tw[i : i + 3]) for i in range(len(tw) - 2)]
        hits = defaultdict(list)
        for p, g in enumerate(grams):
            for i in places[g]:
                hits[i - p].append((p, i))
        siblings = []
        for o, (other, ow) in enumerate(zip(licenses.NOTICES, cut)):
            if other.label != notice.label:
                lacks = {p for p, g in enumerate(grams) if g not in {tuple(ow[i : i + 3]) for i in range(len(ow) - 2)}}
                if lacks and len(grams) - len(lacks) >= 0.7 * len(grams):
                    siblings.append(lacks)
        for d in hits:
            own = [h for e in range(d, d + 4) for h in hits.get(e, [])]
            seen = {p for p, _ in own}
            marks = [words_of(m) for m in notice.marks]
            told = all(any(grams[p][j : j + len(m)] == tuple(m) for p in seen for j in range(4 - len(m))) for m in marks) and all(seen & s for s in siblings)
            share = min(len(seen), len({i for _, i in own})) / len(grams)
            if told and share >= 0.7:
                shares[t] = max(shares.get(t, 0), share)
    labels = base | {licenses.NOTICES[t].label for t in shares}
    return ",".join(sorted(labels)), 1.0 if base else max(shares.values(), default=0.0)


def test_labels_and_scores_equal_a_plain_version(spark, small):
    r = random.Random(12)
    texts = []
    for n in licenses.NOTICES:
        w = n.text.split()
        for _ in range(12):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(v))
                if r.random() < 0.5:
                    v[at] = "zzz"
                else:
                    v[at:at] = ["zzz"] * r.randint(1, 4)
            other = r.choice(licenses.NOTICES).text.split()
            texts.append(" ".join(r.choice([v, v + other, other[:5] + v + v[3:9] * 3, v[: len(v) // 2] + other + v[len(v) // 2 :]])))
    texts += ["this program is " * 14, "free software you " * 30 + licenses.NOTICES[6].text, " ".join(reversed(licenses.NOTICES[0].text.split()))]
    docs = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    known = {x.doc_id: x.text for x in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == len(known)
    wrong = [(known[x.doc_id][:200], x.labels, x.score, plain_scan(known[x.doc_id])) for x in got if (x.labels, round(x.score, 9)) != (lambda a: (a[0], round(a[1], 9)))(plain_scan(known[x.doc_id]))]
    assert wrong == []
    assert sum(x.doc_id >= 100_000 and 0 < x.score < 1 for x in got) > 10 and sum(x.doc_id >= 100_000 and not x.labels for x in got) > 10


def test_words_are_hashed_alike_in_any_batch():
    h = words.WordHasher(letters=False)
    one = [h.words([t.encode()])[0].tolist() for t in ("A bc", "d  é f", "", "a")]
    every, of, n = h.words([t.encode() for t in ("A bc", "d  é f", "", "a")])
    assert sum(one, []) == every.tolist() and n.tolist() == [2, 3, 0, 1] and of.tolist() == [0, 0, 1, 1, 1, 3]
