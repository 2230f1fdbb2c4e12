"""Personal data: base patterns, and candidates judged by boosted trees (operator 7).

All of it is DataFrame and SQL functions on one row; nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm._common import named_again, numbered
from loomgrid.llm.pii_model import CONTEXT, FEATURES, KINDS, Boosted, train

BASE_KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Possessive quantifiers and looks behind take nothing from what
#: matches; they keep long runs from being tried at each of their places, and from deep recursion.
#: An address may start where the last match ended (\G), for that may be inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap look for what every match of a pattern holds.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: High-recall generators: kind, hint, pattern.  A secret has no longest length; segments behind
#: dots are part of it, as in signed web tokens.
GENERATORS = (
    ("secret", r"[A-Za-z0-9_+/-]{24}", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}+(?:\.[A-Za-z0-9_+/-]{8,}+)*+"),
    ("phone", r"[0-9]{3}", r"(?<![0-9+.(])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("ssn", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("email", r"(?i)\bdot\b", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(]?\bat\b[\])]?\x20?[A-Za-z0-9-]{1,63}+\x20?[\[(]?\bdot\b[\])]?\x20?[A-Za-z]{2,24}+"),
)
_CHUNK = 64


def _starts(lengths: Column) -> Column:
    """For each entry the sum of those before it.

    Arrays only grow by copies, so sums run within chunks and then over the chunks.
    """
    zero = F.array(F.lit(0).cast("long"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)).cast("int"), F.lit(_CHUNK)), lambda c: F.slice(lengths, c + 1, _CHUNK))
    sums = F.transform(chunks, lambda ch: F.aggregate(ch, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
    empty = F.array(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0).cast("long").alias("base"), F.slice(empty, 1, 0).alias("out"))

    def add(acc: Column, ch: Column) -> Column:
        moved = F.transform(F.slice(ch, 1, F.size(ch) - 1), lambda y: y + acc.base)
        return F.struct((acc.base + F.element_at(ch, -1)).alias("base"), F.concat(acc.out, F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(sums, start, add, lambda acc: acc.out))


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All leftmost, non-overlapping matches: array of ``start, end, value, before``.

    What splitting at the matches leaves gives their places, in code points.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string>>"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))

    def placed(pairs: Column) -> Column:
        at = _starts(F.transform(pairs, lambda p: (F.length(p.gap) + F.length(p.value)).cast("long")))
        return F.zip_with(
            pairs, at,
            lambda p, s: F.struct((s + F.length(p.gap)).alias("start"), (s + F.length(p.gap) + F.length(p.value)).alias("end"), p.value.alias("value"), F.right(p.gap, F.lit(CONTEXT)).alias("before")),
        )

    # an array of one lets the pairs be made once and used by name
    whole = F.flatten(F.transform(F.array(pairs), placed))
    return F.when(text.rlike(hint), whole.cast(kind)).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum, every second digit from the right doubled, divides by ten."""
    turned = F.reverse(digits)
    def part(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + part(i))
    return total % 10 == 0


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: F.length(_digits(m.value)).between(14, 19) & F.when(F.length(_digits(m.value)).between(14, 19), _luhn(_digits(m.value))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m.value)).between(10, 15),
}


def probability(kind: int, model: Boosted) -> str:
    """SQL for the calibrated probability of candidate ``m``: the trees as CASE expressions over
    its features, which stand in an array of one so that each is found once."""
    got = [f"{float(kind)}D"]
    got += [f"IF(rlike(m.{'value' if where == 'value' else 'before'}, r'{x}'), 1D, 0D)" for _, where, x in FEATURES]
    got += ["double(length(m.value))", "double(length(regexp_replace(m.value, '[^0-9]', '')))"]
    below = lambda s: "true" if s[1] == float("inf") else f"x[{s[0]}] <= {s[1]}D"
    trees = [f"IF({below(top)}, IF({below(low)}, {a}D, {b}D), IF({below(high)}, {c}D, {d}D))" for (top, low, high), (a, b, c, d) in ((t.splits, t.leaves) for t in model.trees)]
    total = " + ".join([f"{model.start!r}D", *trees])
    return f"transform(array(array({', '.join(got)})), x -> 1D / (1D + exp(-({model.slope}D * ({total}) + {model.offset}D))))[0]"


def _spanned(rank: int, kind: str, score: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.struct(m.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.end.alias("end"), score(m).alias("score"))


_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def find(docs: DataFrame, model: Boosted | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Find personal data in every whole text: ``doc_id, base, added`` and the columns of ``keep``.

    ``base`` has the valid matches of the base patterns, ``added`` what the trees select of the
    generators' candidates; both are arrays of ``start, rank, kind, end, score`` in code points,
    sorted by start, then kind.  Candidates that meet a base span give way to it; of candidates
    that overlap, the likelier stays, then the earlier one.  A null or empty text has no spans; a
    null id stays null; repeated rows are taken each; an empty table gives an empty result.
    """
    model = model or train()
    keep = tuple(c for c in keep if c not in (id_col, "base", "added"))
    rows = docs.select(docs[id_col].alias("_find_id"), F.coalesce(docs[text_col], F.lit("")).alias("_find_text"), *[docs[c].alias(f"_keep_{c}") for c in keep])
    text = F.col("_find_text")
    base = []
    for rank, kind in enumerate(BASE_KINDS):
        valid = F.filter(matches(text, PATTERNS[kind], HINTS[kind]), VALID[kind])
        base.append(F.transform(valid, _spanned(rank, kind, lambda m: F.lit(1.0))))
    proposed = []
    ranks = {k: i for i, k in enumerate((*BASE_KINDS, *sorted(set(KINDS) - set(BASE_KINDS))))}
    for code, (kind, _, _) in enumerate(GENERATORS):
        judged = f"transform(_made_{code}, m -> named_struct('start', m.start, 'rank', {ranks[kind]}, 'kind', '{kind}', 'end', m.`end`, 'score', {probability(code, model)}))"
        proposed.append(F.expr(f"filter({judged}, c -> c.score >= {model.thresholds[code]}D)"))
    rows = rows.withColumns({f"_made_{code}": matches(text, pattern, hint) for code, (_, hint, pattern) in enumerate(GENERATORS)})
    out = rows.withColumns({"__base": F.array_sort(F.concat(*base).cast(_SPAN)), "__some": F.array_sort(F.concat(*proposed).cast(_SPAN))})
    meets = lambda a, b: (a.start < b.end) & (b.start < a.end)
    free = F.filter("__some", lambda c: ~F.exists("__base", lambda b: meets(b, c)))
    out = out.withColumn("__free", F.when(F.size("__some") > 0, free).otherwise(F.col("__some")))
    better = lambda o, c: (o.score > c.score) | ((o.score == c.score) & ((o.start < c.start) | ((o.start == c.start) & (o.rank < c.rank))))
    best = F.filter("__free", lambda c: ~F.exists("__free", lambda o: meets(o, c) & better(o, c)))
    out = out.withColumn("__added", F.when(F.size("__free") > 1, best).otherwise(F.col("__free")))
    return out.select(F.col("_find_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("__base").alias("base"), F.col("__added").alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; overlapping spans become one,
    named for the first.  ``length_col``, if given, becomes the new text's length.  Other columns
    stay as they are, texts without spans too, and null texts stay null.
    """
    own, at = numbered(docs), {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    text_col, length_col = at[text_col], length_col and at[length_col]
    found = find(own, id_col=at[id_col], text_col=text_col, keep=tuple(c for c in own.columns if c != at[id_col]))
    state = "struct<upto:bigint,parts:array<struct<start:bigint,end:bigint,kind:string>>>"
    spans = F.array_sort(F.concat("base", "added"))

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc.parts, F.lit(-1))
        grown = F.concat(F.slice(acc.parts, 1, F.size(acc.parts) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"), last.kind.alias("kind"))))
        fresh = F.concat(acc.parts, F.array(F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
        return F.struct(F.greatest(acc.upto, s.end).alias("upto"), F.when(s.start < acc.upto, grown).otherwise(fresh).alias("parts")).cast(state)

    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().alias("parts")).cast(state)
    parts = F.aggregate(spans, start, add, lambda acc: acc.parts)
    text = F.col(text_col)

    def piece(p: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("__parts"), i - 1).end)
        return F.concat(F.substring(text, (begin + 1).cast("int"), (p.start - begin).cast("int")), F.lit("<"), F.upper(p.kind), F.lit(">"))

    out = found.withColumn("__parts", parts)
    rest = F.substring(text, (F.element_at("__parts", -1).end + 1).cast("int"), F.length(text))
    new = F.when(F.size("__parts") > 0, F.concat(F.array_join(F.transform("__parts", piece), ""), rest)).otherwise(text)
    out = out.withColumn(text_col, new)
    if length_col:
        out = out.withColumn(length_col, F.when(F.size("__parts") > 0, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return named_again(out, docs)
