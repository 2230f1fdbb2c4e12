"""URL rules by a sort-merge range join (operator 1)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm._common import pick, shuffle_partitions

#: Keys sampled to set the borders of the ranges; the bound is on the sample, which only balances work.
SAMPLE_KEYS = 20_000


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Canonical key: labels from last to first, each ended by NUL, so a domain's hosts are one interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0"))


def _key(host: str) -> bytes:
    return ("\0".join(reversed(host.split("."))) + "\0").encode()


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict``.

    ``rules`` has string columns ``action, host, path``.  A rule fits its host and all subdomains
    where the path starts with the rule's; the longest (host and path together) wins, then the
    longer host, then block.  Without a fitting rule ``rule`` is null and ``verdict`` the default.

    Keys of reversed hosts turn rules into nested intervals.  Both sides are cut into ranges at
    sampled borders (a rule goes to each range that it meets; a hot key that fills several ranges
    is dealt over them by row), sorted, and swept with a stack of the rules active at a key.

    A null url, or one without ``://``, has empty host and path and gets the default; a null id
    stays null; repeated rows are judged each; rules with a null host or action are ignored, a
    null path is the empty one; an empty table gives an empty result; other columns are left behind.
    """
    spark = pages.sparkSession
    rows = pick(pages, id=id_col, url=url_col).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")).cast("binary"))
    ranges = shuffle_partitions(spark)
    total = max(1, pages.count())
    share = min(1.0, SAMPLE_KEYS / total)
    sampled = sorted(bytes(r[0]) for r in rows.select("key").sample(share, seed=7).limit(2 * SAMPLE_KEYS).collect())
    borders = [sampled[len(sampled) * i // ranges] for i in range(1, ranges)] if sampled else []

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            parts = []
            for key in b.column("key").to_pylist():
                lo, hi = bisect_left(borders, key), bisect_right(borders, key)
                turn += 1
                parts.append(lo + 1 + turn % (hi - lo) if hi > lo + 1 else hi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int32())], [*b.schema.names, "part"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, keys, ends, parts = [], [], [], []
            for i, host in enumerate(b.column("host").to_pylist()):
                lo = _key(host)
                end = lo[:-1] + b"\1"
                for p in range(bisect_left(borders, lo), bisect_right(borders, end) + 1):
                    of.append(i)
                    keys.append(lo)
                    ends.append(end)
                    parts.append(p)
            own = b.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, pa.binary()), pa.array(ends, pa.binary()), pa.array(parts, pa.int32())], [*b.schema.names, "key", "upto", "part"])

    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema, T.StructField("part", T.IntegerType())]))
    known = rules.select("action", "host", F.coalesce("path", F.lit("")).alias("path")).where("action is not null and host is not null")
    wide = T.StructType([*known.schema, T.StructField("key", T.BinaryType()), T.StructField("upto", T.BinaryType()), T.StructField("part", T.IntegerType())])
    both = dealt.unionByName(known.mapInArrow(spread, wide), allowMissingColumns=True)
    laid = both.repartition(ranges, "part").sortWithinPartitions("part", "key", F.col("upto").isNull())
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, str, dict[str, str]]] = []  # end of the interval, host, actions by path
        at = None
        for b in batches:
            of, rule_of, verdicts = [], [], []
            cols = [b.column(n).to_pylist() for n in ("part", "key", "upto", "host", "path", "action")]
            for i, (part, key, upto, host, path, action) in enumerate(zip(*cols)):
                if part != at:
                    stack.clear()
                    at = part
                while stack and stack[-1][0] <= key:
                    stack.pop()
                if upto is not None:
                    if not stack or stack[-1][1] != host:
                        stack.append((upto, host, {}))
                    old = stack[-1][2].get(path)
                    stack[-1][2][path] = "block" if old == "block" else action
                    continue
                best = None
                for _, rule_host, paths in stack:
                    if host == rule_host or host.endswith("." + rule_host):
                        for length in sorted({len(p) for p in paths}, reverse=True):
                            if (head := path[:length]) in paths and len(head) == length:
                                found = (len(rule_host) + length, len(rule_host), rule_host + head, paths[head])
                                best = max(best, found) if best else found
                                break
                of.append(i)
                rule_of.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            own = b.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("host"), own.column("path"), pa.array(rule_of, pa.string()), pa.array(verdicts, pa.string())], schema.names)

    return laid.mapInArrow(sweep, schema)


def rule_table(spark, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
