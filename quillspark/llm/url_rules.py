"""Allow and block rules on url prefixes, by a sorted sweep over reversed-host keys.

The key of a host is its labels in reverse order, each followed by U+0001 (`www.example.net` becomes
`net.example.www.` with U+0001 for the dots), so a host and all its subdomains are one interval of keys
and rules nest like brackets; under a host, paths nest the same way. Pages are range-partitioned by (key, page_id), which also spreads a host
with many pages, every rule is copied to the partitions its interval meets, and each partition is
swept once in key order with a stack of the rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

SEP, ESCAPE = "\x01", "\x02"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by SEP. A U+0001 or U+0002 of a host is written as two other characters, so no label holds SEP and keys are prefixes of each other only where labels are."""
    safe = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(SEP), F.lit(ESCAPE + "a"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), SEP), F.lit(SEP))


class HostRules:
    """The rules of one host, added in the order of their paths. Each knows the longest rule before it whose path begins its own."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.outer = key, [], [], []

    def add(self, path: str, name: str, verdict: str) -> None:
        i = len(self.paths) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        self.paths.append(path)
        self.rules.append((name, verdict))
        self.outer.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        """The rule of the longest path that begins this one: the last path not after it in order, or one of those that path is nested in."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.rules[i] if i >= 0 else None


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in (part, key, kind, path) order, rules (kind 0) before the pages (kind 1) they may cover.

    The stack holds the hosts whose interval of keys is open, each key a prefix of the next. A page asks every one of them for
    its longest path by bisection, so a page costs the host's labels times the logarithm of the rules.
    """
    stack: list[HostRules] = []
    for b in batches:
        rule, verdict = [], []
        for kind, key, path, name, v in zip(b["kind"], b["key"], b["path"], b["rule"], b["verdict"]):
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(HostRules(key))
                stack[-1].add(path, name, v)
                continue
            best = max((r for h in stack if (r := h.longest(path))), key=lambda r: (len(r[0]), r[0]), default=None)
            rule.append(best and best[0])
            verdict.append(best and best[1])
        pages = b[b["kind"] == 1]
        yield pd.DataFrame({"page_id": pages["page_id"], "host": pages["host"], "path": pages["path"], "rule": rule, "verdict": verdict})


def _copies(lows: list[str], highs: list[str], parts: list[int]):
    """Each rule once for every partition that its interval of keys meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            meets = [parts[bisect_left(highs, k) : bisect_right(lows, k + "\U0010ffff")] for k in b["key"]]
            yield b.assign(part=meets).explode("part").dropna(subset="part").astype({"part": "int32"})[["part", "key", "path", "rule", "verdict"]]

    return run


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow", partitions: int | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (host + path of the winner, else null), verdict.

    rules: (host, path, verdict) rows, as a table of any length or a list. A rule fits its host and all subdomains where the url's path
    starts with the rule's path; of those that fit, the longest host + path wins, on equal length the
    one later in order, of rules repeated with other verdicts the greatest verdict. Rules with a null host or path fit nothing. A url with an
    empty path therefore fits no rule whose path is `/`. Null urls and
    urls without `://` have empty host and path. Repeated rows stay; extra columns have no effect; an empty
    table of pages gives an empty result, one of rules the default for every page.
    """
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url")
    dealt = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", host_key(F.col("host")))
    dealt = materialise(dealt.repartitionByRange(n, "key", "page_id").withColumn("part", F.spark_partition_id()), "urls")
    bounds = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min("key"), F.max("key")).collect())  # one row per partition, in key order
    parts, lows, highs = ([x[i] for x in bounds] for i in range(3))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    held = rules.where("host is not null and path is not null").select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    held = held.groupBy("key", "path", "rule").agg(F.max("verdict").alias("verdict"))
    held = held.select("key", "path", "rule", "verdict").mapInPandas(_copies(lows, highs, parts), "part int, key string, path string, rule string, verdict string")
    nothing = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    kind = dealt.schema["page_id"].dataType.simpleString()
    rows = dealt.select("part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", nothing("rule"), nothing("verdict"))
    rows = rows.unionByName(held.select("part", "key", F.lit(0).alias("kind"), nothing("page_id", kind), nothing("host"), "path", "rule", "verdict"))
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")
    swept = rows.mapInPandas(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
