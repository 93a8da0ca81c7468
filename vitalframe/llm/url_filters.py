"""URL filters by a sort-merge range join of reversed-host keys.

A rule (host, path) becomes the key `com.example//en/`: the first slash ends the host, so that a rule covers whole labels
only. It covers the interval of all keys that begin with it. A URL becomes one key for each suffix of its host
(`com//en/1`, `com.example//en/1`, ...), as a rule covers all subdomains. Keys and rules are cut into the same ranges, sorted, and swept once with a
stack of the rules that are still open; the top of the stack is the longest rule on that host suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of the bounded sample from which range borders are taken, keys of a range, and the most ranges.
SAMPLE_KEYS, RANGE_KEYS, MAX_RANGES = 20_000, 100_000, 512

_SUFFIX_KEYS = """
transform(sequence(1, size(labels)), k -> concat(array_join(slice(labels, 1, k), '.'), '/', path))
"""


def url_parts(url) -> tuple:
    """Columns (host, path) of a url column: both empty for null or without `://`."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over rows sorted by (part, key, kind, order): rules (kind 0) open, points (kind 1) ask.

    The stack holds the open rules, each a prefix of the next, so it is no deeper than a key is long.
    It is emptied where a new range begins and carried from batch to batch inside one.
    """
    part, stack = None, []
    for batch in batches:
        out_key, out_rule, out_verdict = [], [], []
        for p, key, kind, rule, verdict in zip(batch["part"], batch["key"], batch["kind"], batch["rule"], batch["verdict"], strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack:
                out_key.append(key)
                out_rule.append(stack[-1][1])
                out_verdict.append(stack[-1][2])
        yield pd.DataFrame({"key": out_key, "rule": out_rule, "verdict": out_verdict}, dtype="str")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int = 64) -> DataFrame:
    """Give each page (page_id, url) the longest rule that fits its url.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with
    its path; of several, the one with the longest text `host + path` wins, then the longest host, then
    the smaller verdict text. Returns page_id, host, path, rule (null if none fits), verdict (default
    if none fits). Null or odd urls have empty host and path and fit no rule; an empty rule path fits all paths;
    rules with a host that is null, empty or holds one of /?#, null path or null verdict are ignored; equal urls and equal page_ids are all kept; an empty
    table gives no rows, an empty rule table gives the default everywhere.

    Only distinct (host, path) pairs are swept, so a url that fills a third of the table is one point.
    There are `ranges` ranges, or more for more than RANGE_KEYS keys each. Their borders come from a bounded sample of the points; a rule is copied to each range that its
    interval meets, which adds no more than the open stack at each border.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    points = (
        urls.select("host", "path").filter("host <> ''").distinct()
        .withColumn("labels", F.reverse(F.split("host", r"\.", -1)))
        .select("host", "path", F.explode(F.expr(_SUFFIX_KEYS)).alias("key"))
    )
    keys = points.select("key").distinct()
    n = max(1, keys.count())
    seen = [r[0] for r in keys.filter(F.xxhash64("key").bitwiseAND(F.lit((1 << 30) - 1)) < int((1 << 30) * min(1.0, SAMPLE_KEYS / n))).toLocalIterator()]
    seen.sort()
    count = min(MAX_RANGES, max(ranges, n // RANGE_KEYS), max(1, len(seen)))
    borders = sorted({seen[len(seen) * i // count] for i in range(1, count)})
    border_array = F.array(*[F.lit(b) for b in borders]) if borders else F.expr("cast(array() as array<string>)")
    part = lambda k: F.size(F.filter(border_array, lambda b: b <= k))
    lowered = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ruled = (
        rules.filter("host rlike '^[^/?#]+$' and path is not null and verdict is not null")
        .select(F.concat(F.array_join(F.reverse(F.split(lowered, r"\.", -1)), "."), F.lit("/"), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
        .groupBy("key").agg(F.min(F.struct("verdict", "rule")).alias("x")).select("key", "x.rule", "x.verdict")
    )
    spread = ruled.withColumn("part", F.explode(F.sequence(part(F.col("key")), part(F.concat("key", F.lit("\U0010ffff"))))))
    both = keys.select(part(F.col("key")).alias("part"), "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    both = both.unionByName(spread.select("part", "key", F.lit(0).alias("kind"), "rule", "verdict"))
    sorted_ranges = both.repartition(len(borders) + 1, "part").sortWithinPartitions("part", "key", "kind")
    hits = sorted_ranges.mapInPandas(sweep, "key string, rule string, verdict string")
    best = (
        points.join(hits, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("key").alias("m"), "rule", "verdict")).alias("x"))
        .select("host", "path", "x.rule", "x.verdict")
    )
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
