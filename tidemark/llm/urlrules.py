"""URL filter rules as a sort-merge range join, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Keys looked at per block to place the blocks' bounds.
SAMPLE_PER_BLOCK = 40


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, a slash and the path: a host and path prefix is an interval of keys.

    No host has a slash, so keys of different hosts never share more than their labels.
    """
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def literal_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path) triples."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                     for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def _nested(rules: DataFrame) -> DataFrame:
    """(key, stack) of every rule key: the stack has it and all rules around it, innermost first.

    A rule around another one is a prefix of its key: every prefix is looked up.
    """
    path = F.coalesce(rules["path"], F.lit(""))
    host = F.translate(F.coalesce(rules["host"], F.lit("")), UPPER, LOWER)
    strict = F.when(F.lower(rules["verdict"]) == "block", 1).otherwise(0)
    own = (rules.where(rules["verdict"].isNotNull())
           .select(_key(_labels(host), path).alias("key"), F.concat(host, path).alias("rule"),
                   F.length(host).alias("host_size"), strict.alias("strict"))
           # Of contradicting rules on one key the blocking one counts.
           .groupBy("key", "rule", "host_size").agg(F.max("strict").alias("strict")))
    prefixes = own.select(F.col("key").alias("inner"), F.explode(F.transform(
        F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    around = prefixes.join(own, "key")
    return around.groupBy("inner").agg(F.reverse(F.array_sort(F.collect_list(
        F.struct(F.length("key").alias("size"), "key", "rule", "host_size", "strict")))).alias("stack")).select(
            F.col("inner").alias("key"), "stack")


def _bounds(keys: DataFrame, blocks: int) -> list[str]:
    """Keys that cut the sorted keys into blocks of similar size; at most ``blocks`` of them.

    Looks at a hash sample whose size follows ``blocks`` alone. Bounds only spread
    the work; the result does not depend on them.
    """
    rows = keys.count()
    step = max(1, rows // max(1, blocks * SAMPLE_PER_BLOCK))
    seen = sorted(r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").collect())
    if not seen:
        return []
    return sorted({seen[len(seen) * i // blocks] for i in range(1, blocks)})


def _block(key: Column, bounds: list[str]) -> Column:
    """Number of bounds up to the key, by two short comparisons of lists."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= key))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + F.size(F.filter(inner, lambda b: b <= key)))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    ``rules`` has (host, path, verdict); a rule fits its host and all subdomains if
    the url's path starts with the rule's. The longest fitting rule (host and path
    together, then the longer host, then blocking) decides; without one the verdict
    is ``default`` and rule is null. A null url, or one without ``://``, has an empty
    host and path. Rules with a null verdict do not count, null hosts and paths are
    empty. Repeated rows are all returned, null ids kept, other columns ignored.

    Every distinct (host, path) is swept once for each of its domain suffixes. Rules
    and keys are cut into blocks of the sorted key space; in a block the last rule
    that starts at or before a key has on its stack all rules around the key. The
    last rule before a block is carried into it.
    """
    spark = pages.sparkSession
    urls = pages.select(pages["page_id"].alias("page_id"), url_host(pages["url"]).alias("host"),
                        url_path(pages["url"]).alias("path"))
    targets = urls.select("host", "path").distinct()
    labels = F.col("labels")
    keys = written(
        targets.withColumn("labels", _labels(F.col("host")))
        .select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                                      lambda n: _key(F.slice(labels, 1, n), F.col("path")))).alias("key")),
        "urls")
    bounds = _bounds(keys, shuffle_partitions(spark))
    nested = written(_nested(rules), "rules")
    starts = nested.select(_block(F.col("key"), bounds).alias("block"), "key", "stack")
    last = starts.groupBy("block").agg(F.max_by("stack", "key").alias("stack"))
    blocks = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("block"))
    # As many rows as blocks.
    carried = blocks.join(last, "block", "left").select(
        "block", F.lit("").alias("key"), F.last("stack", ignorenulls=True).over(
            Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("stack")).where("stack is not null")
    none = F.lit(None).cast("string")
    rule_rows = starts.union(carried).select("block", "key", F.lit(0).alias("kind"), none.alias("host"),
                                             none.alias("path"), "stack")
    url_rows = keys.select(_block(F.col("key"), bounds).alias("block"), "key", F.lit(1).alias("kind"), "host", "path",
                           F.lit(None).cast(nested.schema["stack"].dataType).alias("stack"))
    sweep = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = rule_rows.union(url_rows).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
    fitting = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    hit = F.element_at(fitting, 1)
    judged = (swept.where("kind = 1 and stack is not null").where(F.size(fitting) > 0)
              .select("host", "path", hit.alias("hit"))
              .groupBy("host", "path").agg(F.max(F.struct(
                  F.length("hit.rule").alias("size"), F.col("hit.host_size").alias("host_size"), F.col("hit.strict").alias("strict"),
                  F.col("hit.rule").alias("rule"))).alias("best"))
              .select("host", "path", "best.rule", F.col("best.strict").alias("strict")))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(F.col("strict") == 1, "block").otherwise("allow")
    return urls.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
