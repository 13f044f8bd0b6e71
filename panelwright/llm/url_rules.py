"""Block and allow rules for URLs as a sort-merge range join, from SQL functions only.

A host is turned round by its labels (``m.example.net`` to ``net.example.m.``),
so a rule covers one interval of the sorted keys, and intervals of different
rules are nested or apart.  Sorted by key, the rules in force at a place are the
last rule before it and the rules that rule lies in, as far as they are prefixes
of the place: a stack.  One sweep finds the rule hosts in force at each URL, a
second one, over (rule host, path), the longest path of each such host.

Rows are placed in range blocks of equal size, so a host with a third of all
URLs spans many blocks; one row per block carries the stack on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import frozen

#: Rules whose stacks one task builds in one array.
RULE_BLOCK = 256
_NONE = "array<string>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty if null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _prefixes(stack: Column, key: Column) -> Column:
    return F.filter(stack, lambda rule: F.startswith(key, rule))


def rule_stacks(keys: DataFrame) -> DataFrame:
    """Each distinct ``key`` with ``stack``: the keys that are its prefixes, shortest first, and itself."""
    keys = frozen(keys.select("key").distinct())
    blocks = max(1, math.ceil(keys.count() / RULE_BLOCK))
    placed = frozen(keys.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()))

    def push(state: Column, key: Column) -> Column:
        stack = F.concat(_prefixes(state["stack"], key), F.array(key))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(stack)).alias("out"))

    start = F.struct(F.array().cast(_NONE).alias("stack"), F.array().cast(f"array<{_NONE}>").alias("out"))
    local = placed.groupBy("block").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn(
        "stacks", F.aggregate("keys", start, push, lambda s: s["out"])
    )
    # One row per block: the stack that is in force where the block begins.
    ends = local.select(F.struct(
        "block", F.get("keys", F.lit(0)).alias("first"), F.element_at("keys", -1).alias("last"),
        F.element_at("stacks", -1).alias("stack"),
    ).alias("end"))

    def carry(state: Column, end: Column) -> Column:
        comes = _prefixes(state["stack"], end["first"])
        goes = F.concat(_prefixes(comes, end["last"]), end["stack"])
        row = F.struct(end["block"].alias("block"), comes.alias("comes"))
        return F.struct(goes.alias("stack"), F.concat(state["out"], F.array(row)).alias("out"))

    begin = F.struct(
        F.array().cast(_NONE).alias("stack"), F.array().cast(f"array<struct<block:int,comes:{_NONE}>>").alias("out")
    )
    comes = ends.agg(F.sort_array(F.collect_list("end")).alias("ends")).select(
        F.inline(F.aggregate("ends", begin, carry, lambda s: s["out"]))
    )
    return local.join(comes, "block").select("comes", F.explode("stacks").alias("local")).select(
        F.element_at("local", -1).alias("key"),
        F.concat(_prefixes(F.col("comes"), F.element_at("local", -1)), "local").alias("stack"),
    )


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` with ``active``: the rule keys that are prefixes of ``key``, shortest first.

    Points are placed with the rules in sorted blocks; inside a block a window
    hands each point the stack of the last rule before it.
    """
    columns = points.columns
    events = points.withColumn("_point", F.lit(1)).unionByName(
        rule_stacks(rules).withColumn("_point", F.lit(0)), allowMissingColumns=True
    )
    spread = F.xxhash64(*[F.col(c) for c in columns if c != "key"])
    placed = frozen(
        events.repartitionByRange("key", "_point", spread).withColumn("_block", F.spark_partition_id())
    )
    last = placed.groupBy("_block").agg(F.max_by("stack", F.when(F.col("_point") == 0, F.col("key"))).alias("end"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("_block", F.last("end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy("_block").orderBy("key", "_point").rowsBetween(W.unboundedPreceding, 0)
    # One row per block, and so bounded by the number of tasks.
    seen = placed.withColumn("_last", F.last("stack", ignorenulls=True).over(inside)).join(F.broadcast(carried), "_block")
    stack = F.coalesce("_last", "_carried", F.array().cast(_NONE))
    return seen.where("_point = 1").select(*columns, _prefixes(stack, F.col("key")).alias("active"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
) -> DataFrame:
    """Every URL with host, path, the rule that decides (or null) and its verdict (or ``default``).

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and
    all subdomains if the path begins with the rule's; the longest host wins,
    then the longest path.  Of rules with the same host and path the verdict
    that sorts last counts; rules with a null part are not rules.  A null URL,
    or one without ``://``, has an empty host and path.  Repeated pages stay
    rows of their own; columns beside ``key`` and ``url`` are not looked at.
    """
    rules = rules.where(F.expr("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    end = F.lit("\0")  # in no host
    rules = frozen(rules.select(
        F.concat("host", "path").alias("rule"), "verdict", host_key(F.col("host")).alias("host_key"),
        F.concat(host_key(F.col("host")), end, "path").alias("path_key"),
    ))
    host, path = split_url(F.col("url"))
    points = pages.select(F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url")).select(
        "page", host.alias("host"), path.alias("path")
    ).withColumn("key", host_key(F.col("host")))
    rows = frozen(
        sweep(points, rules.select(F.col("host_key").alias("key"))).drop("key")
        .withColumn("row", F.monotonically_increasing_id())
    )
    below = rows.select("row", "path", F.explode("active").alias("level")).select(
        "row", F.length("level").alias("depth"), F.concat("level", end, "path").alias("key")
    )
    hits = sweep(below, rules.select(F.col("path_key").alias("key"))).where(F.size("active") > 0)
    best = hits.groupBy("row").agg(
        F.max(F.struct("depth", F.element_at("active", -1).alias("path_key")))["path_key"].alias("path_key")
    )
    named = best.join(rules.select("path_key", "rule", "verdict"), "path_key").drop("path_key")
    return rows.join(named, "row", "left").select(
        F.col("page").alias(key), "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
