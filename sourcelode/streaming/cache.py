"""Incremental analysis of a set of files: what changed, what depends on it, which results still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import reachable


def content_hash(files: DataFrame) -> DataFrame:
    """path and sha256 of content."""
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change: added, removed, changed or same, from two tables of path and sha256."""
    j = after.select("path", F.col("sha256").alias("now")).join(before.select("path", F.col("sha256").alias("was")), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return j.select("path", kind.alias("change"))


def invalidated(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """node: what changed and everything that imports it, directly or not. imports: src imports dst."""
    return reachable(imports.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed.select(F.col("path").alias("node")))


def reusable(results: DataFrame, stale: DataFrame) -> DataFrame:
    """Cached results (path, ...) of files that are not stale."""
    return results.join(stale.select(F.col("node").alias("path")), "path", "left_anti")


def lookup(keys: DataFrame, cache: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """path, state (hit, stale, miss) and result: an entry (path, sha256, stored, result) of the same content counts, and is stale past its time to live but still returned."""
    found = keys.join(cache.select("path", "sha256", "stored", "result"), ["path", "sha256"], "left")
    age = F.lit(now).cast("timestamp").cast("double") - F.col("stored").cast("timestamp").cast("double")
    state = F.when(F.col("stored").isNull(), "miss").when(age > ttl_seconds, "stale").otherwise("hit")
    return found.select("path", state.alias("state"), "result")


def compact(cache: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """The entries whose time to live is not over."""
    return cache.where(F.lit(now).cast("timestamp").cast("double") - F.col("stored").cast("timestamp").cast("double") <= ttl_seconds)


def evict(cache: DataFrame, entries: int | None = None, size: int | None = None, used: str = "used", bytes_: str = "size") -> DataFrame:
    """The entries that stay: the most recently used `entries` ones, and of these as many as fit into `size` in that order. Ties by path.

    Ranks come from counts by second of use, so no window holds the whole cache.
    """
    second = F.col(used).cast("timestamp").cast("long")
    rows, out = cache.withColumn("_s", second), cache
    for most, weight in ((entries, F.lit(1)), (size, F.col(bytes_))):
        if most is None:
            continue
        rows = out.withColumn("_s", second).withColumn("_w", weight.cast("long"))
        before = rows.groupBy("_s").agg(F.sum("_w").alias("_t"))
        upto = F.sum("_t").over(Window.orderBy(F.desc("_s")))  # a row per second of use
        before = before.select("_s", (upto - F.col("_t")).alias("_before")).where(F.col("_before") < most)
        inside = F.sum("_w").over(Window.partitionBy("_s").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
        out = rows.join(before, "_s").withColumn("_in", inside).where(F.col("_before") + F.col("_in") <= most).drop("_s", "_w", "_before", "_in")
    return out


def update(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh entries in place of the old ones of their paths."""
    return cache.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def counters(lookups: DataFrame) -> DataFrame:
    """One row: requests, hits (stale ones apart), stale, misses, hit rate (0 without requests) and distinct paths."""
    count = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0))
    out = lookups.agg(F.count(F.lit(1)).alias("requests"), count("hit").alias("hits"), count("stale").alias("stale"), count("miss").alias("misses"), F.countDistinct("path").alias("paths"))
    return out.withColumn("hit_rate", F.when(F.col("requests") == 0, 0.0).otherwise(F.col("hits") / F.col("requests")))
