"""Versions, and the comparison of two versions of an interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH, MINOR, MAJOR = 0, 1, 2
BUMPS = ("patch", "minor", "major")


def parse_version(text: Column) -> Column:
    """major, minor, patch of 'a', 'a.b' or 'a.b.c' with an optional v in front; null for anything else."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?$", i), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(r"^v?\d+(\.\d+)?(\.\d+)?$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where either is no version."""
    x, y = parse_version(a), parse_version(b)
    return F.when(x < y, -1).when(x > y, 1).when(x.isNotNull() & y.isNotNull(), 0)


def compare_symbols(before: DataFrame, after: DataFrame, key: str = "symbol", signature: str = "signature") -> DataFrame:
    """symbol, change (removed, added, changed), before, after and bump: removed and changed symbols break, added ones are minor.

    Symbols that stay as they are give no row; null signatures are equal to each other.
    """
    b = before.select(F.col(key).alias("symbol"), F.col(signature).alias("before"), F.lit(True).alias("_b"))
    a = after.select(F.col(key).alias("symbol"), F.col(signature).alias("after"), F.lit(True).alias("_a"))
    j = b.join(a, "symbol", "full_outer")
    change = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = j.withColumn("change", change).where(F.col("change").isNotNull())
    return out.select("symbol", "change", "before", "after", F.when(F.col("change") == "added", MINOR).otherwise(MAJOR).alias("bump"))


def summarize_changes(changes: DataFrame) -> DataFrame:
    """One row: breaking, additions, other, and the version bump they call for (patch without changes)."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    bump = F.get(F.array(*map(F.lit, BUMPS)), F.coalesce(F.max("bump"), F.lit(PATCH)))
    added, breaks = F.col("change") == "added", F.col("bump") == MAJOR
    return changes.agg(count(breaks).alias("breaking"), count(added).alias("additions"), count(~added & ~breaks).alias("other"), bump.alias("bump"))


def validate_version(old: Column, new: Column, bump: Column) -> Column:
    """Whether new is at least the version that bump (0 to 2) asks for after old; null where either is no version."""
    x, y = parse_version(old), parse_version(new)
    n = lambda v, part: v.getField(part)
    least = F.when(bump >= MAJOR, F.struct((n(x, "major") + 1).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch")))
    least = least.when(bump == MINOR, F.struct(n(x, "major").alias("major"), (n(x, "minor") + 1).alias("minor"), F.lit(0).alias("patch")))
    least = least.otherwise(F.struct(n(x, "major").alias("major"), n(x, "minor").alias("minor"), (n(x, "patch") + 1).alias("patch")))
    return F.when(x.isNotNull() & y.isNotNull(), y >= least)
