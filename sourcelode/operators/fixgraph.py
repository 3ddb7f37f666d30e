"""Dependencies and order of fixes. fixes: file, fix, lo, hi (hi exclusive), text, rule, preferred, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

STRATEGIES = ("prefer_preferred", "prefer_severity", "prefer_smaller", "skip_all", "skip_second", "merge", "interactive")


def positional(fixes: DataFrame) -> DataFrame:
    """file, src, dst: src must wait for dst, the nearest fix of its file that ends at or before it and changes the length of the text.

    Fixes farther back follow through the chain of such fixes, so no pairs of a whole file are made.
    """
    grows = F.length("text") != F.col("hi") - F.col("lo")
    rows = fixes.select("file", "fix", "lo", "hi", grows.alias("grows"))
    events = rows.select("file", F.col("lo").alias("at"), F.lit(1).alias("order"), "fix", F.lit(None).cast(rows.schema["fix"].dataType).alias("ends"))
    events = events.unionByName(rows.where("grows").select("file", F.col("hi").alias("at"), F.lit(0).alias("order"), F.lit(None).cast(rows.schema["fix"].dataType).alias("fix"), F.col("fix").alias("ends")))
    before = F.last("ends", ignorenulls=True).over(Window.partitionBy("file").orderBy("at", "order", "ends").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("dst", before).where("fix IS NOT NULL AND dst IS NOT NULL AND dst <> fix").select("file", F.col("fix").alias("src"), "dst")


def identifiers(fixes: DataFrame, renames: DataFrame) -> DataFrame:
    """file, src, dst: the text of src holds, as a whole word, the old name of the rename dst of its file. renames: file, fix, old."""
    words = fixes.select("file", F.col("fix").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_']*)"), 1))).alias("old"))
    return words.join(renames.select("file", F.col("fix").alias("dst"), "old"), ["file", "old"]).where("src <> dst").select("file", "src", "dst").distinct()


def by_rules(fixes: DataFrame, needs: DataFrame) -> DataFrame:
    """file, src, dst: the rule of src needs the rule of dst, in one file. needs: rule, needs."""
    a = fixes.select("file", F.col("fix").alias("src"), "rule").join(needs, "rule")
    b = fixes.select("file", F.col("fix").alias("dst"), F.col("rule").alias("needs"))
    return a.join(b, ["file", "needs"]).where("src <> dst").select("file", "src", "dst").distinct()


def _loses(strategy: str, mine, other) -> Column:
    """Whether the first fix of a conflict loses."""
    preferred = other("preferred") > mine("preferred")
    if strategy in ("prefer_preferred", "merge"):
        return preferred
    if strategy == "prefer_severity":
        return preferred | ((other("preferred") == mine("preferred")) & (other("edits") > mine("edits")))
    if strategy == "prefer_smaller":
        return other("width") < mine("width")
    if strategy == "skip_second":
        return F.lit(False)
    raise ValueError(f"unknown strategy {strategy}; known are {', '.join(STRATEGIES)}")


def resolve(fixes: DataFrame, conflicts: DataFrame, strategy: str = "prefer_preferred") -> DataFrame:
    """fixes with the column apply. conflicts: file, fix1, fix2 with fix1 < fix2.

    prefer_preferred, merge: the preferred fix wins, else the first; prefer_severity: the same, then the one of more edits;
    prefer_smaller: the shorter one, else the first; skip_second: the first; skip_all: none; interactive: both stay.
    """
    facts = fixes.groupBy("file", "fix").agg(F.max(F.col("preferred").cast("int")).alias("preferred"), F.max("edits").alias("edits"), F.sum(F.col("hi") - F.col("lo")).alias("width"))
    if strategy == "interactive":
        return fixes.withColumn("apply", F.lit(True))
    pairs = conflicts.select("file", "fix1", "fix2").distinct()
    if strategy == "skip_all":
        losers = pairs.select("file", F.explode(F.array("fix1", "fix2")).alias("fix"))
    else:
        for i in (1, 2):
            pairs = pairs.join(facts.select("file", F.col("fix").alias(f"fix{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("preferred", "edits", "width")]), ["file", f"fix{i}"])
        first_loses = _loses(strategy, lambda c: F.col(f"{c}1"), lambda c: F.col(f"{c}2"))
        losers = pairs.select("file", F.when(first_loses, F.col("fix1")).otherwise(F.col("fix2")).alias("fix"))
    return fixes.join(losers.distinct().withColumn("_lost", F.lit(True)), ["file", "fix"], "left").withColumn("apply", F.col("_lost").isNull()).drop("_lost")


def apply_order(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """node and level in dependency order (needs: src after dst); nodes on a cycle, or after one, have level null."""
    if needs.isEmpty():
        return nodes.select("node").distinct().withColumn("level", F.lit(0))
    levels = graph.levels(needs)
    alone = nodes.select("node").distinct().join(needs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti")
    left = needs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(levels, "node", "left_anti")
    return levels.select("node", "level").unionByName(alone.withColumn("level", F.lit(0))).unionByName(left.withColumn("level", F.lit(None).cast("int")))


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    """kind, severity, file and n: conflicts by each of the three, the other two null."""
    return conflicts.groupingSets([["kind"], ["severity"], ["file"]], "kind", "severity", "file").agg(F.count(F.lit(1)).alias("n"))


def batch_stats(results: DataFrame) -> DataFrame:
    """One row of counters over files (status, applied, skipped, failed, iterations)."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("applied", "skipped", "failed")]
    return results.agg(F.count(F.lit(1)).alias("files"), count("modified"), count("unchanged"), count("error"), *sums, F.coalesce(F.max("iterations"), F.lit(0)).alias("iterations"))


SAFETY = ("safe", "mostly_safe", "needs_review", "unsafe", "manual_review")  # fixed values: the safest first


def ranked(fixes: DataFrame, by: str) -> DataFrame:
    """Fixes in order of confidence or priority (largest first), safety (safest first) or span; ties by file, place and fix."""
    safety = F.array_position(F.array(*map(F.lit, SAFETY)), F.col("safety")) if "safety" in fixes.columns else F.lit(0)
    order = {"confidence": [F.desc("confidence")], "priority": [F.desc("priority")], "safety": [F.when(safety == 0, len(SAFETY) + 1).otherwise(safety)], "span": []}[by]
    return fixes.orderBy(*order, "file", "lo", "hi", "fix")


class Pipeline:
    """Stages over fixes, each a function of a DataFrame, with a count of rows after each where asked for."""

    def __init__(self, *stages):
        self.stages = [s if isinstance(s, tuple) else (getattr(s, "__name__", str(i)), s) for i, s in enumerate(stages)]

    def __call__(self, fixes: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            fixes = stage(fixes)
        return fixes

    def with_stats(self, fixes: DataFrame) -> tuple[DataFrame, list[tuple[str, int, int]]]:
        """The result and, of each stage up to the first that leaves nothing, its name and the rows before and after."""
        stats, n = [], fixes.count()
        for name, stage in self.stages:
            if not n:
                break
            fixes = stage(fixes)
            before, n = n, fixes.count()
            stats.append((name, before, n))
        return fixes, stats

    @staticmethod
    def parallel(*pipelines) -> Pipeline:
        """The results of all pipelines together, repeated rows included."""
        from functools import reduce

        return Pipeline(("parallel", lambda d: reduce(DataFrame.unionByName, [p(d) for p in pipelines])))

    @staticmethod
    def conditional(test: Column, yes, no) -> Pipeline:
        """Rows for which test holds through yes, the others (null included) through no."""
        holds = F.coalesce(test, F.lit(False))
        return Pipeline(("conditional", lambda d: yes(d.where(holds)).unionByName(no(d.where(~holds)))))

    def retry(self, fixes: DataFrame, times: int) -> DataFrame:
        """Runs again while nothing comes out, at most `times` more times."""
        out = self(fixes)
        for _ in range(times):
            if not out.isEmpty():
                break
            out = self(fixes)
        return out
