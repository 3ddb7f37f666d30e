"""Reports over findings (file, rule, category, severity 0..3): scores, breakdowns, top lists and limits.

Every report is one aggregation; totals come from a window over the aggregated
rows, which are as many as there are rules, categories or severities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Debt points of an error, a warning, a suggestion and an information.
DEBT = (10, 5, 2, 1)


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def debt(severity: Column) -> Column:
    """Points of one finding; an unknown severity has none."""
    return F.coalesce(F.get(F.array(*map(F.lit, DEBT)), severity.cast("int")), F.lit(0))


def security_score(security_issues: Column) -> Column:
    """100 less ten an issue, never below 0."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - security_issues * 10)


def risk_level(critical: Column, high: Column, total: Column) -> Column:
    return F.when(critical > 0, "critical").when(high > 10, "high").when((high > 5) | (total > 50), "medium").when(total > 10, "low").otherwise("minimal")


def breakdown(findings: DataFrame, by: str) -> DataFrame:
    """by, n and its percentage of all findings."""
    n = findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def rule_title(rule: Column) -> Column:
    """What follows the last slash, hyphens as spaces, each word with a capital."""
    return F.initcap(F.replace(F.substring_index(rule, "/", -1), F.lit("-"), F.lit(" ")))


def top_issues(findings: DataFrame, n: int, file: str = "file_id") -> DataFrame:
    """The n rules found most often: rule, name, count and distinct files; ties by rule. Findings without a rule are 'unknown'."""
    by = findings.groupBy(F.coalesce("rule", F.lit("unknown")).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(file).alias("files"))
    return by.orderBy(F.desc("n"), "rule").limit(n).withColumn("name", rule_title(F.col("rule")))


def summary(findings: DataFrame, file: str = "file_id", security: str = "security") -> DataFrame:
    """One row: files, findings by severity, debt, security score and risk."""
    sev = F.col("severity")
    one = findings.agg(
        F.countDistinct(file).alias("files"), F.count(F.lit(1)).alias("issues"), *[count_if(sev == i).alias(k) for i, k in enumerate(("errors", "warnings", "suggestions", "infos"))],
        F.coalesce(F.sum(debt(sev)), F.lit(0)).cast("long").alias("debt"), count_if(F.col("category") == security).alias("security_issues"),
    )
    return one.withColumn("security_score", security_score(F.col("security_issues"))).withColumn("risk", risk_level(F.col("errors"), F.col("warnings"), F.col("issues")))


def owned(findings: DataFrame, owners: DataFrame, path: str) -> DataFrame:
    """Findings by owner, whose prefix the path starts with; a path with several owners counts for each. owners: owner, prefix.

    Paths meet prefixes by equality: each distinct path is cut at the lengths that prefixes have.
    """
    sizes = [r["n"] for r in owners.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as there are lengths
    cuts = F.array(*[F.when(F.length(F.col(path)) >= n, F.substring(F.col(path), 1, n)) for n in sizes]) if sizes else F.array(F.lit(None).cast("string"))
    held = findings.select(F.col(path).alias("path"), "severity").where("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("severity") == 0).alias("e"))
    joined = held.withColumnRenamed("path", path).withColumn("prefix", F.explode(F.array_distinct(F.array_compact(cuts)))).join(owners.select("owner", "prefix").distinct(), "prefix")
    one = joined.groupBy("owner", path).agg(F.first("n").alias("n"), F.first("e").alias("e"))
    return one.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("issues"), F.sum("e").alias("errors"))


def sla(found: DataFrame, most_errors: int, most_issues: int, least_quality: float) -> DataFrame:
    """metric, target, actual, met: errors, issues and quality of a summary (one row) against their targets, and their share as compliance."""
    row = lambda name, target, met: F.struct(F.lit(name).alias("metric"), F.lit(float(target)).alias("target"), F.col(name).cast("double").alias("actual"), met.alias("met"))
    errors, issues, quality = F.col("errors") <= most_errors, F.col("issues") <= most_issues, F.col("quality") >= least_quality
    rows = found.select(F.inline(F.array(row("errors", most_errors, errors), row("issues", most_issues, issues), row("quality", least_quality, quality))))
    return rows.withColumn("compliance", F.avg(F.col("met").cast("double")).over(Window.partitionBy()) * 100)


def compliance(findings: DataFrame, checks: DataFrame, security: str = "security") -> DataFrame:
    """One row: checks, those passed (no finding of their rule), their share in per cent, violations (security findings) and status. checks: rule."""
    broken = checks.select("rule").distinct().join(findings.select("rule").distinct().withColumn("_hit", F.lit(True)), "rule", "left")
    a = broken.agg(F.count(F.lit(1)).alias("checks"), count_if(F.col("_hit").isNull()).alias("passed"))
    v = findings.agg(count_if(F.col("category") == security).alias("violations"))
    out = a.crossJoin(v).withColumn("score", F.when(F.col("checks") == 0, 100.0).otherwise(F.col("passed") / F.col("checks") * 100))  # one row each
    return out.withColumn("status", F.when(F.col("violations") > 0, "partial").when(F.col("score") < 100, "failed").otherwise("compliant"))


def projects(findings: DataFrame, project: str) -> DataFrame:
    """project (null: all of them), files, issues, errors, warnings and others of every project and of the workspace."""
    sev = F.col("severity")
    counts = [F.count(F.lit(1)).alias("issues"), count_if(sev == 0).alias("errors"), count_if(sev == 1).alias("warnings"), count_if(sev > 1).alias("others")]
    return findings.rollup(project).agg(F.countDistinct("file_id").alias("files"), *counts)


def by_category_and_rule(findings: DataFrame) -> DataFrame:
    """category, rule and n, by category, by rule and in all."""
    return findings.groupingSets([["category"], ["rule"], []], "category", "rule").agg(F.count(F.lit(1)).alias("n"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """rule, severity and n of several partial counts together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule", "severity").agg(F.sum("n").alias("n"))


def over_limit(actual: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """key, actual, allowed of the keys whose actual value is above the allowed one."""
    return actual.join(limits, key).where("actual > allowed").select(key, "actual", "allowed")


def heatmap(values: DataFrame, value: str, top: int = 50) -> DataFrame:
    """The top rows by value, scaled to 0..1 between their extremes (0 where all are equal), with one of five buckets."""
    rows, all_ = values.orderBy(F.desc(value), *[c for c in values.columns if c != value]).limit(top), Window.partitionBy()
    low, high = F.min(value).over(all_), F.max(value).over(all_)
    scaled = rows.withColumn("scaled", F.when(high == low, 0.0).otherwise((F.col(value) - low) / (high - low)))
    return scaled.withColumn("bucket", F.least(F.floor(F.col("scaled") * 5), F.lit(4)).cast("long"))


def slow_rules(stats: DataFrame, slow: float, very_slow: float) -> DataFrame:
    """rule, issue: one row for each of slow, very slow and high variance (deviation above the mean) that holds. stats: rule, mean, deviation."""
    mean, deviation = F.col("mean"), F.col("deviation")
    issues = F.array(F.when((mean > slow) & (mean <= very_slow), "slow"), F.when(mean > very_slow, "very slow"), F.when(deviation > mean, "high variance"))
    return stats.select("rule", F.explode(F.array_compact(issues)).alias("issue"))
