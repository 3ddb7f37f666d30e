"""Trends over sessions and snapshots, comparisons of sessions, and profiles by rule, category and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import percentage_change

#: A change of more than so many per cent is a direction; points of snapshot trends.
HALF_CHANGE, ISSUE_POINTS, QUALITY_POINTS, DEBT_POINTS = 10.0, 5, 2.0, 5


def halves(sessions: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, n, first and second (mean of value in the earlier and the later half by order; of an odd number the later half has one more), variance, change in per cent and direction.

    A key with one session has no first half: change 0, stable. Null values are not averaged.
    """
    window = Window.partitionBy(*keys)
    rows = sessions.withColumn("_place", F.row_number().over(window.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(window))
    early = F.col("_place") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(early, F.col(value))).alias("first"), F.avg(F.when(~early, F.col(value))).alias("second"), F.var_samp(value).alias("variance"))
    change = F.coalesce(percentage_change(F.col("first"), F.col("second")), F.lit(0.0))
    return out.withColumn("change", change).withColumn("direction", direction(F.col("change"), HALF_CHANGE))


def direction(change: Column, points: float) -> Column:
    """degrading above points, improving below -points, else stable: for values of which more is worse."""
    return F.when(change > points, "degrading").when(change < -points, "improving").otherwise("stable")


def regressions(trends: DataFrame, threshold: float) -> DataFrame:
    """Trends whose change is above threshold per cent."""
    return trends.where(F.col("change") > threshold)


def snapshot_trends(snapshots: DataFrame, keys: list[str], order: str, issues: str, quality: str, debt: str) -> DataFrame:
    """keys and the directions of issues, quality and debt: the mean of the last three snapshots against that of the three before.

    Issues and debt are compared by whole means, quality by its mean and inverted; with fewer than four snapshots all are stable.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    rows = snapshots.withColumn("_place", place).where("_place <= 6")
    last, before = F.col("_place") <= 3, F.col("_place") > 3
    mean = lambda c, when: F.avg(F.when(when, F.col(c)))
    whole = lambda c: F.floor(mean(c, last)) - F.floor(mean(c, before))
    out = rows.groupBy(*keys).agg(whole(issues).alias("di"), (mean(quality, before) - mean(quality, last)).alias("dq"), whole(debt).alias("dd"))
    of = lambda c, points: direction(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), points)
    return out.select(*keys, of("di", ISSUE_POINTS).alias("issues"), of("dq", QUALITY_POINTS).alias("quality"), of("dd", DEBT_POINTS).alias("debt"))


def compare_sessions(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value before and after, change in per cent and state: common, new or removed."""
    b, a = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    j = b.withColumn("_b", F.lit(True)).join(a.withColumn("_a", F.lit(True)), keys, "full_outer")
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").otherwise("common")
    return j.select(*keys, "before", "after", percentage_change(F.col("before"), F.col("after")).alias("change"), state.alias("state"))


def profiles(samples: DataFrame, levels: list[str], value: str) -> DataFrame:
    """n, total, mean, least and most of value for every prefix of levels, the empty one included (a rollup); level tells how many are given."""
    out = samples.rollup(*levels).agg(F.grouping_id().alias("_g"), F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.withColumn("level", F.lit(len(levels)) - F.bit_count("_g")).drop("_g")


def merged_profiles(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Profiles of several sessions as one: values of equal keys are added."""
    out = parts[0].select(*keys, value)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, value))
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def executions(samples: DataFrame, rule: str, findings: str, ms: str) -> DataFrame:
    """rule, runs, findings, ms and the longest run."""
    return samples.groupBy(rule).agg(F.count(F.lit(1)).alias("runs"), F.sum(findings).alias("findings"), F.sum(ms).alias("ms"), F.max(ms).alias("longest"))


def metrics_summary(samples: DataFrame, ms: str) -> DataFrame:
    """One row: runs, total, mean and peak time, and runs a second of that time (0 without any)."""
    one = samples.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total"), F.avg(ms).alias("mean"), F.max(ms).alias("peak"))
    return one.withColumn("throughput", F.when(F.col("total") > 0, F.col("runs") / F.col("total") * 1000).otherwise(0.0))


def slowest(stats: DataFrame, n: int, by: str = "total", fastest: bool = False, key: str = "rule") -> DataFrame:
    """The n rules of largest total, or of smallest mean when fastest; ties by rule."""
    return stats.orderBy(F.asc(by) if fastest else F.desc(by), key).limit(n)


def hot_spots(profile: DataFrame, least_pct: float = 1.0, n: int | None = None) -> DataFrame:
    """Entries (name, ms) that take at least least_pct of all time, largest first, with their pct; at most n."""
    out = profile.withColumn("pct", F.col("ms") / F.sum("ms").over(Window.partitionBy()) * 100).where(F.col("pct") >= least_pct).orderBy(F.desc("pct"), "name")
    return out if n is None else out.limit(n)


def category_heat(samples: DataFrame, category: str, value: str) -> DataFrame:
    """category, total, scaled (total between the extremes, 0 if all are equal) and its share of all in per cent, rounded."""
    by, every = samples.groupBy(category).agg(F.sum(value).alias("total")), Window.partitionBy()
    low, high = F.min("total").over(every), F.max("total").over(every)
    scaled = F.when(high == low, 0.0).otherwise((F.col("total") - low) / (high - low))
    return by.select(category, "total", scaled.alias("scaled"), F.round(F.col("total") / F.sum("total").over(every) * 100, 1).alias("pct"))


def file_rule_heat(samples: DataFrame, file: str, rule: str, value: str, files: int, rules: int) -> DataFrame:
    """file, rule, total of the `files` files and `rules` rules of largest total, 0 where a pair has none: the matrix in rows."""
    top = lambda c, n: samples.groupBy(c).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), c).limit(n).select(c)
    grid = top(file, files).crossJoin(F.broadcast(top(rule, rules)))  # files * rules cells, both parameters
    cells = samples.groupBy(file, rule).agg(F.sum(value).alias("total"))
    return grid.join(cells, [file, rule], "left").fillna(0, ["total"])
