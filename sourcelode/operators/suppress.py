"""Suppression directives: intervals parsed from comments, and their removal from findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

DIRECTIVE = r"lint:(ignore-file|ignore-next|ignore|disable|enable)\b[ \t]*([\w, -]*)"


def directives(lines: DataFrame, pattern: str = DIRECTIVE) -> DataFrame:
    """file_id, line_no, kind, rules (null: all)."""
    names = F.filter(F.transform(F.split(F.regexp_extract("text", pattern, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    d = lines.where(F.col("text").rlike(pattern)).select("file_id", "line_no", F.regexp_extract("text", pattern, 1).alias("kind"), names.alias("rules"))
    return d.withColumn("rules", F.when(F.size("rules") > 0, F.col("rules")))


def intervals(d: DataFrame) -> DataFrame:
    """file_id, lo, hi, rules. A disable runs to the line before the first later enable that ends it, or to the file's end.

    An enable of all rules ends any disable, a disable of all rules is ended by any enable, and otherwise an
    enable must name one of its rules.
    """
    last, whole = F.lit(2147483647), "*"
    named = lambda c: F.coalesce(c, F.array(F.lit(whole)))
    # one event a directive and rule; a disable of all rules looks at every enable, so it has an event of its own
    ends = d.where("kind = 'enable'").select("file_id", "line_no", F.explode(F.array_union(named(F.col("rules")), F.array(F.lit("")))).alias("rule"))
    keyed = d.where("kind = 'disable'").withColumn("id", F.monotonically_increasing_id())
    keyed = materialise(keyed, "disables")
    starts = keyed.select("id", "file_id", "line_no", F.explode(F.coalesce(F.array_union(F.col("rules"), F.array(F.lit(whole))), F.array(F.lit("")))).alias("rule"))
    events = starts.withColumn("end", F.lit(None).cast("int")).unionByName(ends.select(F.lit(None).cast("long").alias("id"), "file_id", "line_no", "rule", F.col("line_no").cast("int").alias("end")))
    after = Window.partitionBy("file_id", "rule").orderBy("line_no").rangeBetween(1, Window.unboundedFollowing)
    ended = events.withColumn("end", F.min("end").over(after)).where("id IS NOT NULL").groupBy("id").agg(F.min("end").alias("end"))
    disabled = keyed.join(ended, "id").select("file_id", F.col("line_no").alias("lo"), F.coalesce(F.col("end") - 1, last).alias("hi"), "rules")
    others = d.where("kind NOT IN ('enable', 'disable')")
    lo = F.when(F.col("kind") == "ignore-file", F.lit(1)).otherwise(F.col("line_no") + 1)
    hi = F.when(F.col("kind") == "ignore-file", last).otherwise(F.col("line_no") + 1)
    return disabled.unionByName(others.select("file_id", lo.alias("lo"), hi.alias("hi"), "rules"))


def suppress(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings (file_id, line_no, rule, ...) that no interval covers; an interval names a rule by itself or by a part of it."""
    s = spans.select(F.col("file_id").alias("s_file"), "lo", "hi", "rules")
    covered = (F.col("file_id") == F.col("s_file")) & F.col("line_no").between(F.col("lo"), F.col("hi"))
    named = F.col("rules").isNull() | F.exists("rules", lambda r: F.col("rule").contains(r))
    return findings.join(s, covered & named, "left_anti")
