"""Edits and fixes: conflicts, their resolution, order and application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 64


def overlaps(edits: DataFrame) -> DataFrame:
    """Pairs of edits (file, fix, lo, hi; hi exclusive) of different fixes that overlap; joined by file and bucket, each pair once."""
    at = edits.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor((F.greatest("hi", F.col("lo") + 1) - 1) / BUCKET))))
    a, b = at.alias("a"), at.alias("b")
    on = (F.col("a.file") == F.col("b.file")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.fix") < F.col("b.fix")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi"))
    first = F.col("a.bucket") == F.floor(F.greatest("a.lo", "b.lo") / BUCKET)
    return a.join(b, on).where(first).select(F.col("a.file").alias("file"), F.col("a.fix").alias("fix1"), F.col("b.fix").alias("fix2"), F.greatest("a.lo", "b.lo").alias("lo"), F.least("a.hi", "b.hi").alias("hi"))


def resolve(edits: DataFrame, conflicts: DataFrame, strategy: str = "prefer_preferred") -> DataFrame:
    """Edits without the losers of every conflict.

    prefer_preferred: the preferred fix, else the first; prefer_smaller: the shorter span, else the first; skip_all: both lose.
    """
    facts = edits.groupBy("file", "fix").agg(F.max(F.col("preferred").cast("int")).alias("preferred"), F.sum(F.col("hi") - F.col("lo")).alias("width"))
    one, two = (facts.select(*[F.col(c).alias(f"{c}{i}") for c in facts.columns]) for i in (1, 2))
    j = conflicts.select(F.col("file").alias("f"), F.col("fix1").alias("x1"), F.col("fix2").alias("x2")).distinct()
    j = j.join(one, (F.col("f") == F.col("file1")) & (F.col("x1") == F.col("fix1"))).join(two, (F.col("f") == F.col("file2")) & (F.col("x2") == F.col("fix2")))
    second_wins = {"prefer_preferred": F.col("preferred2") > F.col("preferred1"), "prefer_smaller": F.col("width2") < F.col("width1")}
    if strategy == "skip_all":
        losers = j.select(F.col("f").alias("file"), F.explode(F.array("x1", "x2")).alias("fix"))
    else:
        losers = j.select(F.col("f").alias("file"), F.when(second_wins[strategy], F.col("x1")).otherwise(F.col("x2")).alias("fix"))
    return edits.join(losers.distinct(), ["file", "fix"], "left_anti")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file and content after all edits (offsets lo, hi from 0, hi exclusive); of overlapping edits the earlier counts."""
    ordered = edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "text"))).alias("edits"))
    j = files.join(ordered, "file", "left")
    start = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))
    source = F.col("content")
    step = lambda a, e: F.when(e["lo"] < a["at"], a).otherwise(F.struct(e["hi"].cast("int").alias("at"), F.concat(a["out"], F.substring(source, a["at"] + 1, e["lo"].cast("int") - a["at"]), e["text"]).alias("out")))
    done = F.aggregate("edits", start, step, lambda a: F.concat(a["out"], F.substring(source, a["at"] + 1, F.length(source))))
    return j.select("file", F.coalesce(done, source).alias("content"))
