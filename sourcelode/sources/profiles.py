"""Readers of profiles, benchmark results, sessions and snapshots, and of projects and settings."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cost centre's row in a text profile: name, module, source span, number, entries and four shares.
ROW = r"^(\s*)(\S+)\s+(\S+)\s+(\S.*?)\s+(\d+)\s+(\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s*$"


def cost_centres(lines: DataFrame) -> DataFrame:
    """name, module, span, number, entries, depth and the individual and inherited shares of time and allocation, from lines (text) of a text profile; other lines are skipped."""
    part = lambda i: F.regexp_extract("text", ROW, i)
    rows = lines.where(F.col("text").rlike(ROW))
    return rows.select(
        part(2).alias("name"), part(3).alias("module"), part(4).alias("span"), part(5).cast("long").alias("number"), part(6).cast("long").alias("entries"), F.length(part(1)).alias("depth"),
        *[part(i).cast("double").alias(c) for i, c in ((7, "time"), (8, "alloc"), (9, "inherited_time"), (10, "inherited_alloc"))],
    )


def span_lines(span: Column) -> Column:
    """file, first and last line of a span such as src/A.hs:(3,1)-(5,9) or src/A.hs:7:1-20; null where it is neither."""
    many, one = r"^(.*):\((\d+),\d+\)-\((\d+),\d+\)$", r"^(.*?):(\d+):\d+(?:-\d+)?$"
    of = lambda p, i: F.regexp_extract(span, p, i)
    both = lambda p, last: F.struct(of(p, 1).alias("file"), of(p, 2).cast("int").alias("first"), of(p, last).cast("int").alias("last"))
    return F.when(span.rlike(many), both(many, 3)).when(span.rlike(one), both(one, 2))


def profile_json(spark: SparkSession, path: str, depth: int = 64) -> DataFrame:
    """id, name, module, span of the cost centres of JSON profiles."""
    schema = "cost_centres array<struct<id: long, label: string, module: string, src_loc: string>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("cost_centres")).select("id", F.col("label").alias("name"), "module", F.col("src_loc").alias("span"))


def benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """name, mean, deviation of benchmark reports: an array of objects with reportName and reportAnalysis."""
    point = "struct<estPoint: double>"
    schema = f"reportName string, reportAnalysis struct<anMean: {point}, anStdDev: {point}>"
    d = spark.read.option("multiLine", True).schema(schema).json(path)
    return d.select(F.col("reportName").alias("name"), F.col("reportAnalysis.anMean.estPoint").alias("mean"), F.col("reportAnalysis.anStdDev.estPoint").alias("deviation"))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """session, start, rule, category, file, ms of a folder of session documents."""
    schema = "session string, start timestamp, samples array<struct<rule: string, category: string, file: string, ms: double>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select("session", "start", F.inline("samples"))


def append_snapshot(summary: DataFrame, path: str, at) -> None:
    """Adds a summary (one row) to the history below path, which history() reads."""
    summary.withColumn("at", F.lit(at).cast("timestamp")).write.mode("append").json(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, at timestamp").json(path)


def projects(files: DataFrame, markers: tuple[str, ...] = (r"\.cabal$", r"^package\.yaml$", r"^stack\.yaml$")) -> DataFrame:
    """root: folders that hold one of the marker files. files: path."""
    name = F.substring_index("path", "/", -1)
    root = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^$", ".")
    return files.where(name.rlike("|".join(markers))).select(root.alias("root")).distinct()


def import_table(spark: SparkSession, path: str) -> DataFrame:
    """symbol, module, ord of a TOML table of modules and their lists of symbols, in the order of the file."""
    data = tomllib.loads(Path(path).read_text())
    rows = [(s, m, i) for i, (m, names) in enumerate((m, names) for m, names in data.get("modules", {}).items()) for s in names]
    return spark.createDataFrame(rows, "symbol string, module string, ord int")


def settings(prefix: str, environ=None, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Settings from variables that begin with prefix, in lower case with dots, over defaults."""
    environ = os.environ if environ is None else environ
    found = {k[len(prefix) :].lower().replace("__", "."): v for k, v in environ.items() if k.startswith(prefix)}
    return {**(defaults or {}), **found}
