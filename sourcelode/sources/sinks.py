"""Reports: JSON, SARIF, JUnit, Checkstyle, Code Climate, CSV, Prometheus and Graphviz rows, built by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("error", "warning", "suggestion", "info")
SARIF_LEVELS = ("error", "warning", "note", "note")
CLIMATE = ("critical", "major", "minor", "info")


def label(severity, names=LABELS):
    return F.element_at(F.array(*map(F.lit, names)), severity.cast("int") + 1)


def xml_text(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object a finding."""
    return findings.select(F.to_json(F.struct("file", "line", "col", label(F.col("severity")).alias("severity"), "rule", "message")).alias("value"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """One SARIF result object a finding; a run is their concatenation, so no group is collected."""
    location = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), label(F.col("severity"), SARIF_LEVELS).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations"))).alias("value"))


def checkstyle_rows(findings: DataFrame) -> DataFrame:
    """file and one error element a finding."""
    element = F.format_string('<error line="%d" column="%d" severity="%s" message="%s" source="%s"/>', "line", "col", label(F.col("severity")), xml_text(F.col("message")), xml_text(F.col("rule")))
    return findings.select("file", element.alias("value"))


def junit_suites(findings: DataFrame) -> DataFrame:
    """One suite element a file, with its counts."""
    by = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("severity") == 0).cast("int")).alias("failed"))
    return by.select(F.format_string('<testsuite name="%s" tests="%d" failures="%d">', xml_text(F.col("file")), "n", "failed").alias("value"))


def code_climate_rows(findings: DataFrame) -> DataFrame:
    key = F.md5(F.concat_ws(":", "file", "line", "rule", "message"))
    where = F.struct(F.col("file").alias("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
    return findings.select(F.to_json(F.struct(F.lit("issue").alias("type"), F.col("rule").alias("check_name"), F.col("message").alias("description"), label(F.col("severity"), CLIMATE).alias("severity"), key.alias("fingerprint"), where.alias("location"))).alias("value"))


def prometheus_rows(findings: DataFrame) -> DataFrame:
    by = findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.format_string('findings_total{rule="%s",severity="%s"} %d', "rule", label(F.col("severity")), "n").alias("value"))


def dot_rows(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('  "%s" -> "%s";', "src", "dst").alias("value"))


def flame_rows(samples: DataFrame) -> DataFrame:
    """Folded stacks: category;rule and whole milliseconds."""
    by = samples.groupBy("category", "rule").agg(F.round(F.sum("ms")).cast("long").alias("ms"))
    return by.select(F.concat_ws(" ", F.concat_ws(";", "category", "rule"), F.col("ms").cast("string")).alias("value"))
