"""Whole report documents as ordered lines: (part, place, value), to be sorted by part and place and written as text.

A document's frame (its head and foot) is a few rows; its body stays distributed, so a report of any size can be
written: document.orderBy("part", "place").select("value").write.text(path). findings: file, line, col, severity
(0 to 3), rule, message. Nulls are written as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sinks

PARTS = ("head", "body", "foot")
ORDER = ("file", "line", "col", "rule", "message")


def _frame(spark: SparkSession, part: int, lines: list[str]) -> DataFrame:
    rows = [(part, [str(i).zfill(6)], x) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "part int, place array<string>, value string")


def _place(*columns: str) -> Column:
    """Numbers padded, so that text order is their order; nulls first."""
    return F.array(*[F.coalesce(F.when(F.lit(c in ("line", "col")), F.lpad(F.col(c).cast("string"), 10, "0")).otherwise(F.col(c).cast("string")), F.lit("")) for c in columns])


def _document(findings: DataFrame, head: list[str], value: Column, foot: list[str], joined: str = "", columns: tuple[str, ...] = ORDER) -> DataFrame:
    """Head, a line a finding, foot; `joined` follows every line of the body but the last."""
    spark, body = findings.sparkSession, findings.select(F.lit(1).alias("part"), _place(*columns).alias("place"), value.alias("value"))
    if joined:
        last = body.agg(F.max("place").alias("p")).first()["p"]  # of equal last places the comma goes to all but one
        if last is not None:
            first = F.row_number().over(Window.partitionBy("place").orderBy("value")) == 1
            body = body.withColumn("stay", first & (F.col("place") == F.array(*map(F.lit, last))))
            body = body.select("part", F.when(F.col("stay"), F.concat("place", F.array(F.lit("\uffff")))).otherwise(F.col("place")).alias("place"), F.when(F.col("stay"), F.col("value")).otherwise(F.concat("value", F.lit(joined))).alias("value"))
    return _frame(spark, 0, head).unionByName(body).unionByName(_frame(spark, 2, foot))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def json_document(findings: DataFrame, pretty: bool = False) -> DataFrame:
    rows = F.to_json(F.struct("file", "line", "col", sinks.label(F.col("severity")).alias("severity"), "rule", "message"), {"pretty": str(pretty).lower()})
    return _document(findings, ['{"version": 1, "diagnostics": ['], rows, ["]}"], ",")


def sarif_document(findings: DataFrame, tool: str = "sourcelode") -> DataFrame:
    """A run with its rules (each once) and its results."""
    spark = findings.sparkSession
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), sinks.label(F.col("severity"), sinks.SARIF_LEVELS).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))
    ids = findings.select("rule").where("rule IS NOT NULL").distinct()
    listed = _document(ids, [], F.to_json(F.struct(F.col("rule").alias("id"))), [], ",", ("rule",))
    head = _frame(spark, 0, ['{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "%s", "rules": [' % tool])
    middle = _frame(spark, 2, [']}}, "results": ['])
    results = _document(findings, [], result, ["]}]}"], ",").withColumn("part", F.col("part") + 3)
    return head.unionByName(listed).unionByName(middle).unionByName(results)


def _grouped(findings: DataFrame, head: list[str], opening: Column, value: Column, closing: str, foot: list[str]) -> DataFrame:
    """Head, the findings of each file between an opening and a closing line, foot."""
    spark = findings.sparkSession
    files = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("severity") == 0).cast("int")).alias("failed"))
    name = F.coalesce("file", F.lit(""))
    opened = files.select(F.lit(1).alias("part"), F.array(name, F.lit("0")).alias("place"), opening.alias("value"))
    body = findings.select(F.lit(1).alias("part"), F.concat(F.array(name, F.lit("1")), _place(*ORDER[1:])).alias("place"), value.alias("value"))
    closed = files.select(F.lit(1).alias("part"), F.array(name, F.lit("2")).alias("place"), F.lit(closing).alias("value"))
    return _frame(spark, 0, head).unionByName(opened).unionByName(body).unionByName(closed).unionByName(_frame(spark, 2, foot))


def checkstyle_document(findings: DataFrame) -> DataFrame:
    x = lambda c: sinks.xml_text(_text(c))
    error = F.concat(F.lit('  <error line="'), _text("line"), F.lit('" column="'), _text("col"), F.lit('" severity="'), sinks.label(F.col("severity")), F.lit('" message="'), x("message"), F.lit('" source="'), x("rule"), F.lit('"/>'))
    return _grouped(findings, ['<?xml version="1.0" encoding="UTF-8"?>', '<checkstyle version="8.0">'], F.concat(F.lit('<file name="'), x("file"), F.lit('">')), error, "</file>", ["</checkstyle>"])


def junit_document(findings: DataFrame) -> DataFrame:
    x = lambda c: sinks.xml_text(_text(c))
    opening = F.concat(F.lit('<testsuite name="'), x("file"), F.lit('" tests="'), F.col("n").cast("string"), F.lit('" failures="'), F.col("failed").cast("string"), F.lit('">'))
    case = F.concat(F.lit('  <testcase name="'), x("rule"), F.lit(":"), _text("line"), F.lit('"><failure message="'), x("message"), F.lit('"/></testcase>'))
    return _grouped(findings, ['<?xml version="1.0" encoding="UTF-8"?>', "<testsuites>"], opening, case, "</testsuite>", ["</testsuites>"])


def plain_document(findings: DataFrame, colour: bool = False) -> DataFrame:
    """file:line:col: severity: [rule] message, in order of place; severities in colour for terminals."""
    codes = {"error": "\x1b[31m", "warning": "\x1b[33m", "suggestion": "\x1b[36m", "info": "\x1b[34m"}
    severity = sinks.label(F.col("severity"))
    if colour:
        severity = F.concat(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])[severity], severity, F.lit("\x1b[0m"))
    return _document(findings, [], F.concat_ws("", _text("file"), F.lit(":"), _text("line"), F.lit(":"), _text("col"), F.lit(": "), severity, F.lit(": ["), _text("rule"), F.lit("] "), _text("message")), [])


def html_document(findings: DataFrame, title: str = "Findings") -> DataFrame:
    x = lambda c: sinks.xml_text(_text(c))
    cells = [x("file"), _text("line"), sinks.label(F.col("severity")), x("rule"), x("message")]
    row = F.concat(F.lit("<tr>"), *[p for c in cells for p in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    head = ["<!DOCTYPE html>", f"<html><head><meta charset='utf-8'><title>{title}</title></head><body>", "<table>", "<tr><th>file</th><th>line</th><th>severity</th><th>rule</th><th>message</th></tr>"]
    return _document(findings, head, row, ["</table>", "</body></html>"])


def markdown_document(findings: DataFrame, title: str = "Findings") -> DataFrame:
    cell = lambda c: F.replace(F.regexp_replace(_text(c), r"\s+", " "), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), cell("file"), F.lit(" | "), _text("line"), F.lit(" | "), sinks.label(F.col("severity")), F.lit(" | "), cell("rule"), F.lit(" | "), cell("message"), F.lit(" |"))
    return _document(findings, [f"# {title}", "", "| file | line | severity | rule | message |", "|-|-|-|-|-|"], row, [])


FORMATS = {"json": json_document, "sarif": sarif_document, "checkstyle": checkstyle_document, "junit": junit_document, "plain": plain_document, "html": html_document, "markdown": markdown_document}


def write(findings: DataFrame, form: str, path: str) -> None:
    """A document of a form, or csv rows, below path; parts of the output are in the document's order."""
    if form == "csv":
        findings.select(*ORDER, "severity").orderBy(*ORDER).write.option("header", True).csv(path)
    else:
        FORMATS[form](findings).orderBy("part", "place").select("value").write.text(path)
