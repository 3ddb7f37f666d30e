"""Incremental analysis on Structured Streaming: matching new files, event-time counts, latest version per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import Rule, match
from ..sources.text import lines


def stream_hits(files: DataFrame, rules: list[Rule], id_col: str = "path", text_col: str = "content") -> DataFrame:
    """Findings of every file of a stream as it arrives; stateless, so batch and stream share one plan."""
    return match(lines(files, id_col, text_col), rules)


def windowed_counts(events: DataFrame, ts: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by key and event-time window; rows later than `late` behind the watermark drop out, as the watermark means."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_versions(changes: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Throttle: of changes of equal key and time within the watermark only one passes."""
    return changes.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
