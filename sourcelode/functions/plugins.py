"""User rules as Python table functions over batches of lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FAILED = "plugin-failed"
SCHEMA = "file_id long, line_no int, rule string, severity int, message string"


def run_plugin(lines: DataFrame, check: Callable[[str], Iterator[tuple[str, int, str]]]) -> DataFrame:
    """Findings of check(text), which yields (rule, severity, message) for a line. Runs on Arrow batches.

    A line on which check fails gives one finding of rule FAILED with the error instead of its own, and the job goes on.
    """

    def of(text):
        try:
            return list(check(text))
        except Exception as x:  # noqa: BLE001  (user code)
            return [(FAILED, 3, f"{type(x).__name__}: {x}")]

    def run(batches):
        for b in batches:
            rows = [(f, n, *x) for f, n, t in zip(*(b.column(i).to_pylist() for i in range(3))) for x in of(t or "")]
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file_id", "line_no", "rule", "severity", "message"])

    return lines.select("file_id", "line_no", "text").mapInArrow(run, SCHEMA)


class Hooks:
    """Functions around stages of an analysis, by the point at which they run, in order."""

    POINTS = ("before_parse", "after_parse", "before_rules", "after_rules", "before_fix", "after_fix", "before_output", "after_output", "on_error")

    def __init__(self):
        self.held: dict[str, list[Callable[[DataFrame], DataFrame]]] = {p: [] for p in self.POINTS}

    def add(self, point: str, hook: Callable[[DataFrame], DataFrame]) -> None:
        if point not in self.held:
            raise ValueError(f"unknown hook point {point}")
        self.held[point].append(hook)

    def run(self, point: str, df: DataFrame) -> DataFrame:
        """df through the hooks of a point; a hook that fails is skipped, and one that returns None ends the chain."""
        for hook in self.held[point]:
            try:
                out = hook(df)
            except Exception:  # noqa: BLE001, S112  (user code)
                continue
            if out is None:
                return df
            df = out
        return df


def expand_packs(packs: dict[str, dict], wanted: str) -> set[str]:
    """Rules of a pack with those it includes, less what it excludes; a pack on a cycle counts once. packs: name to include, rules, exclude."""
    seen: set[str] = set()

    def walk(name: str) -> set[str]:
        if name in seen:
            return set()
        seen.add(name)
        if name not in packs:
            raise ValueError(f"unknown pack {name}")
        p = packs[name]
        found = set(p.get("rules", ()))
        for other in p.get("include", ()):
            found |= walk(other)
        return found - set(p.get("exclude", ()))

    return walk(wanted)


def merge_packs(packs: list[dict]) -> set[str]:
    """Rules of all packs less the excludes of all."""
    return {r for p in packs for r in p.get("rules", ())} - {r for p in packs for r in p.get("exclude", ())}
