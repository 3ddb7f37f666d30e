"""Rules and settings from TOML, later tables over earlier ones."""

from __future__ import annotations

import tomllib

from pyspark.sql import SparkSession

from ..operators.rules import Rule

_SEVERITY = {"error": 0, "warning": 1, "suggestion": 2, "info": 3}


def read_text(spark: SparkSession, path: str) -> str:
    """A small settings file from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def parse_rules(text: str) -> list[Rule]:
    """Rules of a [[rules]] array; unknown keys are an error, so a misspelt one does not pass."""
    out = []
    for r in tomllib.loads(text).get("rules", []):
        r = dict(r)
        severity = r.pop("severity", "warning")
        known = {k: r.pop(k) for k in ("id", "pattern", "message", "category", "regex", "enabled", "target", "replacement") if k in r}
        lists = {k: tuple(r.pop(s, ())) for k, s in (("within", "within"), ("excepted", "except"))}
        conditions = tuple(_condition(c) for c in r.pop("where", ()))
        if r or severity not in _SEVERITY or "id" not in known or "pattern" not in known:
            raise ValueError(f"bad rule {known.get('id')}: {sorted(r) or severity}")
        out.append(Rule(severity=_SEVERITY[severity], conditions=conditions, **known, **lists))
    return out


def _condition(c):
    """["not", ["is_literal", "$X"]] as nested tuples."""
    return tuple(_condition(x) if isinstance(x, list) else x for x in c)


def merge(*tables: list[Rule]) -> list[Rule]:
    """Later tables win by id; the place of a rule is that of its first appearance."""
    out: dict[str, Rule] = {}
    for t in tables:
        for r in t:
            out[r.id] = r
    return list(out.values())
