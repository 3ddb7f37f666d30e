"""Complexity of source texts from counts of tokens, all built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, token: str) -> Column:
    """How often a literal token occurs, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)


def cyclomatic(text: Column) -> Column:
    """One, and one for each case, condition, guard and further alternative."""
    case, cond, guard, arrow = (occurrences(text, t) for t in ("case ", "if ", " | ", " -> "))
    return (1 + case + cond + guard + F.greatest(F.lit(0.0), arrow - case)).cast("long")


def nesting(text: Column) -> Column:
    """Deepest indentation of a line with text, in steps of two."""
    depth = F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", 0).otherwise(F.length(x) - F.length(F.ltrim(x))))
    return F.floor(F.array_max(depth) / 2).cast("long")


def cognitive(text: Column) -> Column:
    """Branches, do blocks, bindings and thirds of compositions, and two for each level of indentation beyond four."""
    ones = ("case ", " if ", " | ", " do\n", " do ", " where\n", " let ", "\nlet ", " >>= ")
    flow = sum((occurrences(text, t) for t in ones[1:]), occurrences(text, ones[0]))
    deep = F.greatest(F.lit(0), nesting(text) - 4) * 2
    return (flow + F.floor(occurrences(text, " . ") / 3) + deep).cast("long")
