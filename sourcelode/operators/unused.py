"""Unused symbols: roots, reachability and one detector a kind. symbols: name, kind, file, line, col, th; edges: src, dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: How sure a finding of each kind is.
CONFIDENCE = {"function": 0.9, "type": 0.85, "constructor": 0.8, "field": 0.7, "instance": 0.5, "export": 0.6, "local": 0.8}


def compiler_generated(name: Column) -> Column:
    """Names that a compiler makes: a dollar sign or C:, D:, N: in front, or a final #."""
    return name.rlike(r"^(\$|C:|D:|N:)|#$")


def base_name(name: Column) -> Column:
    """What follows the last dot of a qualified name; an operator stays whole."""
    return F.when(name.rlike(r"[\w']$"), F.regexp_extract(name, r"([^.]*)$", 1)).otherwise(F.regexp_replace(name, r"^(?:[A-Z][\w']*\.)+", ""))


def find_roots(symbols: DataFrame, patterns: list[str]) -> DataFrame:
    """node: symbols whose qualified name matches one of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("name").rlike(p)
    return symbols.where(hit).select(F.col("name").alias("node")).distinct()


def find_instance_roots(symbols: DataFrame) -> DataFrame:
    """node: dictionaries and methods of class instances."""
    return symbols.where(base_name(F.col("name")).rlike(r"^\$[fc]")).select(F.col("name").alias("node")).distinct()


def kind_of(kind: Column, name: Column) -> Column:
    """The kinds of finding that an unreachable symbol gives, as an array: a lower-case function counts as a field as well."""
    base, made = base_name(name), compiler_generated(base_name(name))
    instance = base.rlike(r"^\$[fd]")
    return F.array_compact(F.array(
        F.when((kind == "function") & ~made, "function"), F.when(kind.isin("type", "class") & ~made, "type"), F.when((kind == "constructor") & ~made, "constructor"),
        F.when((kind == "function") & ~made & base.rlike("^[a-z_]"), "field"), F.when(instance, "instance"),
    ))


def detect(symbols: DataFrame, edges: DataFrame, patterns: list[str], instances_are_roots: bool = True, least: float = 0.5) -> DataFrame:
    """name, finding, file, line, col, confidence of the symbols that no root reaches, in order of file, line and column.

    Symbols made by code generation (th) or a compiler are left out.
    """
    roots = find_roots(symbols, patterns)
    if instances_are_roots:
        roots = roots.union(find_instance_roots(symbols)).distinct()
    seen = graph.reachable(edges, roots).withColumnRenamed("node", "name")
    left = symbols.join(seen, "name", "left_anti").where(~F.coalesce(F.col("th"), F.lit(False)))
    found = left.select("name", F.explode(kind_of(F.col("kind"), F.col("name"))).alias("finding"), "file", "line", "col")
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return found.withColumn("confidence", sure[F.col("finding")]).where(F.col("confidence") >= least).orderBy("file", "line", "col", "name", "finding")


def unused_names(listed: DataFrame, seen: DataFrame, finding: str) -> DataFrame:
    """Exports or local bindings (name, file, line, col) that are not among the names reached (node)."""
    out = listed.join(seen.select(F.col("node").alias("name")), "name", "left_anti")
    return out.select("name", F.lit(finding).alias("finding"), "file", "line", "col", F.lit(CONFIDENCE[finding]).alias("confidence"))


def stats(items: DataFrame) -> DataFrame:
    """One row: all findings, those of confidence 0.8 and more, and those that can be removed at once (functions and locals among them)."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sure = F.col("confidence") >= 0.8
    return items.agg(F.count(F.lit(1)).alias("total"), count(sure).alias("sure"), count(sure & F.col("finding").isin("function", "local")).alias("fixable"))
