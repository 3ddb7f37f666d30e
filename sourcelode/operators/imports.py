"""Analyses of imports (file_id, imported, qualified, alias, hiding, items): unused items, mergeable groups and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What names an import; null aliases are equal.
IMPORT = ["file_id", "imported", "qualified", "alias"]


def unused(imports: DataFrame, used: DataFrame) -> DataFrame:
    """file_id, imported, unused: the items of an import, sorted, that the file uses neither by name nor by a listed child.

    An item is a name, or Name(child, ...); one with (..) cannot be told and is
    left out, like imports without a list. Imports whose items are all used give
    no row. used: file_id, name.
    """
    item = F.explode("items").alias("item")
    rows = imports.where("NOT coalesce(hiding, false)").select("file_id", "imported", item).where(~F.col("item").contains("(.."))
    children = F.split(F.regexp_extract("item", r"\((.*)\)", 1), r"\s*[;,]\s*")
    rows = rows.withColumn("name", F.trim(F.regexp_extract("item", r"^([^(]+|\([^)]*\))", 1)))
    named = rows.select("file_id", "imported", "name", F.explode(F.array_distinct(F.concat(F.array("name"), F.filter(children, lambda c: c != "")))).alias("any_name"))
    known = used.select(F.col("file_id").alias("_f"), F.col("name").alias("_n")).distinct()
    met = named.join(known, (F.col("file_id") == F.col("_f")) & (F.col("any_name") == F.col("_n")), "left")
    by = met.groupBy("file_id", "imported", "name").agg(F.max(F.col("_n").isNotNull()).alias("met"))
    return by.where("NOT met").groupBy("file_id", "imported").agg(F.sort_array(F.collect_set("name")).alias("unused"))


def without_list(imports: DataFrame) -> DataFrame:
    """Imports that neither list what they take nor hide anything."""
    return imports.where("items IS NULL AND NOT coalesce(hiding, false)")


def merged(imports: DataFrame) -> DataFrame:
    """Groups of two or more imports of one module under one name: times, and the union of their items, sorted."""
    return imports.groupBy(*IMPORT).agg(F.count(F.lit(1)).alias("times"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).where("times > 1")


def best_source(symbols: DataFrame, catalogue: DataFrame) -> DataFrame:
    """symbol and the module that offers it first in the catalogue's order (null if none). catalogue: symbol, module, ord."""
    first = catalogue.groupBy("symbol").agg(F.min_by("module", F.struct("ord", "module")).alias("module"))
    return symbols.select("symbol").distinct().join(first, "symbol", "left")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point (file, point) the smallest span (file, name, lo, hi; hi excluded) that holds it; ties by name.

    The join is keyed by file, so a file's spans meet only its own points.
    """
    inside = points.join(spans, "file").where("point >= lo AND point < hi")
    return inside.groupBy("file", "point").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("size"), "name")).alias("s")).select("file", "point", "s.name", "s.size")


def merge_baselines(new: DataFrame, old: DataFrame, extra: list[str]) -> DataFrame:
    """Entries of both; of those with one file, line and rule the new one stays, with its extra columns."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)))
    return both.groupBy("file", "line", "rule").agg(F.min_by(F.struct(*extra), F.struct("_age", *extra)).alias("e")).select("file", "line", "rule", "e.*")
