"""Copies of texts and functions: exact ones, ones after renaming, and similar ones; their clusters and figures."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def exact_clones(rows: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """hash, n, first: texts that occur least times or more, blanks folded."""
    folded = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    hashed = rows.select(F.col(key).alias("k"), F.md5(folded).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).where(F.col("n") >= least)


def _normal(tokens):
    """Identifiers by order of their first use, so that renamed copies agree; other tokens as they are."""
    names: dict[str, str] = {}
    return tuple(names.setdefault(t, f"${len(names)}") if t[0].isalpha() or t[0] == "_" else t for t in tokens)


def edit_distance(a, b, most: int | None = None) -> int:
    """Least number of insertions, deletions and replacements between two sequences; most + 1 as soon as it must exceed most."""
    if len(a) > len(b):
        a, b = b, a
    if most is not None and len(b) - len(a) > most:
        return most + 1
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        left, up = row[0], j
        row[0] = j
        for i, x in enumerate(a, 1):
            up, left = left, row[i]
            row[i] = min(up + (x != y), row[i] + 1, row[i - 1] + 1)
            up = left
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def functions_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash (of the renamed tokens), tokens: normal forms of function bodies."""
    import pyarrow as pa
    import xxhash

    word = re.compile(r"[A-Za-z_][A-Za-z0-9_']*|[0-9]+|[^\sA-Za-z0-9_]")

    def run(batches):
        for b in batches:
            forms = [_normal(word.findall(t or "")) for t in b.column(1).to_pylist()]
            hashes = [xxhash.xxh3_64_hexdigest("\0".join(f)) for f in forms]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes), pa.array([list(f) for f in forms], pa.list_(pa.string()))], ["key", "hash", "tokens"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"key {kind}, hash string, tokens array<string>")


def similar_pairs(functions: DataFrame, block: str = "file", least: float = 0.8) -> DataFrame:
    """hash1, hash2, similarity of different normal forms of one block with 1 - distance / (n1 + n2) of at least `least`.

    functions: block, hash, tokens. Exact copies share a hash and enter a block once. Pairs are made within a block
    only, so a block should be a file; pairs whose lengths alone exceed the distance are not compared.
    """
    import pyarrow as pa

    most = lambda n, m: math.floor((1 - least) * (n + m) + 1e-9)
    forms = functions.groupBy(block, "hash").agg(F.min("tokens").alias("t"), F.min(F.size("tokens")).alias("n"))
    one, two = (forms.select(F.col(block).alias("block"), F.col("hash").alias(f"h{i}"), F.col("t").alias(f"t{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    near = F.abs(F.col("n1") - F.col("n2")) <= (1 - least) * (F.col("n1") + F.col("n2")) + 1e-9
    pairs = one.join(two, "block").where((F.col("h1") < F.col("h2")) & near).select("h1", "h2", "t1", "t2")

    def verify(batches):
        for b in batches:
            rows = []
            for h1, h2, t1, t2 in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "t1", "t2"))):
                n = len(t1) + len(t2)
                d = edit_distance(t1, t2, most(len(t1), len(t2)))
                if n and d <= most(len(t1), len(t2)):
                    rows.append((h1, h2, 1 - d / n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["hash1", "hash2", "similarity"])

    return pairs.mapInArrow(verify, "hash1 string, hash2 string, similarity double").distinct()


def clone_clusters(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, hash, cluster: functions (key, hash) whose forms are equal or linked by pairs; cluster is the least hash. Functions without any partner are left out."""
    linked = graph.components(pairs.select(F.col("hash1").alias("src"), F.col("hash2").alias("dst")))
    repeated = functions.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    j = functions.select("key", "hash").join(repeated, "hash").join(linked.withColumnRenamed("node", "hash"), "hash", "left")
    return j.where("component IS NOT NULL OR n > 1").select("key", "hash", F.coalesce("component", "hash").alias("cluster"))


def duplication(functions: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: functions, those in a cluster, their share, clusters and the size of the largest."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    some = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    out = functions.agg(F.count(F.lit(1)).alias("functions")).crossJoin(some)  # one row each
    return out.withColumn("ratio", F.when(F.col("functions") == 0, 0.0).otherwise(F.col("duplicated") / F.col("functions")))


def clone_hotspots(members: DataFrame) -> DataFrame:
    """file and the duplicated lines in it, most first. members: file, lines."""
    return members.groupBy("file").agg(F.sum("lines").alias("lines")).orderBy(F.desc("lines"), "file")


def best_clone(clones: DataFrame, keys: list[str]) -> DataFrame:
    """Of the clones of each key the one of largest similarity, then exact before structural before similar, then most places, then least id."""
    rank = F.array_position(F.array(*map(F.lit, ("exact", "structural", "similar"))), F.col("kind"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), rank, F.desc("places"), "clone"))
    return clones.withColumn("_place", place).where("_place = 1").drop("_place")
