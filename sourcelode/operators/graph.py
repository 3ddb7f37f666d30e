"""Closure, paths, cycles and components over edge tables; every step is a join whose result is written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

PARTS = 32  # results of steps that are kept apart before they are written as one


def distances(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """node and its distance from the nearest root, for all reachable nodes. edges: src, dst; roots: node.

    Runs until no node is new; with a bound `most`, nodes farther away are an error.
    """
    seen = materialise(roots.select("node").distinct().withColumn("distance", F.lit(0)), "closure")
    front, parts, d = seen, [seen], 0
    while True:
        d += 1
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        known = _union(parts)
        front = materialise(found.join(known, "node", "left_anti").withColumn("distance", F.lit(d)), "closure")
        if front.isEmpty():
            return known
        if most is not None and d > most:
            raise ValueError(f"nodes are farther than {most} steps from the roots")
        parts.append(front)
        if len(parts) > PARTS:
            parts = [materialise(_union(parts), "closure")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return distances(edges, roots).select("node")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(reachable(edges, roots), "node", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of undirected edges src, dst; labels spread by neighbour minima and jumps."""
    both = materialise(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both")
    label = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = materialise(step.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        changed = after.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty()
        if changed:
            return after
        label = after


def cycles(edges: DataFrame, most: int = 10) -> DataFrame:
    """Simple cycles of at most `most` nodes as arrays that begin with their least node."""
    e = materialise(edges.select("src", "dst").distinct(), "edges")
    paths, out = e.where("dst >= src").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src").alias("path")), None
    for _ in range(most):
        paths = materialise(paths, "paths")
        closed = paths.where("end = start").select(F.col("path").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        open_ = paths.where("end > start").where(~F.array_contains("path", F.col("end")))
        if open_.isEmpty():
            break
        paths = open_.join(e, open_["end"] == e["src"]).where("dst >= start").select("start", F.col("dst").alias("end"), F.array_append("path", F.col("end")).alias("path"))
        paths = paths.where(F.size("path") <= most)
    return out


def coupling(edges: DataFrame) -> DataFrame:
    """module, ca, ce and instability ce / (ca + ce) for every importing module."""
    ce = edges.groupBy(F.col("src").alias("module")).agg(F.countDistinct("dst").alias("ce"))
    ca = edges.groupBy(F.col("dst").alias("module")).agg(F.countDistinct("src").alias("ca"))
    j = ce.join(ca, "module", "full_outer").fillna(0, ["ca", "ce"])
    return j.withColumn("instability", F.when(F.col("ca") + F.col("ce") == 0, 0.0).otherwise(F.col("ce") / (F.col("ca") + F.col("ce"))))


def layer_of(name, layers: list[tuple[str, list[str], list[str]]]):
    """First layer, in order, one of whose name beginnings fits."""
    out = F.lit(None).cast("string")
    for layer, begins, _ in reversed(layers):
        hit = F.lit(False)
        for b in begins:
            hit = hit | name.startswith(b)
        out = F.when(hit, layer).otherwise(out)
    return out


def layer_violations(edges: DataFrame, layers: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """Edges whose target's layer is not among those that the source's layer may import; unlayered modules never violate."""
    allowed = F.create_map(*[x for name, _, ok in layers for x in (F.lit(name), F.array(*map(F.lit, [name, *ok])))])
    e = edges.withColumns({"src_layer": layer_of(F.col("src"), layers), "dst_layer": layer_of(F.col("dst"), layers)})
    return e.where("src_layer is not null and dst_layer is not null").where(~F.array_contains(allowed[F.col("src_layer")], F.col("dst_layer")))


def levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node and level of a dependency order (src depends on dst): nodes of a level depend on lower ones only; nodes on or above a cycle have none.

    Runs until no node is free; with a bound `most`, more levels are an error.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, parts, level = materialise(nodes, "levels"), [], 0
    while True:
        alive = edges.join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        free = materialise(left.join(alive, "node", "left_anti").withColumn("level", F.lit(level)), "levels")
        if free.isEmpty():
            return _union(parts) if parts else free
        if most is not None and level >= most:
            raise ValueError(f"there are more than {most} levels")
        parts.append(free)
        if len(parts) > PARTS:
            parts = [materialise(_union(parts), "levels")]
        left = materialise(left.join(free.select("node"), "node", "left_anti"), "levels")
        level += 1


def paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, path: a shortest path from the nearest root to every node it reaches, of equal ones the least; breadth first, until no node is new."""
    front = seen = materialise(roots.select("node").distinct().withColumn("path", F.array("node")), "paths")
    while True:
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = materialise(step, "paths")
        if front.isEmpty():
            return seen
        seen = materialise(seen.unionByName(front), "paths")


def infected(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, source: every module that imports a source, directly or not, and the source itself. edges: src imports dst; sources: node.

    Pairs grow by the new ones only, until there is none.
    """
    back = materialise(edges.select(F.col("dst").alias("node"), F.col("src").alias("up")).distinct(), "infected")
    front = seen = materialise(sources.select("node", F.col("node").alias("source")).distinct(), "infected")
    while True:
        step = front.join(back, "node").select(F.col("up").alias("node"), "source").distinct()
        front = materialise(step.join(seen, ["node", "source"], "left_anti"), "infected")
        if front.isEmpty():
            return seen
        seen = materialise(seen.unionByName(front), "infected")


def max_depth(edges: DataFrame) -> int:
    """Edges of the longest chain of imports; parts on a cycle are cut off there."""
    known = levels(edges).agg(F.max("level")).first()[0]
    return known or 0


def abstractness(exports: DataFrame) -> DataFrame:
    """module and the share of its exports that begin with a capital or hold a dot. exports: module, name."""
    type_like = F.col("name").rlike(r"^[A-Z]|\.")
    return exports.groupBy("module").agg(F.avg(type_like.cast("double")).alias("abstractness"))


def main_sequence(coupled: DataFrame, abstract: DataFrame) -> DataFrame:
    """Coupling with abstractness (0 without exports) and the distance from the main sequence, |A + I - 1|."""
    j = coupled.join(abstract, "module", "left").fillna(0.0, ["abstractness"])
    return j.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def by_dependents(files: DataFrame, edges: DataFrame) -> DataFrame:
    """file and dependents (distinct files that need it), most first; ties by file."""
    n = edges.groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("dependents"))
    return files.join(n, "file", "left").fillna(0, ["dependents"]).orderBy(F.desc("dependents"), "file")
