"""Operator 6: SimHash near-duplicates with pivot distance tables.

Fingerprints are cut into six blocks. Two fingerprints that differ in at most
three bits agree in three blocks at least, so every link shows up in one of the
twenty bucketings by three blocks (about 32 bits each); no other pair is looked
at. Inside a bucket the method proper works: Hamming distances to many
reference fingerprints are computed once per row, a pair is discarded when any
of these coordinates differs by more than three (triangle inequality), and
survivors are verified by their own distance. A task hands on a spanning forest
of its links, never all pairs. Components come from alternating large-star and
small-star rounds over those forests, each written to the shared folder.

Exact copies share one fingerprint and enter the search once. A bucket of more
than BIG different fingerprints is cut into stripes by a hash, and every pair of
stripes is a bucket of its own, so no task gets a whole one.

Edge cases: null, empty or blank text has fingerprint zero and links like any
other; one or two words give one shingle of the whole sequence; a null doc_id
keeps its row and is no candidate for a component id (which is null only when
every reachable id is); repeated rows stay; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FOLD, materialise, slim, table

BITS, MOST, SHINGLE, SEED = 64, 3, 3, 42
N_PIVOTS, STEP, BIG = 32, 1024, 20_000
_WIDTHS = (11, 11, 11, 11, 10, 10)


def _masks() -> list[int]:
    """The twenty masks that keep three of the six blocks, as signed longs."""
    blocks, at = [], 0
    for w in _WIDTHS:
        blocks.append(((1 << w) - 1) << at)
        at += w
    keep = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in keep]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return 0
    if len(words) < shingle:
        return h(b" ".join(words), SEED)
    hashes = np.array([h(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""
    docs = slim(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to the pivots, one row per pivot."""
    return np.bitwise_count(fps[None, :] ^ pivots()[:, None]).astype(np.int8)


def _survivors(fps, dist, i, j):
    """Those of the pairs (i, j) that the pivots do not discard and their own distance confirms."""
    for row in dist:
        keep = np.abs(row[i] - row[j]) <= MOST
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= MOST
    return i[keep], j[keep]


class Forest:
    """Smallest label reachable, for rows of one array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i, j) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def linked(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among rows that share a bucket; rows of a bucket stand together."""
    dist, n = pivot_table(fps), len(fps)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    forest = Forest(n)
    small = np.repeat(sizes <= STEP, sizes)
    at = np.flatnonzero(small)
    for d in range(1, int(sizes[sizes <= STEP].max(initial=1))):
        at = at[at + d < n]
        at = at[bucket[at] == bucket[at + d]]
        forest.add(*_survivors(fps, dist, at, at + d))
    for start, size in zip(starts[sizes > STEP], sizes[sizes > STEP]):
        for a in range(start, start + size, STEP):
            rows = np.arange(a, min(a + STEP, start + size))
            for b in range(a, start + size, STEP):
                cols = np.arange(b, min(b + STEP, start + size))
                near = np.ones((len(rows), len(cols)), bool)
                for p in dist[:4]:
                    near &= np.abs(p[rows][:, None] - p[cols][None, :]) <= MOST
                i, j = np.nonzero(near)
                up = rows[i] < cols[j]
                forest.add(*_survivors(fps, dist[4:], rows[i][up], cols[j][up]))
    child = np.flatnonzero(forest.label != np.arange(n))
    return fps[child], fps[forest.label[child]]


def _striped(rows: DataFrame, big: int) -> DataFrame:
    """rows (bucket, fp) with the buckets of more than big rows dealt out as pairs of stripes of about big / 2 rows."""
    large = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > big), "large-buckets")
    if large.isEmpty():
        return rows
    large = large.select(F.col("bucket").alias("of"), F.ceil(F.col("n") * 2 / big).cast("long").alias("stripes"))
    rows = rows.join(large, rows["bucket"] == large["of"], "left").withColumn("mine", F.pmod(F.xxhash64("fp", F.lit("stripe")), "stripes"))
    other = F.explode(F.coalesce(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1), F.array(F.lit(0).cast("long"))))
    rows = rows.withColumn("other", other)
    bucket = F.when(F.col("of").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    return rows.select(bucket.alias("bucket"), "fp")


def links(fps: DataFrame, big: int = BIG) -> DataFrame:
    """Spanning links (u, v) among the distinct fingerprints in column fp, those at distance 3 or less."""
    keys = F.array(*[F.struct(F.lit(c).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(_masks())])
    rows = fps.select("fp", F.explode(keys).alias("x")).select(F.xxhash64("x.c", "x.k").alias("bucket"), "fp")

    rows = _striped(rows, big)

    def run(batches):
        bucket, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            bucket = np.r_[bucket, b.column(0).to_numpy()]
            fp = np.r_[fp, b.column(1).to_numpy().view(np.uint64)]
            whole = np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0  # the last bucket may go on
            yield emit(bucket[:whole], fp[:whole])
            bucket, fp = bucket[whole:], fp[whole:]
        yield emit(bucket, fp)

    def emit(bucket, fp):
        same = bucket[1:] == bucket[:-1]
        several = np.r_[same, False] | np.r_[False, same] if len(bucket) else np.empty(0, bool)
        u, v = linked(bucket[several], fp[several]) if several.any() else (fp[:0], fp[:0])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (u, v) reaches; distributed, any depth."""
    spark = edges.sparkSession
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum((F.xxhash64("v", "u") / 4096).cast("long")).alias("s")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = materialise(small, "links")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id for every row of docs."""
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "firsts")
    roots = materialise(components(links(firsts.select("fp"))), "roots")
    grouped = firsts.join(roots, firsts["fp"] == roots["node"]).select("fp", "root", "first_id")
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = grouped.join(ids, "root").select("fp", "component_id")
    final = firsts.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return fps.join(materialise(final, "classes"), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each near-duplicate component: the one of least id (a null id only if there is no other).

    Rows are told apart by id and text; of rows equal in both the one stays whose
    other columns have the least hash. Columns of any name are kept as they are.
    """
    key = F.struct(docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"], F.lit(0)).alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    near = near_duplicates(docs.select(key.alias("doc_id"), docs["text"].alias("text")))
    stay = near.where("doc_id = component_id").select(F.col("doc_id.none").alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.h").alias("h"))
    own = F.struct(*[docs[c] for c in docs.columns])
    rest = F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"])))
    keyed = docs.select(own.alias("own"), rest.alias("rest"), *(key[c].alias(c) for c in ("none", "id", "h")))
    kept = keyed.join(stay, ["none", "id", "h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("none", "id", "h").orderBy("rest"))
    return kept.withColumn("first", first).where("first = 1").select("own.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
