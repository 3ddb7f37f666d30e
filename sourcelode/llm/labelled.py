"""Bounded samples of labelled rows, and the pass that scores every row with a fitted model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, materialise

#: Most labelled rows that a model is fitted on.
MAX_LABELLED = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int = MAX_LABELLED, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, text, y of at most `most` labelled ids, none of them held out.

    docs has doc_id and text. Which ids are taken follows a hash of the id. An
    id labelled twice counts as 1 if any label is 1; null ids and labels drop out;
    of several texts of an id the least one counts. Written once, read often.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most `most` narrow rows
    return materialise(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled-texts")


def feature_rows(sample: DataFrame, features: Callable[[str], np.ndarray], more: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, features and y of a bounded sample, one row an id, in id order."""

    def run(batches):
        for b in batches:
            xs = [features(t.as_py() or "").tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "y"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x array<double>, y int").collect()
    rows.sort(key=lambda r: r["doc_id"])
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    return ids, np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)


def score_rows(docs: DataFrame, features: Callable[[str], np.ndarray], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(1)])
            s = np.clip(score(x), 0.0, 1.0) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
