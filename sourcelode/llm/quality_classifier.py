"""Operator 7: quality from a generalised additive model with pairwise terms.

Cyclic boosting of shallow trees learns one lookup table per feature and a few
tables for pairs of features; a score adds up the entries of a row's bins,
vectorised over a batch. The model learns from at most MAX_LABELLED labelled
rows (a parameter) and scores every row over its whole text.

Edge cases: null and empty texts have all-zero features and get a score;
without labelled rows of both classes the score is the share of ones, 0 without
any; repeated rows repeat; empty tables give an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import AdditiveModel, sigmoid
from .common import fold_of, slim, table
from .labelled import MAX_LABELLED, feature_rows, labelled_sample, score_rows
from .quality_rules import STOP_WORDS, SYMBOLS

_STOP = frozenset(STOP_WORDS)
_WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


def features(text: str) -> np.ndarray:
    """Dense features of a text's form."""
    words = _WORD(text)
    n, m = max(len(text), 1), max(len(words), 1)
    count = lambda chars: sum(map(text.count, chars)) / n
    symbols, capitals, digits, points, marks = map(count, (SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?"))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    triples = max(len(words) - 2, 0)
    same = sum(map(str.__eq__, words, words[1:]))
    return np.array([
        np.log1p(len(words)), sizes.mean() if len(words) else 0.0, sizes.std() if len(words) else 0.0, symbols,
        sum(map(_STOP.__contains__, words)) / m, (len(lines) - len(set(lines))) / max(len(lines), 1), capitals, points, marks, digits,
        len(set(words)) / m, 1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples else 0.0, same / m,
        np.log1p(len(text) / max(len(lines), 1)),
    ])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, label_col: str = "quality"):
    """A scorer for rows of features, learnt from a bounded labelled sample of docs (doc_id, text)."""
    _, x, y = feature_rows(labelled_sample(docs, labels, label_col, most), features)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return lambda x: np.full(len(x), share)
    model = AdditiveModel(x, y)
    return lambda x: sigmoid(model.score(x))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    docs = slim(docs, id_col, text_col)
    out = score_rows(docs, features, fit(docs, labels, most))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
