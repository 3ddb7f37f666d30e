"""Operator 3: toxicity from boosted trees over dense features, calibrated isotonically.

Features: densities of two lexicons (whole words, and word beginnings), how
often their words stand near a second-person pronoun, capitals, punctuation
and obfuscation rates. The lexicons are a few fixed seed words and what the
labelled sample shows to occur in toxic rows almost only. Rows are split in
two halves; features of one half use the lexicon of the other, so the trees
see lexicons as good as on new text, and the calibration uses scores from
trees that have not seen the row.

Learns from at most MAX_LABELLED labelled rows (a parameter); scores every row
over its whole text. Edge cases: null and empty texts have all-zero features
and get a score; without labelled rows of both classes the score is the share
of ones, 0 without any; repeated rows repeat; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic, sigmoid
from .common import fold_of, slim, table
from .labelled import MAX_LABELLED, feature_rows, labelled_sample, score_rows

# Seed insults.
SEEDS = (
    "idiot idiots stupid moron morons loser losers pathetic worthless disgusting scum trash clown dumb fool ugly "
    "idiotisch dummkopf blöd imbécile stupide crétin débile estúpido imbécil idiota basura"
).split()
# Second-person pronouns.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*!|+]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
PLAIN = str.maketrans("0134578@$!|+", "oieastbasiit")
BEGIN, NEAR, LEXICON_SIZE = 5, 6, 20_000


class Features:
    """Dense features of a text under given lexicons."""

    def __init__(self, words=(), begins=()):
        self.words, self.begins = frozenset(words) | frozenset(SEEDS), frozenset(begins)

    def __call__(self, text: str) -> np.ndarray:
        n = max(len(text), 1)
        low = text.lower()
        words = WORD.findall(low)
        m = max(len(words), 1)
        hits: list[int] = []
        if not self.words.isdisjoint(words):
            hits = [i for i, w in enumerate(words) if w in self.words]
        begun = [w[:BEGIN] for w in words if len(w) >= BEGIN]
        starts = 0 if self.begins.isdisjoint(begun) else sum(b in self.begins for b in begun)
        near = sum(not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        hidden = [w.strip(".,;:?()").translate(PLAIN) for w in low.split() if OBFUSCATED.search(w)] if OBFUSCATED.search(low) else []
        hidden_hits = sum(w in self.words or w.replace("*", "") in self.words for w in hidden)
        stretched = [w for w in words if STRETCHED.search(w)] if STRETCHED.search(low) else []
        stretched_hits = sum(re.sub(r"(.)\1+", r"\1", w) in self.words for w in stretched)
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return np.array([
            np.log1p(len(hits)), 100 * len(hits) / m, np.log1p(starts), 100 * starts / m, np.log1p(near), 100 * near / m,
            np.log1p(len({words[i] for i in hits})), np.log1p(hidden_hits), 100 * len(hidden) / m, np.log1p(stretched_hits),
            100 * len(stretched) / m, upper / n, text.count("!") / n, text.count("?") / n, (text.count("*") + text.count("#")) / n, np.log1p(m),
        ])


def lexicons(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[int, tuple[list[str], list[str]]]:
    """For half 0, half 1 and both (2): the words and word beginnings that mark toxic rows; at most size entries each."""

    def run(batches):
        counts: dict = {}
        for b in batches:
            for doc_id, text, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = set(WORD.findall((text or "").lower()))
                entry = words | {f"{w[:BEGIN]}-" for w in words if len(w) >= BEGIN}
                counts.setdefault((doc_id & 1, y), Counter()).update(entry)
        for (half, y), c in counts.items():
            yield pa.RecordBatch.from_pydict({"half": pa.array([half] * len(c), pa.int32()), "y": pa.array([y] * len(c), pa.int32()), "w": list(c), "n": pa.array(list(c.values()), pa.int64())})

    c = sample.mapInArrow(run, "half int, y int, w string, n long")
    of = lambda half, y: F.sum(F.when((F.col("half") == half) & (F.col("y") == y), F.col("n")).otherwise(0))
    c = c.groupBy("w").agg(of(0, 1).alias("p0"), of(0, 0).alias("q0"), of(1, 1).alias("p1"), of(1, 0).alias("q1"))
    c = c.withColumns({"p2": F.col("p0") + F.col("p1"), "q2": F.col("q0") + F.col("q1")})
    totals = {r["k"]: r["n"] for r in sample.groupBy(((F.col("doc_id") % 2 != 0).cast("int") * 2 + F.col("y")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = [totals.get(1, 0), totals.get(3, 0)], [totals.get(0, 0), totals.get(2, 0)]
    p, q = [*p, sum(p)], [*q, sum(q)]
    out = {}
    for half in range(3):
        pos, neg = F.col(f"p{half}"), F.col(f"q{half}")
        lift = (pos + 0.5) / (p[half] + 1) * (q[half] + 1) / (neg + 0.5)
        # at least three toxic rows, and almost no other ones
        rows = c.where((pos >= 3) & (pos >= p[half] / 2000) & (lift >= 25)).orderBy(F.desc(pos * F.log(lift)), "w").limit(size).select("w").collect()
        found = [r["w"] for r in rows]
        out[half] = [w for w in found if w[-1] != "-"], [w[:-1] for w in found if w[-1] == "-"]
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, label_col: str = "toxic"):
    """Features and scorer learnt from a bounded labelled sample of docs (doc_id, text)."""
    sample = labelled_sample(docs, labels, label_col, most)
    lexicon = lexicons(sample)
    halves = [Features(*lexicon[0]), Features(*lexicon[1])]
    both = lambda text: np.r_[halves[0](text), halves[1](text)]
    ids, x, y = feature_rows(sample, both)
    features = Features(*lexicon[2])
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return features, lambda x: np.full(len(x), share)
    half, width = ids & 1, x.shape[1] // 2
    crossed = np.where((half == 0)[:, None], x[:, width:], x[:, :width])
    oof = np.zeros(len(y))
    for k in (0, 1):
        learn, test = half != k, half == k
        if len(set(y[learn])) == 2 and test.any():
            oof[test] = BoostedTrees(crossed[learn], y[learn]).score(crossed[test])
    trees, scale = BoostedTrees(crossed, y), Isotonic.fit(oof, y)
    return features, lambda x: 0.98 * scale(s := trees.score(x)) + 0.02 * sigmoid(s)  # the small share keeps an order inside flat steps


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    docs = slim(docs, id_col, text_col)
    features, score = fit(docs, labels, most)
    out = score_rows(docs, features, score)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns; no join back by id."""
    features, score = fit(slim(docs), labels, most)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py() or "") for t in b.column(at)])
                yield b.filter(pa.array(np.clip(score(x), 0.0, 1.0) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
