import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from sourcelode.llm import lm_scoring as m


def brute(rows):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = tok(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, base))
    return out


def _rows():
    rnd = random.Random(9)
    words = ["The", "of", "Über", "x1", "a", "b"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 80)))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)]
    return rows + [(None, "the null id"), (2000, None), (2001, ""), (2002, " \n"), (2003, "w1 " * 20_000), (7, rows[7][1]), (7, "another text")]


def test_exact_columns_against_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = m.lm_scores(docs).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    a = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    b = sorted(brute(rows), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string").repartition(3)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6))
    a, b = (sorted(m.lm_scores(docs, max_filter_mb=mb).collect(), key=key) for mb in (128, 0))
    assert len(a) == len(_rows()) and [r[:5] for r in a] == [r[:5] for r in b]
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-12)


def test_model_beats_the_base_on_held_out_sequences(spark):
    rnd = random.Random(1)
    follow = {f"w{i}": [f"w{rnd.randrange(300)}" for _ in range(3)] for i in range(300)}
    rows = []
    for i in range(1500):
        w, out = f"w{rnd.randrange(300)}", []
        for _ in range(60):
            out.append(w)
            w = rnd.choice(follow[w])
        rows.append((i, " ".join(out)))
    got = [r for r in m.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 80 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_filter_levels_never_fall_short_and_rarely_exceed():
    rng = np.random.default_rng(5)
    h, counts = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(1, 200, 20_000)
    f = m.Filter(0, {0: m.segment(h, counts)}, 64)
    got, want = f.levels(h), m.level_of(counts)
    assert (got >= want).all() and (got > want).mean() < 0.05
    assert (f.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.05
    q = m.level_of(np.arange(1, 5000))
    assert (np.diff(q) >= 0).all() and (m.VALUE[q] / np.arange(1, 5000) < 1.5).all() and (m.VALUE[q] / np.arange(1, 5000) > 1 / 1.5).all()


def test_empty_and_untrained(spark):
    assert m.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = m.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score == 0.0


def test_many_shards_send_sparse_sums(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_BYTES", 400)
    rows = _rows()
    got = m.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    a, b = sorted([tuple(r)[:6] for r in got], key=key), sorted(brute(rows), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9)


def test_a_large_filter_is_asked_once_for_each_hash(spark, monkeypatch):
    """The levels of both kinds come from counting: texts are read no second time, and no hash is sent again."""
    docs = spark.createDataFrame([(i, f"a w{i % 7} b w{i % 5} a b") for i in range(300)], "doc_id long, text string").repartition(3)
    made, keep = [], m.materialise
    monkeypatch.setattr(m, "materialise", lambda df, label, **options: (made.append(label), keep(df, label, **options))[1])
    got = sorted(m.lm_scores(docs, max_filter_mb=0).collect())
    assert made == ["lm-counts", "lm-levels"]
    monkeypatch.setattr(m, "TEXT_A_FILTER", 10**9)  # the bound is found out only after counting
    late = sorted(m.lm_scores(docs, max_filter_mb=0).collect())
    assert [(r.doc_id, round(r.score, 9)) for r in late] == [(r.doc_id, round(r.score, 9)) for r in got]
    assert [(r.doc_id, round(r.score, 9)) for r in sorted(m.lm_scores(docs).collect())] == [(r.doc_id, round(r.score, 9)) for r in got]
