import numpy as np

from sourcelode.llm import boosting, quality_classifier, toxicity


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    s, y = np.round(rng.random(300), 2), (rng.random(300) < 0.4).astype(float)
    iso = boosting.Isotonic.fit(s, y)
    v = iso(np.linspace(0, 1, 101))
    assert (np.diff(v) >= -1e-12).all() and 0 < v.min() and v.max() < 1
    # pool-adjacent-violators by the min-max formula on the distinct scores
    xs = np.unique(s)
    mean = lambda a, b: y[(s >= a) & (s <= b)].mean()
    want = [max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs]
    n_blocks = len({round(w, 9) for w in want})
    assert len(iso.at) == n_blocks


def test_models_learn_thresholds_and_interactions():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    for model in (boosting.BoostedTrees(x[:2000], y[:2000]), boosting.AdditiveModel(x[:2000], y[:2000])):
        assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.9
    gam = boosting.AdditiveModel(x[:2000], y[:2000])
    assert (0, 1) in gam.pairs
    b, c = gam.bins(x[:1]), gam.coarse(x[:1])
    by_hand = gam.start + sum(gam.tables[f, b[0, f]] for f in range(6)) + sum(t[c[0, i] * 8 + c[0, j]] for (i, j), t in zip(gam.pairs, gam.pair_tables))
    assert abs(by_hand - gam.score(x[:1])[0]) < 1e-9


def _corpus(n=240):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, 40))
        toxic = i % 4 == 0
        out.append((i, f"{text} you {'frobber moron snark' if toxic else 'kind'} {text}", int(toxic)))
    return out


def test_toxicity_held_out_and_edge_rows(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, "x", 0.0), (900, None, 0.0), (901, "", 0.0), (5, rows[5][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for run, col in ((toxicity.toxicity, "toxic"), (quality_classifier.quality, "quality")):
        labels = spark.createDataFrame([], f"doc_id long, {col} int")
        assert [r.score for r in run(docs, labels).collect()] == [0.0, 0.0]
        some = spark.createDataFrame([(1, 1)], f"doc_id long, {col} int")
        assert run(docs.limit(0), some).count() == 0


def test_quality_held_out(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(rng.choice(["the", "of", "house", "river", "and", "stone", "is"], 60)) + ". End"
        rows.append((i, text if good else " ".join(["spam***"] * 30 + [text[:20]]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], "doc_id long, text string")
    got = quality_classifier.quality(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == 241 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
