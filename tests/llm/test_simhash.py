import random
import re

import numpy as np
import xxhash

from sourcelode.llm import simhash as s


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_against_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["The", "a", "of", "über", "x1", "É", "b"]) for _ in range(60)) for _ in range(12)]
    texts = [None, "", " \n", "One", "one two", "ONE two"] + base
    for t in base:
        w = t.split()
        for k in (5, 20, 40):
            texts.append(" ".join(w[:k] + ["zz"] + w[k + 1 :]))
    texts += base[:4] * 3 + ["w " * 5000]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [brute_fp(t) for _, t, _ in rows]
    assert [got[i].fp % (1 << 64) for i, _, _ in rows] == fps
    assert [got[i].component_id for i, _, _ in rows] == [rows[k][0] for k in brute_components(fps)]


def test_large_bucket_and_chains():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 64, 1, np.uint64)[0]
    flips = np.array([centre ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (2500, 2))], np.uint64)
    fps = np.unique(np.r_[flips, rng.integers(0, 1 << 64, 50, np.uint64)])
    u, v = s.linked(np.zeros(len(fps), np.int64), fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    forest = s.Forest(len(fps))
    forest.add(*np.nonzero(near))
    pos = {int(x): i for i, x in enumerate(fps)}
    mine = s.Forest(len(fps))
    mine.add(np.array([pos[int(x)] for x in u]), np.array([pos[int(x)] for x in v]))
    assert np.array_equal(forest.label, mine.label)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in s.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "lonely words stand here"), (5, "a b c d")]
    got = sorted((r.component_id is None, r.component_id or 0) for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 5)] * 3 + [(True, 0)]
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_striped_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (400, 2))], np.int64))
    roots = {r.node: r.root for r in s.components(s.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), big=30)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    forest = s.Forest(len(fps))
    forest.add(*np.nonzero(near))
    groups = {}
    for x in fps.tolist():
        groups.setdefault(roots.get(x, x), set()).add(x)
    want = {}
    for x, label in zip(fps.tolist(), forest.label.tolist()):
        want.setdefault(label, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_keeps_clashing_columns_and_breaks_ties(spark):
    rows = [(1, "a b c d", 9, "x", 1.5, 3), (1, "a b c d", 2, "y", 0.5, 4), (2, "a b c d", 2, "y", 0.5, 4), (None, "zz yy xx", 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, none string, h double, rest int")
    once, again = s.one_of_each(docs), s.one_of_each(docs.repartition(3))
    assert once.columns == docs.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "None"]
