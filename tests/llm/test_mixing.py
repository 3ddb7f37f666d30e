import hashlib
import math
from collections import defaultdict

import pytest

from sourcelode.llm import mixing as m


def brute(rows, mix):
    """(doc_id, source, n_tokens, epoch) of every draw, source by source."""
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((d, len((t or "").split()), hashlib.md5((t or "").encode()).hexdigest()))
    tokens = {s: sum(x[1] for x in v) for s, v in by.items() if sum(x[1] for x in v)}
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def turn(ok, lo, hi):
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(weights(mid)) else (lo, mid)
        return lo

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    most = lambda w: max(mix.budget * w[s] / p[s] for s in w)
    a = 1.0 if len(p) == 1 else turn(lambda w: entropy(w) >= mix.entropy * math.log(len(p)), 0, 8)
    if len(p) > 1 and most(weights(0)) > mix.repeats:
        a = max(a, turn(lambda w: most(w) > mix.repeats, 0, 1))
    out, target, src = [], math.floor(total * mix.budget), lambda s: "-" if s is None else f"={s}"
    exact = {s: target * w for s, w in weights(round(a, 6)).items()}
    budgets = {s: max(math.floor(x), 1) for s, x in exact.items()}
    left = target - sum(budgets.values())
    for s in sorted(exact, key=lambda s: (-math.floor(exact[s] % 1 * 4096), hashlib.md5(src(s).encode()).hexdigest()))[: max(left, 0)]:
        budgets[s] += 1
    for s, budget in budgets.items():
        for epoch in range(budget // tokens[s] + 1):
            key = lambda d, h: hashlib.md5(f"{mix.seed}|{epoch}|{'null' if d is None else d}|{h}".encode()).hexdigest()  # noqa: E731, B023
            used = epoch * tokens[s]
            for _, n, d in sorted((key(d, h), n, -1 if d is None else d) for d, n, h in by[s]):
                if used < budget:
                    out.append((d, s, n, epoch))
                used += n
    return sorted(out, key=str)


@pytest.mark.parametrize("mix", [m.Mix(), m.Mix(entropy=1.0, repeats=3.0, budget=1.5), m.Mix(entropy=0.5), m.Mix(repeats=1.2, block_tokens=50)])
def test_draws_against_brute_force(spark, mix):
    rows = [(i, "w " * (i * 7 % 23), "big" if i % 3 else ["a", "b", None, ""][i // 3 % 4]) for i in range(150)] + [(None, "x y", "a"), (900, None, "a"), (901, "", "empty")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, epoch int")
    got = m.mixture(docs, mix).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.source, r.n_tokens, r.epoch) for r in got), key=str) == brute(rows, mix)
    assert min(r.block for r in got) == 0
    kept = m.mixed_rows(docs, mix)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got)


def test_blocks_hold_every_source_at_its_weight(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 4 == 0]) for i in range(2000)], "doc_id long, text string, source string")
    got = m.mixture(docs, m.Mix(entropy=0.9, block_tokens=4000)).toPandas()
    share = got.groupby(["block", "source"]).n_tokens.sum().unstack()
    assert len(share) == 5 and (abs(share.div(share.sum(axis=1), axis=0) - share.sum() / share.values.sum()) < 0.02).values.all()


def test_empty_single_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string"
    assert m.mixture(spark.createDataFrame([], schema)).count() == 0
    assert m.mixture(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    assert sorted(r.doc_id for r in m.mixture(spark.createDataFrame([(1, "a b", "s")] * 3 + [(2, "c", "s")], schema)).collect()) == [1, 1, 1, 2]


def test_small_sources_keep_their_budgets(spark):
    """Shares of 1e-7 and 1.2e-6 beside a large source, and many sources whose weights six decimals cannot hold."""
    rows = [(f"{i}", "=big", 1_000_000) for i in range(10)] + [("100", "=tiny", 1), *((f"{200 + i}", "=small", 4) for i in range(3))]
    rows = spark.createDataFrame(rows, "key string, src string, n_tokens long")
    planned = m.plan(rows, m.Mix())
    got = {r.src: r.budget for r in planned.collect()}
    a = 1 + math.log(2) / math.log(1e-7)  # the repeat limit of 2 is met by the smallest source
    assert got["=tiny"] == 2 and abs(got["=small"] - 1e7 * 1.2e-6**a) < 1 and sum(got.values()) == 10_000_013
    drawn = sorted(r.key for r in m.draws(rows, planned).where("src <> '=big'").collect())
    assert drawn == sorted(["100", "200", "201", "202"] * 2)

    many = spark.range(3000).selectExpr("string(id) AS key", "concat('=', id) AS src", "10L AS n_tokens")
    budgets = [r.budget for r in m.plan(many, m.Mix()).collect()]
    assert set(budgets) == {10} and len(budgets) == 3000
    budgets = [r.budget for r in m.plan(many, m.Mix(budget=0.25)).collect()]
    assert set(budgets) == {2, 3} and sum(budgets) == 7500
    assert {r.budget for r in m.plan(many, m.Mix(budget=0.01)).collect()} == {1}


def test_300_000_sources_of_one_word(spark):
    docs = spark.range(300_000).selectExpr("id AS doc_id", "'w' AS text", "string(id) AS source")
    assert m.mixture(docs).count() == 300_000


def test_own_columns_stay_and_blocks_are_whole(spark):
    rows = [(None if i % 5 == 0 else i, "w " * 10, "ab"[i % 4 == 0], 7, "mine", i, 2.5, True) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int, src string, full int, times double, cut boolean")
    got = m.mixed_rows(docs, m.Mix(block_tokens=500)).collect()
    want = m.mixture(docs, m.Mix(block_tokens=500)).collect()
    assert {(r.epoch, r.src, r.times, r.cut) for r in got} == {(7, "mine", 2.5, True)}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in want)
    assert {tuple(r) for r in got} <= set(rows)
    docs = docs.withColumnRenamed("epoch", "block").withColumnRenamed("full", "place").withColumnRenamed("times", "key").withColumnRenamed("src", "reach")
    assert m.mixed_rows(docs).columns == docs.columns and m.mixed_rows(docs).count() == len(m.mixture(docs).collect())
