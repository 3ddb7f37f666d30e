"""Operator 9: mixing sources to target weights by temperature.

Shares of tokens by source are raised to an exponent and normalised. The
exponent is bisected, many ways at a time, until the weights have the target
entropy; where that would repeat some source more often than allowed, a second
bisection raises the exponent until the limit holds. Weights times the token
budget give each source's budget, which is realised as whole permutations of
its documents (epochs) and one permutation cut at the budget. Positions within
these permutations, as shares of the source's budget, deal the draws into
blocks, so each block holds every source at its weight.

The exponent is rounded to six decimals, weights are not rounded at all. Budgets
are whole tokens by largest remainder (told apart to a 4096th, then by a hash of
the source), so they add up to the target; every source with tokens has a
budget of one token at least, hence a document, and only where many sources
would get less than that do the budgets exceed the target.

Only DataFrame operations. A permutation is an order by md5 of seed, epoch, id
and text. No window ever spans a source: tokens are summed by a prefix of the hash
first, prefix sums run over at most 4096 such rows a source and epoch, and
only rows of one prefix are put in order, so a source with a third of all
rows is spread like any other.

Edge cases: null sources form one source of their own; null or empty texts
have no tokens and are drawn wherever their place comes up at no cost; a source
without any tokens has weight zero and is not drawn; repeated rows are drawn
each, and those equal in id and text share one place; an empty table gives an
empty result; further columns, whatever their names, are ignored by mixture()
and kept as they are by mixed_rows().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slim, table, words_of

PREFIX, WAYS, HIGHEST, STEPS = 3, 64, 8.0, 4096


@dataclass(frozen=True)
class Mix:
    """Target of a mix: entropy as a share of the largest possible, most repeats of a source, budget as a multiple of all tokens."""

    entropy: float = 0.97
    repeats: float = 2.0
    budget: float = 1.0
    block_tokens: int = 1_000_000
    seed: int = 17


def identity(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: the id and a digest of the text."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def place(seed: int, epoch: Column, key: Column) -> Column:
    """Key that orders a permutation; key is the identity of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def _source(source: Column) -> Column:
    """Sources as text that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key, source, src, n_tokens of every row of docs (doc_id, text, source)."""
    return docs.select("doc_id", identity(F.col("doc_id"), F.col("text")).alias("key"), "source", _source(F.col("source")).alias("src"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))


def _bisect(shares: DataFrame, low: float, high: float, above) -> float:
    """Where above(row), true at low and false at high, turns; row has z, s, m of one exponent a."""
    while high - low > 1e-9:
        grid = F.transform(F.sequence(F.lit(0), F.lit(WAYS)), lambda i: F.lit(low) + i * F.lit((high - low) / WAYS))
        p = F.col("p")
        rows = shares.select("p", F.explode(grid).alias("a")).groupBy("a").agg(
            F.sum(F.pow(p, "a")).alias("z"), F.sum(F.pow(p, "a") * F.log(p)).alias("s"), F.max(F.pow(p, F.col("a") - 1)).alias("m")
        ).orderBy("a").collect()  # one row per exponent of the grid
        held = [i for i, r in enumerate(rows) if above(r)]
        k = min(held[-1] if held else 0, WAYS - 1)
        low, high = rows[k]["a"], rows[k + 1]["a"]
    return (low + high) / 2


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The exponent for sources (src, tokens), rounded to six decimals."""
    return round(_exponent(sources, mix), 6)


def _exponent(sources: DataFrame, mix: Mix) -> float:
    known = sources.where("tokens > 0")
    all_tokens, n = known.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    shares = known.select((F.col("tokens") / F.lit(float(all_tokens))).alias("p"))
    goal = mix.entropy * math.log(n)
    a = _bisect(shares, 0.0, HIGHEST, lambda r: math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= goal)
    repeats = lambda r: mix.budget * r["m"] / r["z"] > mix.repeats
    if mix.budget >= mix.repeats:
        return max(a, 1.0)  # even the plain shares repeat more often than asked for
    least = _bisect(shares, 0.0, 1.0, repeats) if _repeats_at(shares, 0.0, mix) > mix.repeats else 0.0
    return max(a, least)


def _repeats_at(shares: DataFrame, a: float, mix: Mix) -> float:
    z, m = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow("p", F.lit(a - 1)))).first()
    return mix.budget * m / z


def _budgets(weighed: DataFrame, target: int) -> DataFrame:
    """weighed (src, tokens, weight) with the budget of every source: whole tokens by largest remainder, one at least.

    Which sources get one more is found by counts: by step of the remainder, in
    the step where the tokens run out by prefix of the hash, and in that prefix
    by rank; so no window holds more than one prefix of one step.
    """
    exact = F.lit(float(target)) * F.col("weight")
    rest = (F.col("exact") - F.floor("exact")) * STEPS
    rows = weighed.withColumn("exact", exact).withColumns({"step": -F.floor(rest).cast("int"), "hash": F.md5(F.col("src").cast("binary"))})
    rows = rows.withColumns({"base": F.greatest(F.floor("exact"), F.lit(1)).cast("long"), "prefix": F.substring("hash", 1, PREFIX)})
    rows = materialise(rows, "weights")
    left = target - (rows.agg(F.sum("base")).first()[0] or 0)
    more = F.lit(False)
    if left > 0:
        step, before = _crossing(rows, "step", left)
        prefix, before = _crossing(rows.where(F.col("step") == step), "prefix", left - before, before)
        last = rows.where((F.col("step") == step) & (F.col("prefix") == prefix)).orderBy("hash", "src").limit(left - before).agg(F.max(F.struct("hash", "src")).alias("x")).first()["x"]
        inside = F.struct("hash", "src") <= F.struct(F.lit(last["hash"]).alias("hash"), F.lit(last["src"]).alias("src"))
        more = (F.col("step") < step) | ((F.col("step") == step) & ((F.col("prefix") < prefix) | ((F.col("prefix") == prefix) & inside)))
    return rows.select("src", "tokens", "weight", (F.col("base") + more.cast("long")).alias("budget"))


def _crossing(rows: DataFrame, by: str, left: int, before: int = 0) -> tuple:
    """The least value of by up to which there are `left` rows (or the largest value), and how many stand before it, added to before."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).collect()  # STEPS or 16 ** PREFIX rows at most
    for r in counts:
        if left <= r["n"] or r is counts[-1]:
            return r[by], before
        left, before = left - r["n"], before + r["n"]


def plan(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: weight, budget, full (whole epochs), rest (tokens of the cut epoch) and cut (its last place, or null).

    rows: key, src, n_tokens, as sizes() gives them, already materialised.
    """
    sources = materialise(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens")), "sources")
    known = sources.where("tokens > 0")
    total = known.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return known.select("src", "tokens", *(F.lit(None).cast(t).alias(c) for c, t in (("weight", "double"), ("budget", "long"), ("full", "long"), ("rest", "long"), ("cut", "string"))))
    a = exponent(sources, mix)
    raised = known.withColumn("x", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)))
    z = raised.agg(F.sum("x")).first()[0]
    budgets = _budgets(raised.select("src", "tokens", (F.col("x") / F.lit(z)).alias("weight")), math.floor(total * mix.budget))
    budgets = budgets.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    budgets = materialise(budgets.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "budgets")
    keyed = rows.join(budgets.where("rest > 0").select("src", "full", "rest"), "src").withColumn("place", place(mix.seed, F.col("full"), F.col("key")))
    keyed = keyed.withColumn("prefix", F.substring("place", 1, PREFIX))
    sums = keyed.groupBy("src", "prefix", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("src").orderBy("prefix"))
    crossing = sums.withColumn("before", upto - F.col("n")).where("before < rest").groupBy("src").agg(F.max_by(F.struct("prefix", "before"), "prefix").alias("x"))
    crossing = crossing.select("src", F.col("x.prefix").alias("prefix"), F.col("x.before").alias("before"))
    inside = keyed.join(crossing, ["src", "prefix"])
    order = Window.partitionBy("src", "prefix").orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    cuts = inside.where("start < rest").groupBy("src").agg(F.max("place").alias("cut"))
    return materialise(budgets.join(cuts, "src", "left"), "plan")


def draws(rows: DataFrame, planned: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """rows (with key and src) once per epoch that draws them, with the columns epoch, place and reach (the place among all draws of its source, 0 to 1, expected from the hash). No shuffle of rows if the plan is small."""
    planned = planned.select("src", "tokens", "budget", "full", "cut")
    of = rows.join(planned, "src")
    times = F.col("full") + F.coalesce(place(mix.seed, F.col("full"), F.col("key")) <= F.col("cut"), F.lit(False)).cast("long")
    of = of.withColumn("times", times).where("times > 0")
    of = of.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    of = of.withColumn("place", place(mix.seed, F.col("epoch"), F.col("key")))
    reach = (F.col("epoch") + F.conv(F.substring("place", 1, 12), 16, 10).cast("double") / 16.0**12) * F.col("tokens") / F.col("budget")
    return of.withColumn("reach", reach).drop("times", "tokens", "budget", "full", "cut")


def mixture(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per draw: doc_id, source, n_tokens, epoch, block, place (orders the draws of a block)."""
    rows = materialise(sizes(slim(docs, id_col, text_col, source=source_col)), "sizes")
    planned = plan(rows, mix)
    out = draws(rows, planned, mix)
    out = out.withColumn("prefix", F.substring("place", 1, PREFIX))
    sums = out.groupBy("src", "epoch", "prefix").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("src", "epoch").orderBy("prefix"))
    sums = sums.select("src", "epoch", "prefix", (upto - F.col("n")).alias("before"))
    sums = sums.join(planned.select("src", "tokens", "budget"), "src")
    order = Window.partitionBy("src", "epoch", "prefix").orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(sums, ["src", "epoch", "prefix"])
    n_blocks = planned.agg(F.ceil(F.sum("budget") / F.lit(float(mix.block_tokens))).alias("n")).first()["n"] or 1
    done = (F.col("epoch") * F.col("tokens") + F.col("before") + F.col("inside")) / F.col("budget")
    block = F.least(F.floor(done * F.lit(float(n_blocks))), F.lit(n_blocks - 1)).cast("long")
    return out.select("doc_id", "source", "n_tokens", "epoch", block.alias("block"), "place")


def mixed_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn rows of documents with their own columns, a row per draw, dealt into blocks of about mix.block_tokens.

    The rows of a block stand together, in the order of the permutations. A
    draw's block follows from its expected place, so texts are shuffled once.
    """
    rows = materialise(sizes(slim(docs, "doc_id", "text", source="source")), "sizes")
    planned = plan(rows, mix)
    n_blocks = planned.agg(F.ceil(F.sum("budget") / F.lit(float(mix.block_tokens))).alias("n")).first()["n"] or 1
    own = F.struct(*[docs[c] for c in docs.columns]).alias("own")  # apart from the columns used here
    keyed = docs.select(own, identity(docs["doc_id"], docs["text"]).alias("key"), _source(docs["source"]).alias("src"))
    out = draws(keyed, planned, mix).withColumn("block", F.least(F.floor(F.col("reach") * n_blocks), F.lit(n_blocks - 1)))
    return out.repartition("block").sortWithinPartitions("block", "reach", "place").select("own.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def sql(mix: Mix = Mix()) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS key, source, coalesce('=' || source, '-') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), s AS (SELECT src, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY src HAVING sum(n_tokens) > 0),
t AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM s),
p AS (SELECT list(tokens / total) AS ps, max(n) AS n FROM s, t),
b1(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, {HIGHEST}::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, ln(list_sum([pow(x, (lo + hi) / 2) for x in ps]))
      - (lo + hi) / 2 * list_sum([pow(x, (lo + hi) / 2) * ln(x) for x in ps]) / list_sum([pow(x, (lo + hi) / 2) for x in ps])
      >= {mix.entropy} * ln(n) AS up FROM b1, p WHERE i < 50)
), b2(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, {mix.budget} * list_max([pow(x, (lo + hi) / 2 - 1) for x in ps]) / list_sum([pow(x, (lo + hi) / 2) for x in ps]) > {mix.repeats} AS up FROM b2, p WHERE i < 50)
), a AS (
  SELECT round(CASE WHEN n = 1 THEN 1.0 ELSE greatest((SELECT (lo + hi) / 2 FROM b1 WHERE i = 50),
    CASE WHEN {mix.budget} * list_max([1 / x for x in ps]) / n > {mix.repeats} THEN (SELECT (lo + hi) / 2 FROM b2 WHERE i = 50) ELSE 0 END) END, 6) AS a FROM p
), w AS (
  SELECT src, tokens, floor(total * {mix.budget}) * (pow(tokens / total, a) / sum(pow(tokens / total, a)) OVER ()) AS exact, floor(total * {mix.budget}) AS target FROM s, t, a
), g AS (
  SELECT src, tokens, greatest(floor(exact), 1)::BIGINT
    + CASE WHEN row_number() OVER (ORDER BY floor((exact - floor(exact)) * {STEPS}) DESC, md5(src), src) <= target - sum(greatest(floor(exact), 1)) OVER () THEN 1 ELSE 0 END AS budget FROM w),
e AS (SELECT src, tokens, budget, unnest(range(0, budget // tokens + 1)) AS epoch FROM g),
x AS (
  SELECT d.doc_id, d.source, d.n_tokens, e.*, md5('{mix.seed}|' || epoch || '|' || key) AS place FROM d JOIN e USING (src)
), c AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY place, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x
), n AS (SELECT ceil(sum(budget) / {float(mix.block_tokens)}) AS n FROM g)
SELECT doc_id, source, n_tokens, epoch, least(floor(start / budget * n), n - 1)::BIGINT AS block, place FROM c, n WHERE start < budget"""


ORACLE = sql()
