"""Operator 4: quality rules as one Spark projection.

A threshold table (metric, least, most) is compiled into a single boolean
expression over length, symbol, stop-word and line ratios. All of it is
built-in column functions: no user function, no shuffle, one pass over the text.

Edge cases: a null or empty text has no words, hence counts of zero and
base_failed; a text of any length is taken whole; repeated rows give repeated
result rows; an empty table gives an empty result; further columns of the
input are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
CAPITALS = "".join(map(chr, [*range(ord("A"), ord("Z") + 1), *range(ord("À"), ord("Þ") + 1)])).replace("×", "")

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this at from or are have not "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui dans pour par sur est pas au "
    "el los las del y se no por con su para es lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the metric must lie in [least, most]."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The default threshold table.
RULES = (
    Rule("word_count", "n_words", least=20),
    Rule("mean_word_length", "mean_word_length", least=2.0, most=14.0),
    Rule("symbol_ratio", "symbol_ratio", most=0.2),
    Rule("stop_words", "stop_ratio", least=0.03),
    Rule("duplicate_lines", "dup_line_ratio", most=0.4),
    Rule("repeated_words", "repeat_ratio", most=0.3),
    Rule("upper_case", "upper_ratio", most=0.5),
)


def _repeat_words(h: Column) -> Column:
    """Words covered by windows (given by their hashes) that occur twice or more.

    Texts without any repeated window stop at the distinct count; the others
    sort their windows, so even one very long text costs n log n.
    """

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        starts = F.array_sort(
            F.filter(
                F.transform(
                    pairs,
                    lambda e, i: F.when(
                        ((i > 0) & (F.get(pairs, i - 1)["h"] == e["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == e["h"])),
                        e["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(
            starts,
            start,
            lambda a, d: F.struct((d + WINDOW).alias("end"), (a["total"] + d + WINDOW - F.greatest(a["end"], d)).alias("total")),
            lambda a: a["total"],
        )

    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    bound = F.transform(F.array(pairs), covered)[0]  # binds the sorted array once
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Per document the counts and ratios that rules can refer to; carry comes out as the column row."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), (F.lit(None) if carry is None else carry).alias("row"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.select("doc_id", "text", "row", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))
    )
    d = d.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("long").alias("n_upper"),
        F.when(F.size("words") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    d = d.withColumn("n_repeat_words", _repeat_words(F.col("h")).cast("long")).drop("h")
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return d.select(
        "*",
        per_word("word_chars").alias("mean_word_length"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_ratio"),
        per_word("n_stop_words").alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        per_word("n_repeat_words").alias("repeat_ratio"),
        (F.col("n_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_ratio"),
    )


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean column over measure()'s columns."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.metric) >= F.lit(r.least))
        if r.most is not None:
            out = out & (F.col(r.metric) <= F.lit(r.most))
    return out


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """measure() with base_failed and the verdict kept."""
    m = measure(docs, id_col, text_col, carry)
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return m.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    q = quality_rules(docs, rules, carry=F.struct(*[docs[c] for c in docs.columns]))
    # a non-deterministic part keeps the filter above the projection; below it, every use of a count would be its whole expression
    return q.withColumn("kept", F.col("kept") & (F.spark_partition_id() >= 0)).where("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(rules=RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = " AND ".join(
        f"{r.metric} {sign} {value!r}" for r in rules for sign, value in ((">=", r.least), ("<=", r.most)) if value is not None
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_upper,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), r AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(word_chars, 1) AS symbol_ratio,
    n_stop / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio,
    (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {tests}) AS kept FROM r"""


ORACLE = _sql()
