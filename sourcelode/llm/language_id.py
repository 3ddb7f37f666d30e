"""Operator 2: language identification of web pages by Bayesian evidence fusion.

A page's language is the one with the largest posterior of
  text likelihood     letter trigrams of the visible text, under tables learnt
                      from a bounded sample of documents with a known language;
                      the log likelihood per trigram counts as often as the root
                      of the number of trigrams, as neighbours depend on each other,
  declared language   the html element's lang; how declarations follow languages
                      is estimated over all pages,
  address prior       shares of languages at the page's host, smoothed towards
                      those of its domain, of its address suffix and of all pages
                      in turn, with the page itself left out.
The counts behind declarations and priors are sums of the text posteriors of all
pages, by grouped aggregation; only narrow rows are joined back by host.

Edge cases: null or empty html has no text evidence and none declared, so the
prior decides; a null or odd url belongs to an empty host; a null page_id keeps
its row; repeated rows count each; ties go to the language first in the
alphabet; without documents of known language lang is null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread_sample, table

SAMPLE_DOCS, SIDE, SMOOTH, HOST_PULL = 2000, 64, 0.5, 4.0
# Letters with a symbol of their own; others share the symbols after them.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøùúûüßœ"
# Elements whose content is not shown.
UNSHOWN = ("script", "style", "noscript", "template", "nav")
OPENING = re.compile(rf"<(?:(!--)|({'|'.join(UNSHOWN)})\b)?", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNSHOWN} | {"!--": re.compile("-->"), "": re.compile(">")}


def _symbols() -> np.ndarray:
    """Symbol of every code point below 65536; 0 stands for whatever parts words."""
    out = np.zeros(1 << 16, np.int64)
    first = 1 + len(LETTERS)
    for cp in range(0x100, 1 << 16):
        out[cp] = first + (cp >> 7) % (SIDE - first) if chr(cp).isalpha() else 0
    for i, c in enumerate(LETTERS):
        out[ord(c)] = i + 1
    return out


def visible(page: str) -> str:
    """A page without tags, comments and unshown elements, in one scan forward: an end that is missing once is not looked for again."""
    out, at, missing = [], 0, set()
    while m := OPENING.search(page, at):
        start, end = m.start(), None
        for kind in (m.group(1) or (m.group(2) or "").lower(), ""):
            if kind not in missing:
                end = CLOSING[kind].search(page, m.end() if kind == "!--" else start)
                if end is None:
                    missing.add(kind)
            if end is not None or not kind:
                break
        if end is None:  # no tag: the sign is text
            out.append(page[at : start + 1])
            at = start + 1
            if "" in missing:
                break
        else:
            out += [page[at:start], " "]
            at = end.end()
    out.append(page[at:])
    return _html.unescape("".join(out))


class Trigrams:
    """Letter trigrams of texts as numbers below SIDE ** 3."""

    def __init__(self):
        self.symbols = _symbols()

    def __call__(self, text: str) -> np.ndarray:
        cps = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
        s = self.symbols[np.minimum(cps, (1 << 16) - 1)]
        s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]]  # runs of separators are one
        t = (s[:-2] * SIDE + s[1:-1]) * SIDE + s[2:]
        return t[s[1:-1] > 0]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of every trigram in each; from about sample_docs documents spread by a hash of their ids (of equal ids by one of their texts, so repeated ids do not widen it)."""
    docs = docs.select("doc_id", "text", F.lower("lang").alias("lang")).where("lang is not null and text is not null")
    chosen = spread_sample(docs, sample_docs)

    def run(batches):
        grams, seen = Trigrams(), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in seen:
                    seen[lang] = np.zeros(SIDE**3, np.int64)
                at, n = np.unique(grams(text), return_counts=True)
                seen[lang][at] += n
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "at": pa.array(at), "n": pa.array(counts[at])})

    if chosen is None:
        return [], np.zeros((0, SIDE**3), np.float32)
    rows = docs.where(chosen).select("text", "lang").mapInArrow(run, "lang string, at long, n long")
    rows = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()  # SIDE ** 3 a language at most
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(langs), SIDE**3), SMOOTH)
    for r in rows:
        counts[langs.index(r["lang"]), r["at"]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, tables: np.ndarray) -> DataFrame:
    """page_id, url, declared and like (log likelihood by language) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(tables)  # one megabyte a language

    def run(batches):
        grams, t = Trigrams(), shared.value
        for b in batches:
            out = []
            for page in b.column(3):
                at = grams(visible(page.as_py() or ""))
                out.append((t[:, at].mean(axis=1) * len(at) ** 0.5).astype(float) if len(at) else np.zeros(len(t)))
            like = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), like], ["page_id", "url", "declared", "like"])

    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    p = pages.select("page_id", "url", F.lower(F.coalesce(declared, F.lit(""))).alias("declared"), "html")
    return p.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, declared string, like array<double>")


def _normalised(logs: Column, langs: list[str]) -> Column:
    """Probabilities of an array of logs."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))[0]


def _sums(langs, name="p"):
    return F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0.0)) for i in range(len(langs))])


def identify(pages: DataFrame, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of every row of pages (page_id, url, html)."""
    langs, tables = learn(docs, sample_docs)
    pages = pages.select("page_id", "url", "html")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    if not langs:
        none = F.lit(None)
        return pages.select("page_id", host.alias("host"), F.lit("").alias("declared"), none.cast("string").alias("text_lang"), none.cast("string").alias("lang"), none.cast("double").alias("confidence"))
    e = text_evidence(pages, tables).withColumn("host", host).withColumn("p", _normalised(F.col("like"), langs)).drop("url")
    e = materialise(e.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)), "evidence")

    # how declarations follow languages
    known = F.when(F.col("declared").isin(*langs), F.col("declared")).otherwise(F.when(F.col("declared") == "", "").otherwise("other"))
    e = e.withColumn("says", known)
    by_says = {r["says"]: r["s"] for r in e.groupBy("says").agg(_sums(langs).alias("s")).collect()}  # one row a language and two
    total = np.sum([s for s in by_says.values()], axis=0) if by_says else np.zeros(len(langs))
    kinds = len(langs) + 2
    logs = {k: [float(np.log((x + SMOOTH) / (t + SMOOTH * kinds))) for x, t in zip(by_says.get(k, [0.0] * len(langs)), total)] for k in [*langs, "", "other"]}
    says = F.create_map(*[x for k, v in logs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    # priors: all pages, then suffix, domain and host, each pulled towards the one above
    all_n = float(total.sum())
    root = F.array(*[F.lit(float((t + SMOOTH) / (all_n + SMOOTH * len(langs)))) for t in total])
    hosts = materialise(e.groupBy("suffix", "domain", "host").agg(_sums(langs).alias("h")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(_sums(langs, "h").alias("d"))
    suffixes = domains.groupBy("suffix").agg(_sums(langs, "d").alias("x"))
    hosts = materialise(hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix").select("host", "h", "d", "x"), "priors")

    def pulled(sums: Column, above: Column) -> Column:
        """Smoothed shares, the page's own posterior left out."""
        own = F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
        bound = F.array(F.struct(own.alias("own"), above.alias("above")))
        shares = lambda b: F.zip_with(b["own"], b["above"], lambda s, a: (s + HOST_PULL * a) / (F.aggregate(b["own"], F.lit(0.0), lambda u, v: u + v) + HOST_PULL))
        return F.transform(bound, shares)[0]

    j = e.join(hosts, "host")
    j = j.withColumn("of_suffix", pulled(F.col("x"), root))
    j = j.withColumn("of_domain", pulled(F.col("d"), F.col("of_suffix")))
    j = j.withColumn("of_host", pulled(F.col("h"), F.col("of_domain")))
    fused = F.zip_with(F.zip_with("like", F.transform("of_host", lambda x: F.log(x)), lambda a, b: a + b), says[F.col("says")], lambda a, b: a + b)
    j = j.withColumn("post", _normalised(fused, langs))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    text_lang = F.when(F.array_max("like") < 0, best(F.col("like")))
    return j.select("page_id", "host", "declared", text_lang.alias("text_lang"), best(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
