"""Operator 8: token counts through a two-tier lookup of pre-token lengths.

Tier one is a compact table of frequent pre-tokens and their token counts, built
from a bounded sample of documents and broadcast (at most table_size entries).
Tier two is a cache in each Python worker: what the table lacks is encoded once
by the tokenizer library and kept, up to cache_size entries. No pre-token of
the corpus is shuffled; the sample and both bounds change speed, never results.

Edge cases: a null or empty text has 0 bytes and 0 tokens; special strings in a
text count as their one special token, which is the library's default; texts
are taken whole; repeated rows give repeated rows; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slim, spread_sample, table

SAMPLE_DOCS, TABLE_SIZE, CACHE_SIZE, CHUNK_CHARS = 1024, 65_536, 250_000, 250_000


class ByteLevelCounter:
    """Counts tokens of texts for a byte-level BPE file with the usual contraction-aware pre-tokens."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_size: int = CACHE_SIZE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores already
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level files without normalizer and prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.frequent, self.cache_size = frequent or {}, cache_size
        self.known = dict(self.frequent)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and its number of special tokens."""
        if not self.special or not self.special.search(text):
            return self.pieces(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1

    def learn(self, pieces: set[str]) -> None:
        """Encode what neither tier has."""
        if len(self.known) > self.cache_size:
            self.known = dict(self.frequent)
        if missing := list(pieces.difference(self.known)):
            found = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            self.known.update(zip(missing, map(len, found)))

    def count(self, text: str) -> int:
        pieces, n = self.split(text)
        self.learn(set(pieces))
        return n + sum(map(self.known.__getitem__, pieces))


def _pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """Both columns of the table as two byte strings; pre-tokens of the table hold no NUL."""
    return "\0".join(lengths).encode(), bytes(lengths.values())


def _unpack(packed: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(packed[0].decode().split("\0"), packed[1])) if packed[1] else {}


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about sample_docs documents, spread by a hash of their ids (of equal ids by one of their texts, so repeated ids do not widen it)."""
    chosen = spread_sample(docs, sample_docs)
    if chosen is None:
        return {}

    def tally(batches):
        counter, seen = ByteLevelCounter(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(counter.split(text or "")[0])
                if len(seen) > 4 * table_size:  # keep a bound on what one task holds
                    seen = Counter(dict(seen.most_common(table_size)))
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    parts = docs.where(chosen).select("text").mapInArrow(tally, "piece string, n long")
    top = parts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size).collect()
    counter = ByteLevelCounter(path)
    counter.learn({r["piece"] for r in top})
    return {r["piece"]: n for r in top if (n := counter.known[r["piece"]]) < 256 and "\0" not in r["piece"]}


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    docs = slim(docs, id_col, text_col)
    packed = _pack(frequent_lengths(docs, path, sample_docs, table_size))
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def count(batches):
        counter = ByteLevelCounter(path, _unpack(shared.value), cache_size)
        for batch in batches:
            totals, held, size = [], [], 0

            def flush():
                counter.learn({p for pieces, _ in held for p in pieces})
                get = counter.known.__getitem__
                totals.extend(n + sum(map(get, pieces)) for pieces, n in held)
                held.clear()

            for text in batch.column(1):
                text = text.as_py() or ""
                held.append(counter.split(text))
                if (size := size + len(text)) > CHUNK_CHARS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = d.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
