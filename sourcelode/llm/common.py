"""Shared pieces: the word pattern, folds and column clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.session import drop_shuffles, materialise, table  # noqa: F401  (re-exported for the operators)

#: Separators of words, as a character class body: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z only and turns every word separator into a space, on bytes.
FOLD = bytes.maketrans(UPPER.encode() + b"\t\n\x0b\x0c\r", LOWER.encode() + b"     ")


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as fold -1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(-1))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names, so that extra columns cannot clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(k) for k, c in more.items()])


def spread_sample(docs: DataFrame, n: int) -> Column | None:
    """Condition that holds for the n rows of docs (doc_id, text) of least hash of id, then of text, and for their equals; None without rows."""
    of_id, of_text = F.xxhash64("doc_id"), F.xxhash64("text")
    least = docs.select(F.struct(of_id.alias("i"), of_text.alias("t")).alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("h")).first()["h"]
    if least is None:
        return None
    return (of_id < least["i"]) | ((of_id == least["i"]) & (of_text <= least["t"]))
