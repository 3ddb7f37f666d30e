"""Files as rows, and their lines and tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_']*"


def read_files(spark: SparkSession, path: str, glob: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content and modification time of every file below path whose name fits glob; excluded path globs drop out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime"))
    for pattern in exclude:
        files = files.where(~F.col("path").rlike(glob_regex(pattern)))
    return files


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
        i += 1
    return f"(^|/){out}$"


def lines(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file_id, line_no (from 1), text; a final newline opens no line and empty content has none."""
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\n\z", "")
    whole = files.where(F.length(text_col) > 0).select(F.col(id_col).alias("file_id"), F.posexplode(F.split(body, "\n")).alias("at", "text"))
    return whole.select("file_id", (F.col("at") + 1).alias("line_no"), "text")


def tokens(of_lines: DataFrame, pattern: str = IDENTIFIER) -> DataFrame:
    """file_id, line_no, ord (from 0), token."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("ord", "token")
    return of_lines.select("file_id", "line_no", found)


def line_kind(text: Column) -> Column:
    """blank, comment or code."""
    return F.when(F.trim(text) == "", "blank").when(text.rlike(r"^\s*(--|\{-)"), "comment").otherwise("code")


def module_name(content: Column) -> Column:
    return F.regexp_extract(content, r"(?m)^module\s+([\w.]+)", 1)


def imports(of_lines: DataFrame) -> DataFrame:
    """file_id, line_no, imported, qualified, alias, hiding, items of import lines."""
    pattern = r"^import\s+(qualified\s+)?([\w.]+)(\s+qualified)?(?:\s+as\s+([\w.]+))?\s*(hiding\s*)?(?:\((.*)\))?\s*$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    items = F.filter(F.transform(F.split(part(6), ","), lambda x: F.trim(x)), lambda x: x != "")
    return of_lines.where(F.col("text").rlike(pattern)).select(
        "file_id", "line_no", part(2).alias("imported"), ((part(1) != "") | (part(3) != "")).alias("qualified"),
        F.nullif(part(4), F.lit("")).alias("alias"), (part(5) != "").alias("hiding"), F.when(F.col("text").contains("("), items).alias("items"),
    )
