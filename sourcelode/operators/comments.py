"""Regions of source files: comments (nested too), documentation, pragmas and strings, found in one scan of a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("line", "block", "doc", "pragma", "string")
_STOP = re.compile(r"""--+|\{-|"|'(?:[^'\\\n]|\\[^\n]{1,8}?)'|[A-Za-z_][A-Za-z0-9_']*|[!#$%&*+./<=>?@\\^|~:-]+""")
_NEST = re.compile(r"\{-|-\}")
_STRING = re.compile(r"""(?:[^"\\\n]|\\\s+\\|\\.)*"?""")


def scan(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (offsets, end not included) of the regions of a text, in order and without overlap.

    A line comment is two or more hyphens that are not part of an operator. Block comments nest; an open one, like
    an open string, runs to the end of the text or line. Comments that begin with | or ^ are documentation.
    """
    out, at = [], 0
    while m := _STOP.search(text, at):
        a, token = m.start(), m.group()
        if token.startswith("--") and set(token) == {"-"} and not re.match(r"[!#$%&*+./<=>?@\\^|~:]", text[m.end() : m.end() + 1]):
            at = text.find("\n", a)
            at = len(text) if at < 0 else at
            out.append(("doc" if re.match(r"--+\s*[|^]", text[a:at]) else "line", a, at))
        elif token == "{-":
            depth, at = 1, m.end()
            while depth and (n := _NEST.search(text, at)):
                depth, at = depth + (1 if n.group() == "{-" else -1), n.end()
            at = len(text) if depth else at
            out.append(("pragma" if text[a + 2 : a + 3] == "#" else "doc" if re.match(r"\{-\s*[|^]", text[a : a + 80]) else "block", a, at))
        elif token == '"':
            at = _STRING.match(text, m.end()).end()
            out.append(("string", a, at))
        elif "--" in token and token.startswith("--"):  # an operator such as -->
            at = _STOP_OPERATOR.match(text, a).end()
        else:
            at = m.end()
    return out


_STOP_OPERATOR = re.compile(r"[!#$%&*+./<=>?@\\^|~:-]+")


def regions(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """key, kind, line, col, end_line, end_col (from 1, the end not included), text of every region; null texts have none."""
    import bisect

    import pyarrow as pa

    names = [key, "kind", "line", "col", "end_line", "end_col", "text"]
    types = [pa.string(), *[pa.int32()] * 4, pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                starts = [0, *(m.end() for m in re.finditer("\n", t or ""))]
                place = lambda p: (bisect.bisect_right(starts, p), p - starts[bisect.bisect_right(starts, p) - 1] + 1)  # noqa: E731, B023
                rows += [(k, kind, *place(a), *place(e), t[a:e]) for kind, a, e in scan(t or "")]
            columns = list(zip(*rows)) or [[]] * 7
            keys = pa.array([x.as_py() for x in columns[0]], b.column(0).type)
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, text).mapInArrow(run, f"{key} {kind}, kind string, line int, col int, end_line int, end_col int, text string")


def in_range(found: DataFrame, first: int, last: int) -> DataFrame:
    """Regions that touch lines first to last."""
    return found.where((F.col("line") <= last) & (F.col("end_line") >= first))


def region_of(hits: DataFrame, found: DataFrame, key: str = "file_id") -> DataFrame:
    """hits (key, line_no, col, ...) with region: the kind of the region at their place, else code.

    The regions of a file do not overlap, so the last one that begins at or before a place decides.
    """
    from pyspark.sql import Window

    place = F.struct(F.col("line").alias("line"), F.col("col").alias("col"))
    begin = found.select(key, place.alias("_at"), F.lit(0).alias("_hit"), F.struct("kind", F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col")).alias("end")).alias("_r"), F.lit(None).cast("string").alias("_row"))
    own = [c for c in hits.columns if c != key]
    rows = hits.select(key, F.struct(F.col("line_no").cast("int").alias("line"), F.col("col").cast("int").alias("col")).alias("_at"), F.lit(1).alias("_hit"), F.struct(*own).alias("_own"))
    both = begin.drop("_row").unionByName(rows, allowMissingColumns=True)
    last = F.last("_r", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_hit").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_r", last).where("_hit = 1")
    return both.select(key, "_own.*", F.when(F.col("_r.end") > F.col("_at"), F.col("_r.kind")).otherwise("code").alias("region"))


def strip_strings(line: Column) -> Column:
    """A line with what stands in its strings taken out, the quotes kept."""
    return F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', '""')


def strip_comments(line: Column) -> Column:
    """A line without its line comment and block comments that end on it; hyphens in strings do not count."""
    plain = F.regexp_replace(line, r'("(?:[^"\\]|\\.)*")|\{-.*?-\}', "$1")
    return F.regexp_replace(plain, r'^((?:[^"-]|"(?:[^"\\]|\\.)*"|-(?!-))*)--.*$', "$1")


def count_in_code(line: Column, literal: str) -> Column:
    """How often a literal text occurs in the code of a line."""
    code = strip_comments(strip_strings(line))
    return F.floor((F.length(code) - F.length(F.replace(code, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def word_in_code(line: Column, word: str) -> Column:
    """Whether a word stands alone in the code of a line."""
    escaped = re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", word)
    return strip_comments(strip_strings(line)).rlike(r"(?<![A-Za-z0-9_'])" + escaped + r"(?![A-Za-z0-9_'])")


def operators(line: Column) -> Column:
    """The operators in the code of a line, in order."""
    return F.regexp_extract_all(strip_comments(strip_strings(line)), F.lit(r"([!#$%&*+./<=>?@\\^|~:-]+)"), 1)
