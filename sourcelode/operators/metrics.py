"""Scores, trends, timing statistics and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percentage_change(before: Column, after: Column) -> Column:
    """0 to 0 is 0 and from 0 to more is 100."""
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise((after - before) / before * 100)


def quality_score(files: Column, issues: Column, errors: Column, warnings: Column) -> Column:
    """100 less ten an error, three a warning, and half a point an issue at most fifty; never below 0; 100 without files."""
    left = F.lit(100.0) - F.least(F.lit(50.0), issues * 0.5) - errors * 10.0 - warnings * 3.0
    return F.when(files == 0, 100.0).otherwise(F.greatest(F.lit(0.0), left))


def timing(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, mean, extremes, sample deviation and exact interpolated percentiles of value by key."""
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    return samples.groupBy(key).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"), p.alias("p")
    ).select("*", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))]).drop("p")


def anchored_windows(df: DataFrame, key: str, seconds: str, size: int) -> DataFrame:
    """Adds window: a row opens a window, which holds the rows less than size later; the next row opens another."""
    import pandas as pd

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seconds, kind="stable")
        start, n, out = None, 0, []
        for t in pdf[seconds]:
            if start is None or t - start >= size:
                start, n = t, n + 1
            out.append(n)
        return pdf.assign(window=out)

    return df.groupBy(key).applyInPandas(assign, T.StructType([*df.schema.fields, T.StructField("window", T.LongType())]))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in a stated order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
