"""Evaluate heavy expressions once.

The optimiser merges neighbouring projections and thereby copies an expression into every
place that reads it. A generator over a one-element array keeps the steps apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the given columns added, each evaluated once a row."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    keep = [c for c in df.columns if c not in columns]
    x = df.select(*columns_of(df, keep), held.alias("_staged"))
    return x.select(*columns_of(x, keep), *[F.col("_staged")[n].alias(n) for n in columns])


def columns_of(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for heavy work a row: a small
    file is one partition. Frames that have enough are left as they are, and so are those
    with a shuffle, whose partitions are only known once it has run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
