"""Deduplication, merging and set operations by key, with defined winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Null keys are a key; ties of the order are broken arbitrarily."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_place_last_value(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """One row a key: the first position, and the values of the last one. Aggregated map-side,
    so a key with very many rows costs no task more than its share."""
    last = F.max(F.struct(position, *values))
    x = df.groupBy(*keys).agg(F.min(position).alias("_first"), last.alias("_last"))
    return x.select(*keys, F.col("_first").alias(position), *[F.col(f"_last.{v}").alias(v) for v in values])


def merge_override(base: DataFrame, update: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``update`` replace rows of ``base`` with the same key; others of both stay."""
    kept = base.join(update.select(*keys), list(keys), "left_anti")
    return kept.unionByName(update.select(*base.columns))


def unique_titles(df: DataFrame, group: Sequence[str], title: Column, order: Sequence[Column | str], most: int | None = None) -> DataFrame:
    """First row of each title within the group, then at most ``most`` rows a group in order."""
    x = keep_first(df.withColumn("_title", title), [*group, "_title"], order)
    if most is not None:
        x = x.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") <= most).drop("_place")
    return x.drop("_title")


def contains_all(expected: DataFrame, actual: DataFrame, group: str, member: str) -> DataFrame:
    """Relational division: groups of ``expected`` all of whose members occur in ``actual``."""
    missing = expected.join(actual, [group, member], "left_anti").select(group).distinct()
    return expected.select(group).distinct().join(missing, group, "left_anti")


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resume: rows whose key isn't done yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def near_duplicates_of_earlier(df: DataFrame, group: Sequence[str], order: str, tokens: str, threshold: float, refs: str | None = None, sources: str | None = None) -> DataFrame:
    """Marks ``duplicate_of``: the earliest row of the group that was itself accepted and that the row
    repeats. A row with ``refs`` repeats one with the same set of them and a common source;
    any other row one whose token set has at least the given Jaccard. Groups are lists of one
    document's bullets; null arrays count as empty.

    An ordered fold over each group's rows; groups are arrays, so they must be small (bullets
    of one view); use a blocking join for larger ones.
    """
    def listed(name: str | None) -> Column:
        empty = F.array().cast("array<string>")
        return F.coalesce(F.array_sort(F.array_distinct(F.col(name))), empty) if name else empty

    items = F.array_sort(F.collect_list(F.struct(order, F.coalesce(tokens, F.array().cast("array<string>")).alias(tokens), listed(refs).alias("_r"), listed(sources).alias("_s"))))
    kind = f"array<struct<o:{df.schema[order].dataType.simpleString()},t:array<string>,r:array<string>,s:array<string>,dup:{df.schema[order].dataType.simpleString()}>>"

    def step(done: Column, x: Column) -> Column:
        def close(d: Column) -> Column:
            both, either = F.size(F.array_intersect(d["t"], x[tokens])), F.size(F.array_union(d["t"], x[tokens]))
            alike = (both > 0) & (both / either >= threshold)
            cited = (d["r"] == x["_r"]) & F.arrays_overlap(d["s"], x["_s"])
            return d["dup"].isNull() & F.when(F.size(x["_r"]) > 0, cited).otherwise(alike)

        found = F.filter(done, close)
        row = F.struct(x[order].alias("o"), x[tokens].alias("t"), x["_r"].alias("r"), x["_s"].alias("s"), F.when(F.size(found) > 0, F.get(found, F.lit(0))["o"]).alias("dup"))
        return F.concat(done, F.array(row).cast(kind))

    folded = df.groupBy(*group).agg(F.aggregate(items, F.array().cast(kind), step).alias("rows"))
    return folded.select(*group, F.explode("rows").alias("r")).select(*group, F.col("r.o").alias(order), F.col("r.dup").alias("duplicate_of"))
