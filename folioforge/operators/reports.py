"""Summaries of queues, reviews, searches and judged queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import style


def frequent(df: DataFrame, value: str, least: int = 4) -> DataFrame:
    """Values that occur at least ``least`` times, with their counts; null is no value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def measures(df: DataFrame, group: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Count, mean, smallest and greatest of each measure by group, in long form; a null doesn't
    count, and a measure that is null everywhere has null statistics."""
    rows = F.array(*[F.struct(F.lit(name).alias("measure"), x.cast("double").alias("value")) for name, x in columns.items()])
    x = df.select(*group, F.inline(rows))
    return x.groupBy(*group, "measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def shares(df: DataFrame, group: Sequence[str], flag: Column) -> DataFrame:
    """Rows, rows whose flag is true, and their ratio by group; a null flag is false."""
    x = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.coalesce(flag, F.lit(False))).alias("hits"))
    return x.withColumn("ratio", F.col("hits") / F.col("n"))


def value_counts(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(measure, value, n): how often each value of each column occurs."""
    x = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("string").alias("value")) for m, c in columns.items()])))
    return x.groupBy("measure", "value").agg(F.count("*").alias("n"))


def queue_snapshot(queue: DataFrame, canonical: DataFrame, as_of: Column, lease_seconds: int) -> DataFrame:
    """(measure, value, n): raw and canonical rows by review_status, review_label and parse_status, distinct
    query keys, and processing rows older than the lease."""
    columns = {c: F.col(c) for c in ("review_status", "review_label", "parse_status")}
    raw = value_counts(queue, {f"raw {c}": x for c, x in columns.items()})
    canon = value_counts(canonical, {f"canonical {c}": x for c, x in columns.items()})
    stale = (F.col("review_status") == "processing") & (F.col("updated_at") < as_of - F.make_dt_interval(secs=F.lit(lease_seconds)))
    one = queue.agg(F.countDistinct("query_key").alias("queries"), F.count_if(stale).alias("stale"))
    totals = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("value"), F.col(c).alias("n")) for c in ("queries", "stale")])))
    return raw.unionByName(canon).unionByName(totals)


def counts_per(df: DataFrame, keys: Sequence[str], people: str) -> DataFrame:
    """Rows and different people by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(people).alias("people"))


def mining_totals(reviews: DataFrame, query: str, label: str, hard: str, positive: str) -> DataFrame:
    """One row: queries, queries with a hard negative, hard negatives, positives."""
    t = reviews.groupBy(query).agg(F.count_if(F.col(label) == hard).alias("h"), F.count_if(F.col(label) == positive).alias("p"))
    return t.agg(F.count("*").alias("queries"), F.count_if(F.col("h") > 0).alias("with_hard"), F.coalesce(F.sum("h"), F.lit(0)).alias("hard_negatives"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"))


def search_summary(searches: DataFrame, failed: Column) -> DataFrame:
    """One row: attempts, failures, and the percentage that succeeded, 100 without an attempt."""
    x = searches.agg(F.count("*").alias("attempts"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures"))
    return x.withColumn("success", F.coalesce(F.try_divide(F.col("attempts") - F.col("failures"), F.col("attempts")) * 100, F.lit(100.0)))


def most_failed(searches: DataFrame, query: str, failed: Column, k: int = 10) -> DataFrame:
    """The ``k`` queries that failed most often; ties by text, null last."""
    return searches.where(failed).groupBy(query).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(query).asc_nulls_last()).limit(k)


def rates(snapshots: DataFrame, at: str, done: str, left: str, growth_rows: int = 12) -> DataFrame:
    """Snapshots, of which there are few, with ``rate`` a second since the one before, ``eta`` seconds for what is
    left at that rate, and ``growth`` over the least of the last ``growth_rows`` snapshots."""
    w = Window.orderBy(at)
    seconds = F.unix_micros(at) / 1e6 - F.lag(F.unix_micros(at)).over(w) / 1e6
    x = snapshots.withColumn("rate", F.try_divide(F.col(done) - F.lag(done).over(w), seconds))
    x = x.withColumn("eta", F.when(F.col("rate") > 0, F.col(left) / F.col("rate")))
    return x.withColumn("growth", F.col(done) - F.min(done).over(w.rowsBetween(1 - growth_rows, 0)))


def human_closeness(judged: DataFrame, side: str, human: str, other: str, counts: str, scores: Sequence[str]) -> DataFrame:
    """(measure, distance, closeness) of two sides' judged queries: for counts exp(-W / (deviation + 1e-8)) of
    the human side, for scores of 1 to 5 1 - W / 4 within 0 and 1; and the mean closeness, named overall.
    Rows with a null measure don't count."""
    x = judged.select(side, *[F.col(c).cast("double").alias(c) for c in (counts, *scores)]).na.drop()
    spread = x.where(F.col(side) == human).agg(F.stddev_pop(counts).alias("spread"))
    rows = None
    for name in (counts, *scores):
        w = style.wasserstein(x, side, human, other, name).withColumn("measure", F.lit(name)).crossJoin(spread)  # one row each
        near = F.exp(-F.col("distance") / (F.col("spread") + 1e-8)) if name == counts else F.least(F.greatest(1 - F.col("distance") / 4, F.lit(0.0)), F.lit(1.0))
        w = w.select("measure", "distance", near.alias("closeness"))
        rows = w if rows is None else rows.unionByName(w)
    whole = rows.agg(F.lit("overall").alias("measure"), F.lit(None).cast("double").alias("distance"), F.avg("closeness").alias("closeness"))
    return rows.unionByName(whole)
