"""Work-queue tables as pure functions: claims under budgets, leases, retries, summaries.

A queue has id, query_key, retrieval_rank, review_status, review_label, parse_status,
review_payload, updated_at. Functions that depend on time take it as ``as_of``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.store import write_back
from folioforge.session import cut_lineage

CLAIM_ORDER = ("query_key", "retrieval_rank", "id")
REVIEW_PRIORITY = ("completed", "processing", "pending", "failed")
PARSE_PRIORITY = ("parsed", "metadata_only", "no_pdf", "pending")


def priority(column: Column, order: Sequence[str]) -> Column:
    """Place in the order; anything else, and null, comes last."""
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(column == value, F.lit(i)).otherwise(out)
    return out


def canonical_rows(queue: DataFrame) -> DataFrame:
    """One row for each (query_key, retrieval_rank): by review status, parse status, payload
    present, latest update, largest id."""
    w = Window.partitionBy("query_key", "retrieval_rank").orderBy(
        priority(F.col("review_status"), REVIEW_PRIORITY),
        priority(F.col("parse_status"), PARSE_PRIORITY),
        F.col("review_payload").isNull(),
        F.col("updated_at").desc_nulls_last(),
        F.col("id").desc(),
    )
    return queue.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def progress(queue: DataFrame) -> DataFrame:
    """Completed rows and completed hard negatives of each query."""
    done = F.col("review_status") == "completed"
    return queue.groupBy("query_key").agg(
        F.count(F.when(done, 1)).alias("completed"), F.count(F.when(done & (F.col("review_label") == "hard_negative"), 1)).alias("hard_negatives")
    )


def first_in_order(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(*CLAIM_ORDER).limit(limit)


def claim_within_budget(queue: DataFrame, limit: int, most_hard: int = 10, most_reviews: int = 30) -> DataFrame:
    """Pending rows of queries with fewer hard negatives and reviews than the budgets."""
    x = queue.where("review_status = 'pending'").join(progress(queue), "query_key", "left")
    x = x.where((F.coalesce("hard_negatives", F.lit(0)) < most_hard) & (F.coalesce("completed", F.lit(0)) < most_reviews))
    return first_in_order(x.select(*queue.columns), limit)


def claim_with_minimum(queue: DataFrame, status: str, limit: int, least: int = 25) -> DataFrame:
    """Rows of a parse status in queries that have at least ``least`` candidates."""
    enough = queue.groupBy("query_key").count().where(F.col("count") >= least).select("query_key")
    return first_in_order(queue.where(F.col("parse_status") == status).join(enough, "query_key", "left_semi"), limit)


def claim_where(queue: DataFrame, column: str, value: str, labels: Sequence[str], limit: int) -> DataFrame:
    """Rows whose status ``column`` has the value and whose review_label is among the given ones."""
    return first_in_order(queue.where((F.col(column) == value) & F.col("review_label").isin(*labels)), limit)


def claim_query(queue: DataFrame) -> DataFrame:
    """All pending rows of the first query key, blank ones aside, that has any."""
    x = queue.where("review_status = 'pending'")
    first = x.where(F.length(F.trim("query_key")) > 0).agg(F.min("query_key").alias("query_key"))
    return x.join(first, "query_key", "left_semi")


def run_passes(queue: DataFrame, passes: Sequence[tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame], Sequence[str]]]) -> DataFrame:
    """A run as batch passes, as for download, parsing and review: each claims rows of the queue that the passes
    before it left, works on them, and writes the named columns back by id. Results are
    written to the shared folder between the passes, so no claim is made twice."""
    for claim, work, columns in passes:
        done = cut_lineage(work(claim(queue)).select("id", *columns))
        queue = cut_lineage(write_back(queue, done, ["id"], list(columns)))
    return queue


def close_satisfied(queue: DataFrame, most_hard: int = 10, most_reviews: int = 30) -> DataFrame:
    """The queue with the pending rows of satisfied queries closed as ignored."""
    full = progress(queue).where((F.col("hard_negatives") >= most_hard) | (F.col("completed") >= most_reviews)).select("query_key", F.lit(True).alias("_full"))
    x = queue.join(full, "query_key", "left")
    close = F.col("_full") & (F.col("review_status") == "pending")
    new = {"review_status": "completed", "review_label": "ignored", "parse_status": "skipped"}
    return x.select(*[F.when(close, F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])


def reset_stale(queue: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Processing rows last updated more than ``seconds`` before ``as_of`` are pending again."""
    stale = (F.col("review_status") == "processing") & (F.col("updated_at") < as_of - F.make_dt_interval(secs=F.lit(seconds)))
    return queue.withColumn("review_status", F.when(stale, F.lit("pending")).otherwise(F.col("review_status")))


def reset_failed(queue: DataFrame, retry: Column) -> DataFrame:
    """Canonical failed rows that match ``retry`` are pending again."""
    ids = canonical_rows(queue).where((F.col("review_status") == "failed") & retry).select("id", F.lit(True).alias("_again"))
    x = queue.join(ids, "id", "left")
    return x.select(*[F.when(F.col("_again"), F.lit("pending")).otherwise(F.col(c)).alias(c) if c == "review_status" else F.col(c) for c in queue.columns])


def status_counts(queue: DataFrame, column: str, zero_fill: Sequence[str] = ()) -> DataFrame:
    """Rows of each value; the values of ``zero_fill`` are there even with none."""
    n = queue.groupBy(column).agg(F.count("*").alias("n"))
    if not zero_fill:
        return n
    all_values = queue.sparkSession.createDataFrame([(v,) for v in zero_fill], f"{column} string")
    return n.join(all_values, column, "full").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def early_stop(reviews: DataFrame, group: str, rank: str, label: str, most: int) -> DataFrame:
    """Reviews up to and with the ``most``-th hard negative of each group, in rank order."""
    w = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col(label) == "hard_negative", 1).otherwise(0)).over(w), F.lit(0))
    return reviews.withColumn("_before", before).where(F.col("_before") < most).drop("_before")


def worker_health(events: DataFrame, as_of: Column, silent: int = 300, long_running: int = 1800) -> DataFrame:
    """Last event of each worker classified: exited, silent, long_running, healthy."""
    w = events.groupBy("worker").agg(F.max(F.struct("ts", "event")).alias("last"), F.min("ts").alias("started"))
    quiet = F.unix_timestamp(as_of) - F.unix_timestamp("last.ts")
    age = F.unix_timestamp(as_of) - F.unix_timestamp("started")
    health = F.when(F.col("last.event") == "exit", "exited").when(quiet >= silent, "silent").when(age >= long_running, "long_running").otherwise("healthy")
    return w.select("worker", health.alias("health"))
