"""Retrieval metrics over rankings in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import VIEWS

CUTS = (5, 20)


def target_ranks(queries: DataFrame, ranking: DataFrame) -> DataFrame:
    """queries (query_id, target_paper_id, aspect_group) with ``target_rank``: the first rank of
    the target in the query's ranking (query_id, paper_id, rank); null if it isn't there."""
    hits = ranking.select("query_id", F.col("paper_id").alias("target_paper_id"), "rank")
    first = queries.join(hits, ["query_id", "target_paper_id"]).groupBy("query_id", "target_paper_id").agg(F.min("rank").alias("target_rank"))
    return queries.join(first, ["query_id", "target_paper_id"], "left")


def hit(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False)).cast("int")


def ndcg(rank: Column, k: int = 10) -> Column:
    """Single-target nDCG: 1/log2(rank+1) within the cut, else 0."""
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(F.lit(0.0))


def paper_hits(rows: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """Any, all and share of hits over the queries of each target paper, at each cut."""
    return rows.groupBy("target_paper_id").agg(
        *[f(hit(F.col("target_rank"), k)).cast("double").alias(f"{n}_{k}") for k in cuts for n, f in (("any", F.max), ("all", F.min), ("coverage", F.avg))]
    )


def aspect_metrics(rows: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """(metric, value) rows: paper-level (macro) metrics, view recalls (micro), and counts.

    rows: query_id, target_paper_id, aspect_group, target_rank. An absent view has recall 0;
    no rows at all gives 0 everywhere.
    """
    papers = paper_hits(rows, cuts)
    names = {"any": "AnyAspect", "all": "AllAspect", "coverage": "AspectCoverage"}
    macro = papers.agg(*[F.coalesce(F.avg(f"{n}_{k}"), F.lit(0.0)).alias(f"{label}@{k}") for k in cuts for n, label in names.items()])
    recall = [
        F.coalesce(F.avg(F.when(F.col("aspect_group") == v, hit(F.col("target_rank"), k))), F.lit(0.0)).alias(f"{v.title()} R@{k}") for k in cuts for v in VIEWS
    ]
    micro = rows.agg(*recall, F.count("*").cast("double").alias("query_count"), F.countDistinct("target_paper_id").cast("double").alias("paper_count"))

    def long(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in df.columns]
        return df.select(F.inline(F.array(*pairs)))

    return long(macro).unionByName(long(micro))


def one_query_summary(rows: DataFrame, model_order: DataFrame) -> DataFrame:
    """Mean nDCG@10 and hit@20 per model, times 100, in the order of (model, position)."""
    means = rows.groupBy("model").agg(
        (100 * F.avg(ndcg(F.col("target_rank"), 10))).alias("ndcg_10"),
        (100 * F.avg(hit(F.col("target_rank"), 20))).alias("recall_20"),
        F.count("*").alias("n_queries"),
    )
    return model_order.join(means, "model").select("position", "model", "ndcg_10", "recall_20", "n_queries")
