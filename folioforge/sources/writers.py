"""Sinks: JSON lines, delimited text, metric tables, manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json(value: object, path: str) -> None:
    """A small driver-side document, written beside its place and moved there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(target)


def write_csv(df: DataFrame, path: str, sep: str = ",", columns: Sequence[str] | None = None) -> None:
    """Header is the sorted column names unless given."""
    names = list(columns) if columns is not None else sorted(df.columns)
    df.select(*names).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def metric_table(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """(metric, value) rows to one row of percentages with two decimals, half to even."""
    picked = [F.bround(100 * F.max(F.when(F.col("metric") == m, F.col("value"))), 2).alias(m) for m in order]
    return metrics.agg(*picked)


def write_experiment(path: str, metrics: DataFrame, rows: DataFrame, ranking: DataFrame, order: Sequence[str]) -> None:
    """metrics.json, query rows, rankings and a one-row table."""
    values: Mapping[str, float] = {r["metric"]: r["value"] for r in metrics.collect()}  # a dozen rows
    write_json(values, f"{path}/metrics.json")
    write_jsonl(rows, f"{path}/query_rows.jsonl")
    write_jsonl(ranking, f"{path}/rankings.jsonl")
    metric_table(metrics, order).coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{path}/table.tsv")


def ranking_documents(ranking: DataFrame) -> DataFrame:
    """Long rankings to one row a query: ranked_ids and scores, in rank order."""
    top = F.array_sort(F.collect_list(F.struct("rank", "paper_id", "score")))
    x = ranking.groupBy("query_id").agg(top.alias("top"))
    return x.select("query_id", F.transform("top", lambda t: t["paper_id"]).alias("ranked_ids"), F.transform("top", lambda t: t["score"]).alias("scores"))


MOST_LINES = 10_000


def markdown_table(df: DataFrame, columns: Sequence[str]) -> str:
    """A small result as a Markdown table; more than ``MOST_LINES`` rows are an error."""
    rows = df.select(*columns).limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} rows for a Markdown table")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"
