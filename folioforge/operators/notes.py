"""Forum notes: classification, buckets, ordering; nested records to rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as tx

#: fixed values: content keys of a review
REVIEW_KEYS = ("summary", "strengths", "weaknesses", "soundness", "presentation", "contribution", "questions")
KINDS = ("decision", "meta_review", "rebuttal", "review", "comment", "other")


def note_kind(invitation: Column, content_keys: Column) -> Column:
    """Kind of a note by ordered rules over its invitation text and content keys; the order
    matters, as a response to a review is no review. Nulls count as empty."""
    text = F.lower(F.coalesce(invitation, F.lit("")))
    keys = F.coalesce(F.transform(content_keys, lambda k: F.lower(k)), F.array().cast("array<string>"))

    def says(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | text.contains(w)
        return out

    def has(*names: str) -> Column:
        return F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names])), F.lit(False))

    return (
        F.when(says("decision") | has("decision"), "decision")
        .when(says("meta_review", "metareview") | has("reviewer_concerns", "reviewer_scores"), "meta_review")
        .when(says("rebuttal", "response"), "rebuttal")
        .when(says("official_review") | (says("review") & ~says("meta")), "review")
        .when(has(*REVIEW_KEYS), "review")
        .when(says("comment") | has("comment"), "comment")
        .otherwise("other")
    )


def kind_buckets(notes: DataFrame, group: str, kind: str, item: str, order: Sequence[str]) -> DataFrame:
    """One row a group with an array of its items of each kind, in order."""
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct(*order, item)))), lambda s: s[item]).alias(k) for k in KINDS
    ]
    return notes.groupBy(group).agg(*lists)


def note_order() -> list[Column]:
    """Creation time with nulls last, then true creation time, number as text, id."""
    return [F.col("cdate").asc_nulls_last(), F.col("tcdate").asc_nulls_last(), F.col("number").cast("string"), F.col("id")]


def entries(record_keys: Column, values: Column, label: Column) -> Column:
    """label/key paths with their non-blank values."""
    pairs = F.zip_with(record_keys, values, lambda k, v: F.struct(F.concat_ws("/", label, k).alias("path"), v.alias("text")))
    return F.filter(pairs, lambda p: F.length(tx.stripped(p["text"])) > 0)


def feedback_rows(payload: DataFrame, keys: Sequence[str], fixed: Sequence[str], checks: str) -> DataFrame:
    """A payload's fixed judgements and its map of candidate checks to one row an item; null
    judgements give no row."""
    items = [F.struct(F.lit(c).alias("feedback_item_id"), F.col(c).alias("judgement")) for c in fixed]
    own = payload.select(*keys, F.inline(F.array(*items)))
    mapped = payload.select(*keys, F.explode(checks).alias("feedback_item_id", "judgement"))
    return own.unionByName(mapped).where("judgement IS NOT NULL")


def feedback_payload(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows back to one map a key: of several rows of an item the latest (updated_at, id)."""
    last = rows.groupBy(*keys, "feedback_item_id").agg(F.max(F.struct("updated_at", "id", "judgement")).alias("last"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feedback_item_id", F.col("last.judgement"))))).alias("items"))


def assembled(stages: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of stage outputs on a key, with the first stage and position of each key.

    Each stage has the key, ``position`` and its own columns, at most one row a key. The keys'
    order is their first appearance over the stages; one shuffle a stage on one key."""
    seen = None
    for i, s in enumerate(stages):
        x = s.select(key, F.lit(i).alias("stage"), F.col("position"))
        seen = x if seen is None else seen.unionByName(x)
    out = seen.groupBy(key).agg(F.min(F.struct("stage", "position")).alias("first"))
    for s in stages:
        out = out.join(s.drop("position"), key, "left")
    return out.withColumn("first_stage", F.col("first.stage")).withColumn("first_position", F.col("first.position")).drop("first")


def with_results(rows: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Secondary join of the final document: the columns of ``results`` beside the rows with the same keys,
    such as paper, text, view and type; nulls are alike. Of several results the greatest counts."""
    rest = [c for c in results.columns if c not in keys]
    one = results.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(F.struct(*rest)).alias("_r"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(one, cond, "left").select(*[F.col(c) for c in rows.columns], *[F.col(f"_r.{c}").alias(c) for c in rest])


def final_document(stages: Sequence[DataFrame], key: str, titles: Sequence[str], rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``assembled`` stages with the first non-blank of ``titles`` as title, and ``queries``: the named columns of
    the key's rows, in order; empty for keys without any."""
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("queries"))
    out = assembled(stages, key).join(nested, key, "left")
    return out.withColumn("title", tx.first_nonblank([F.col(t) for t in titles])).withColumn("queries", F.coalesce("queries", F.array().cast(nested.schema["queries"].dataType)))
