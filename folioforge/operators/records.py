"""Shaping of nested records: aliases, lists, merged maps, bullets, notes split by view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx

#: fixed values: how far a bullet depends on a figure or table
DEPENDENCIES = ("none", "incidental", "supportive", "necessary")


def aliased(json: Column, names: Sequence[str], otherwise: Column | None = None) -> Column:
    """The first of the named fields that a JSON object has, as text; else ``otherwise``."""
    found = [F.get_json_object(json, f"$.{n}") for n in names]
    return F.coalesce(*found, otherwise) if otherwise is not None else F.coalesce(*found)


def merged_maps(old: Column, new: Column) -> Column:
    """Entries of both maps, the new ones first to count, without null values; a null map is empty."""
    kinds = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(old, kinds), F.coalesce(new, kinds)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_filter(F.map_concat(kept, b), lambda k, v: v.isNotNull())


def selection(x: Column) -> Column:
    """A list of choices; an empty one is null."""
    return F.when(F.size(x) > 0, x)


def keywords(x: Column) -> Column:
    """Stripped keywords without blank ones, of a list; null for null."""
    return F.filter(F.transform(x, lambda k: tx.stripped(k)), lambda k: k != "")


def golden_source(query_id: Column, example_id: Column) -> Column:
    """Which collection an exemplar comes from, by a name inside its ids."""
    both = F.lower(F.concat_ws(" ", query_id, example_id))
    return F.when(both.contains("pasa"), F.lit("pasa")).when(both.contains("litsearch"), F.lit("litsearch")).otherwise(F.lit("golden"))


def numbered_windows(x: Column, width: int) -> Column:
    """Windows of ``width`` characters, stripped; blank ones are left out before the rest is numbered
    by its place in the array. Null for null."""
    starts = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.when(x.isNotNull(), F.filter(F.transform(starts, lambda a: tx.stripped(F.substring(x, a, F.lit(width)))), lambda w: w != ""))


def bullets(items: Column) -> Column:
    """Bullets put in order: array<struct<text, source_refs, refs, dependency, rationale>> to the same
    with ``index``, without blank texts and blank references. Without references nothing depends on
    them, and there is no rationale; an unknown dependency is none."""

    def clean(refs: Column) -> Column:
        return F.coalesce(F.filter(F.transform(refs, lambda r: tx.stripped(r)), lambda r: r != ""), F.array().cast("array<string>"))

    def fields(b: Column) -> Column:
        refs, level = clean(b["refs"]), F.lower(tx.stripped(b["dependency"]))
        cited = F.size(refs) > 0
        return F.struct(
            tx.stripped(b["text"]).alias("text"), clean(b["source_refs"]).alias("source_refs"), refs.alias("refs"),
            F.when(cited & level.isin(*DEPENDENCIES), level).otherwise(F.lit("none")).alias("dependency"), F.when(cited, tx.blank_to_null(b["rationale"])).alias("rationale"),
        )

    kept = F.filter(F.transform(items, fields), lambda b: F.coalesce(b["text"] != "", F.lit(False)))
    return F.transform(kept, lambda b, i: F.struct((i + 1).alias("index"), b["text"].alias("text"), b["source_refs"].alias("source_refs"), b["refs"].alias("refs"), b["dependency"].alias("dependency"), b["rationale"].alias("rationale")))


#: fixed value: a dash and the name of a view divide a note
VIEW_MARKER = r"(?i)\s+[\u2014-]\s+(motivation|method|experiment/result|experiment)\b[.:]?"


def note_sections(note: Column) -> Column:
    """(view, section) of a note that names views after dashes, "text - Method. ...". A section begins
    with the sentence before its marker; sections of one view are joined, in first-seen order.

    Sentences end at a mark followed by white space and a capital, digit or opening, but not
    after "et al" or "vs"."""
    sentence = "\x1d"
    t = tx.collapse_spaces(note)
    t = F.regexp_replace(t, r"(?<=[.!?])(?<! et al[.!?])(?<! vs[.!?])(?<! et al)(?<! vs) (?=[A-Z0-9(\"'\u201c])", sentence)
    # a sentence with a marker starts a section, and each further marker in it another one at the same place
    parts = F.split(t, sentence)
    views = F.transform(parts, lambda s: F.transform(F.regexp_extract_all(s, F.lit(VIEW_MARKER), F.lit(1)), lambda v: F.lower(v)))
    none = F.array().cast("array<struct<view:string,section:string>>")

    def step(done: Column, i: Column) -> Column:
        here, part = F.get(views, i), F.get(parts, i)
        empty = F.slice(F.transform(here, lambda v: F.struct(tx.view_label(v).alias("view"), F.lit("").alias("section"))), 1, F.greatest(F.size(here) - 1, F.lit(0)))
        own = F.struct(tx.view_label(F.element_at(here, -1)).alias("view"), part.alias("section"))
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["view"].alias("view"), F.concat_ws(" ", last["section"], part).alias("section"))))
        return F.when(F.size(here) > 0, F.concat(done, empty, F.array(own))).when(F.size(done) > 0, longer).otherwise(done)

    found = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), none, step)
    found = F.filter(found, lambda s: s["section"] != "")
    names = F.array_distinct(F.transform(found, lambda s: s["view"]))
    joined = F.transform(names, lambda v: F.struct(v.alias("view"), F.array_join(F.transform(F.filter(found, lambda s: s["view"] == v), lambda s: s["section"]), " ").alias("section")))
    return F.when(F.length(t) > 0, joined).otherwise(none)


def quoted_titles(note: Column) -> Column:
    """Distinct texts of 8 to 220 characters in double, then in single quotes, white space collapsed."""
    double = F.regexp_extract_all(note, F.lit("[\u201c\"]([^\u201d\"]{8,220})[\u201d\"]"), F.lit(1))
    single = F.regexp_extract_all(note, F.lit("[\u2018']([^\u2019']{8,220})[\u2019']"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(double, single), lambda t: tx.collapse_spaces(t)), lambda t: t != ""))


def with_parent(hits: DataFrame, parents: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Hits joined to their parents by ``key``; hits without one are dropped, or fail the job if
    ``strict``. A parent that came twice counts once."""
    one = parents.dropDuplicates([key])
    if not strict:
        return hits.join(one, key)
    x = hits.join(one.withColumn("_known", F.lit(True)), key, "left")
    return x.where(F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).drop("_known")


def unknown_parents(hits: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys of hits that no parent has."""
    return hits.select(key).distinct().join(parents.select(key), key, "left_anti")


def of_kept(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the kept ones."""
    return rows.join(kept.select(key), key, "left_semi")


def with_details(base: DataFrame, details: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows of ``base`` with a struct column for each detail table, null where it has no row of the
    key; of several rows the greatest counts."""
    for name, df in details.items():
        rest = [c for c in df.columns if c != key]
        base = base.join(df.groupBy(key).agg(F.max(F.struct(*rest)).alias(name)), key, "left")
    return base


def by_index(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two result tables joined on their index; rows without both, or with a null measure, drop out."""
    return left.join(right, list(keys)).na.drop()


def stage_one(papers: DataFrame, accepted: Column, similar: Column, snippets: Column, least: int = 2) -> DataFrame:
    """Adds the three rules and ``passed``; a rule that can't be evaluated for a row (null) is false,
    and the row is kept as not passed."""
    failed = accepted.isNull() | similar.isNull() | snippets.isNull()

    def rule(x: Column) -> Column:
        return F.when(failed, False).otherwise(x)

    x = papers.withColumns({"accepted": rule(accepted), "similar": rule(similar), "evidence": rule(snippets >= least)})
    return x.withColumn("passed", F.col("accepted") & ~F.col("similar") & F.col("evidence"))


def kept_queries(queries: DataFrame, paper: str, order: Sequence[str], limit: int | None = None, multimodal_only: bool = False) -> DataFrame:
    """Generated queries with stripped, non-blank text; multimodal ones alone if asked; at most
    ``limit`` a paper in order."""
    x = queries.withColumn("query_text", tx.blank_to_null(F.col("query_text"))).where("query_text IS NOT NULL")
    if multimodal_only:
        x = x.where("is_multimodal")
    if limit is not None:
        w = Window.partitionBy(paper).orderBy(*order)
        x = x.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= limit).drop("_place")
    return x
