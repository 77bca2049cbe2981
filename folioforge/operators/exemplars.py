"""Exemplar stores, assembled query contexts and other record shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx


def per_label(rows: DataFrame, query_id: str, labels: Column) -> DataFrame:
    """One row a view label: example_id is the query id and the label, "/" and spaces as "_"."""
    x = rows.withColumn("view_label", F.explode(labels))
    return x.withColumn("example_id", F.concat(F.col(query_id), F.lit("__"), F.regexp_replace("view_label", "[/ ]", "_")))


def positional(rows: DataFrame, results: DataFrame, group: str, order: str, index: str = "index") -> DataFrame:
    """Rows joined to results by their 1-based place in the group; missing results stay null."""
    n = rows.withColumn(index, F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return n.join(results, [group, index], "left")


def flagged(queries: DataFrame, bullets: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Queries with the flag of the bullet they refer to; false where there is none."""
    b = bullets.groupBy(*keys).agg(F.max(F.col(flag).cast("int")).alias("_flag"))
    return queries.join(b, list(keys), "left").withColumn(flag, F.coalesce(F.col("_flag") == 1, F.lit(False))).drop("_flag")


def renamed_keys(content: Column, names: Mapping[str, str]) -> Column:
    """A map with keys renamed and null values dropped; keys not named stay."""
    alias = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.map_filter(F.transform_keys(content, lambda k, v: F.coalesce(F.element_at(alias, k), k)), lambda k, v: v.isNotNull())


def first_positive(values: Column) -> Column:
    """The first value that is a positive whole number, or null."""
    whole = F.filter(F.transform(values, lambda v: v.cast("string").try_cast("int")), lambda n: n > 0)
    return F.get(whole, F.lit(0))


def sentence_summary(x: Column, longest: int = 700) -> Column:
    """Leading sentences within ``longest`` characters; a first sentence that is longer is cut."""
    parts = F.split(tx.collapse_spaces(x), r"(?<=[.!?])\s+")

    def add(done: Column, s: Column) -> Column:
        longer = F.when(F.length(done["t"]) == 0, s).otherwise(F.concat_ws(" ", done["t"], s))
        fits = ~done["full"] & (F.length(longer) <= longest)
        return F.struct(F.when(fits, longer).otherwise(done["t"]).alias("t"), (~fits).alias("full"))

    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))
    kept = F.aggregate(parts, start, add)["t"]
    return F.when(F.length(kept) > 0, kept).otherwise(F.substring(tx.collapse_spaces(x), 1, longest))


def snippet(x: Column, longest: int = 1500) -> Column:
    """Collapsed text, cut with "..." if longer."""
    t = tx.collapse_spaces(x)
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("..."))).otherwise(t)


def prompt_format(kind: str, instruction: Column, query: Column) -> Column:
    """Instruction formats of embedding models: "pair" names both parts, "plain" has the query only."""
    if kind == "pair":
        return F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery:"), query)
    return query


def ranking_rows(documents: DataFrame, query_id: str, ids: str, scores: str) -> DataFrame:
    """One row a query with ranked ids and scores to one row a rank (1-based)."""
    zipped = F.zip_with(ids, scores, lambda i, s: F.struct(i.alias("paper_id"), s.alias("score")))
    x = documents.select(query_id, F.posexplode(zipped).alias("pos", "z"))
    return x.select(query_id, (F.col("pos") + 1).alias("rank"), "z.paper_id", "z.score")


def restricted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the listed ids; an empty list restricts nothing."""
    none = ids.agg(F.count("*").alias("_listed"))
    x = rows.crossJoin(F.broadcast(none))  # one row
    return x.join(ids.select(key, F.lit(True).alias("_in")).distinct(), key, "left").where("_listed = 0 OR _in").drop("_listed", "_in")


def planar(points: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """First two principal components of the vectors, as a deterministic stand-in for a neighbour
    embedding: x, y beside the kept columns."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = points.select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_p", vector_to_array("_p"))
    return out.select(*keep, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))


def banner_text(rows: DataFrame, group: str, section: str, text: str, order: str) -> DataFrame:
    """One text a group: its sections in first-seen order, each under a banner with its entries in
    order; blank entries are left out."""
    x = rows.where(F.length(tx.stripped(F.col(text))) > 0)
    per = x.groupBy(group, section).agg(F.min(order).alias("_at"), F.array_sort(F.collect_list(F.struct(order, text))).alias("_e"))
    body = F.concat(F.lit("=== "), F.col(section), F.lit(" ===\n"), F.array_join(F.transform("_e", lambda e: e[text]), "\n"))
    per = per.select(group, "_at", section, body.alias("_t"))
    return per.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", section, "_t"))), lambda s: s["_t"]), "\n\n").alias("content"))


def compact_json(columns: Sequence[str]) -> Column:
    """The named columns as JSON without nulls, blank strings and empty arrays."""
    def kept(name: str) -> Column:
        x = F.col(name)
        text = F.when(F.typeof(x) == "string", F.when(tx.stripped(x.cast("string")) != "", x))
        return F.when(F.typeof(x) == "string", text).otherwise(F.when(~F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "true"}).isin("{}", '{"v":[]}'), x)).alias(name)

    return F.to_json(F.struct(*[kept(c) for c in columns]), {"ignoreNullFields": "true"})


def enqueued(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates as new queue rows: candidate_key, pending statuses; one row a key."""
    from folioforge.functions.keys import candidate_key
    from folioforge.operators.dedupe import keep_first

    x = candidates.withColumn("candidate_key", candidate_key(F.col("query_key"), F.col("title"), F.col("arxiv_id"), F.col("url")))
    x = keep_first(x, ["candidate_key"], list(keys))
    return x.withColumn("parse_status", F.lit("pending")).withColumn("review_status", F.lit("pending"))


#: fixed values: heading words that end or open sections
REFERENCE_HEADINGS = ("references", "bibliography", "works cited", "literature cited")


def is_reference_heading(line: Column) -> Column:
    return F.regexp_replace(F.lower(tx.stripped(line)), r"^[#\d. ]+", "").isin(*REFERENCE_HEADINGS)


def is_appendix_heading(line: Column) -> Column:
    return F.lower(tx.stripped(line)).rlike(r"^[#\d. ]*(appendix|appendices|supplementary material)\b")


def is_noise(line: Column) -> Column:
    """Blank, or fewer letters than other characters that aren't white space."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    ink = F.length(F.regexp_replace(line, r"\s", ""))
    return F.coalesce((ink == 0) | (letters * 2 < ink), F.lit(True))


def before_references(text: Column) -> Column:
    """The lines of a document before its first reference heading."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, is_reference_heading), True)
    return F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines), "\n")
