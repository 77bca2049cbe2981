"""Readers of the file layouts retrieval data comes in. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions.keys import line_id
from folioforge.functions.vectors import decoded
from folioforge.operators.dedupe import first_place_last_value, keep_first
from folioforge.session import cut_lineage

QUERY_FIELDS = "query_id string, query_key string, id string, query_text string, query string, text string, target_paper_id string, paper_id string, aspect_group string, source_view string, view string"


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line becomes a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; fails on a broken one."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Tab-separated text with a header, also gzipped; short rows are padded with ""."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "\0").option("mode", "PERMISSIVE").csv(path)
    return df.na.fill("")


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Quoted CSV with a header and line breaks inside fields."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on whatever store it names."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    plain = "://" not in pattern and not pattern.startswith("file:")
    return sorted(f.getPath().toUri().getPath() if plain else f.getPath().toString() for f in found or [])


def shards(spark: SparkSession, root: str, representation: str) -> list[str]:
    """Sorted shard files of a representation folder; none if it isn't there."""
    return _listed(spark, f"{root}/{representation}/*.jsonl")


def existing_query_paths(spark: SparkSession, combined: str, parts: Sequence[str]) -> list[str]:
    """The combined query file if it exists, else those of its parts that exist, in their order."""
    return [combined] if _listed(spark, combined) else [p for p in parts if _listed(spark, p)]


def corpus_papers(rows: DataFrame, order: Sequence[str], max_papers: int | None = None) -> DataFrame:
    """(representation_type, paper_id, text, source_path, order...) rows to one text a paper.

    Ids are canonicalised, blank ids dropped; parts that aren't empty are joined by a blank line in
    ``order`` and the whole is stripped; papers without any such part vanish. ``max_papers`` keeps the
    first ids in order. A paper's parts meet in one task, as its text is one value.
    """
    x = rows.withColumn("paper_id", tx.canonical_id(F.col("paper_id"))).where("length(paper_id) > 0")
    parts = F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct(*order, "text"))))
    out = x.groupBy("representation_type", "paper_id").agg(
        tx.stripped(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")).alias("text"),
        F.array_sort(F.collect_set("source_path")).alias("source_paths"),
        F.max(F.length("text")).alias("_longest"),
    ).where("_longest > 0").drop("_longest")
    return out.orderBy("paper_id").limit(max_papers) if max_papers is not None else out


def query_records(rows: DataFrame, position: str, source_first: bool = False) -> DataFrame:
    """Query rows with aliased fields to query_id, query_text, target_paper_id, aspect_group.

    The first non-blank alias wins; a missing id becomes line-NNNNNN by position; rows without
    text, target or a known view are dropped before the first row of each id is kept, so an
    invalid row doesn't use up its id. ``source_first`` prefers paper_id and source_view.
    """
    have = set(rows.columns)

    def pick(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return tx.first_nonblank(found) if found else F.lit(None).cast("string")

    target = ("paper_id", "target_paper_id") if source_first else ("target_paper_id", "paper_id")
    view = ("source_view", "aspect_group", "view") if source_first else ("aspect_group", "source_view", "view")
    x = rows.select(
        F.coalesce(pick("query_id", "query_key", "id"), line_id(F.col(position))).alias("query_id"),
        pick("query_text", "query", "text").alias("query_text"),
        tx.canonical_id(pick(*target)).alias("target_paper_id"),
        tx.aspect_view(pick(*view)).alias("aspect_group"),
        F.col(position).alias("_pos"),
    )
    x = x.where("query_text IS NOT NULL AND target_paper_id IS NOT NULL AND aspect_group IS NOT NULL")
    return keep_first(x, ["query_id"], ["_pos"]).drop("_pos")


def rankings(rows: DataFrame) -> DataFrame:
    """Ranking rows with whole-number ranks from 1; others are skipped."""
    return rows.withColumn("rank", F.col("rank").cast("string").try_cast("int")).where("rank >= 1")


def embedding_map(rows: DataFrame, key: str, vector_text: str, position: str) -> DataFrame:
    """(key, vector, position): vectors decoded from text; of a repeated key the last vector, at
    the first position; blank or unreadable vectors are skipped."""
    x = rows.select(key, F.col(position).alias("position"), decoded(F.col(vector_text)).alias("vector")).where("vector IS NOT NULL AND size(vector) > 0")
    return first_place_last_value(x, [key], "position", ["vector"])


def ids_in_order(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct canonical ids with their first position."""
    x = rows.select(tx.canonical_id(F.col(key)).alias(key), position).where(F.length(key) > 0)
    return x.groupBy(key).agg(F.min(position).alias("first_position"))


def page_images(spark: SparkSession, root: str) -> DataFrame:
    """Folders of page images: paper_id (folder), sorted pages; folders without images don't show."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root).select("path")
    parts = F.split("path", "/")
    x = files.select(F.element_at(parts, -2).alias("paper_id"), "path")
    return x.groupBy("paper_id").agg(F.array_sort(F.collect_list("path")).alias("pages"))


def extraction_jobs(corpus: DataFrame, existing: DataFrame, finished: DataFrame) -> DataFrame:
    """Corpus rows whose shard exists and isn't finished."""
    return corpus.join(existing, "belonging_shard", "left_semi").join(finished, "belonging_shard", "left_anti")


def with_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based positions in the given order. Rows are laid out by ranges, written once, and numbered
    within each range on top of the counts of the ranges before it."""
    x = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    base = x.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return x.withColumn("_n", number).join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_n")).drop("_range", "_n", "_base")


def keyed_table(spark: SparkSession, source: str, keys: DataFrame | None = None, on: Sequence[str] = (), missing: bool = False, **options: str) -> DataFrame:
    """A table read by key: a JDBC table ("jdbc:..." with ``dbtable`` among the options) or Parquet files. With ``keys``
    only rows that have one of them, or with ``missing`` the keys that no row has."""
    table = spark.read.format("jdbc").options(url=source, **options).load() if source.startswith("jdbc:") else spark.read.parquet(source)
    if keys is None:
        return table
    return keys.select(*on).distinct().join(table.select(*on), list(on), "left_anti") if missing else table.join(keys.select(*on), list(on), "left_semi")
