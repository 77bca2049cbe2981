"""Queries of indexes, services, assembly and the remaining scalar and queue forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import exemplars, external, indexes, queue, store, style
from folioforge.plans.registry import query
from folioforge.plans.retrieval import BM25_SQL, RANK_SQL
from folioforge.session import shared_folder
from folioforge.sources import paged, readers, table

Q = "WITH q AS (SELECT DISTINCT ON (id) * FROM candidate_queue)"
WS = f"[{tx.WHITE}]+"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_queue").dropDuplicates(["id"])


@query("tk2_index_search", RANK_SQL.replace(" AND q.vec_id <> x.vec_id", "") + "SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM top WHERE rank <= 5")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    path = shared_folder(spark)
    indexes.save_dense_index(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label"), path)
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return indexes.dense_search(spark, path, q, 5).withColumn("score", F.round("score", 6))


@query("sk3_bm25_index_search", BM25_SQL.replace("FROM golden_query_embeddings GROUP BY example_id", "FROM golden_query_embeddings WHERE query_type = 'IR' GROUP BY example_id"))
def bm25_index_search(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    indexes.save_bm25_index(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), path)
    q = table(spark, d, "golden_query_embeddings").where("query_type = 'IR'").select(F.col("example_id").alias("query_id"), F.col("query_text").alias("text")).dropDuplicates(["query_id"])
    return indexes.bm25_search(spark, path, q, 20, decimals=8).withColumn("score", F.round("score", 6))


@query("sc14_paged_source", "SELECT i AS position, i AS id, 'Paper ' || i AS title FROM range(0, 1234) t(i)")
def paged_source(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(paged.PagedSource)
    x = spark.read.format("paged").option("client", "folioforge.sources.paged:sample_client").option("total", "2000").option("page", "100").load()
    return x.select("position", F.get_json_object("record", "$.id").cast("long").alias("id"), F.get_json_object("record", "$.title").alias("title"))


@query("sc17_cached_search", """
SELECT DISTINCT query_id, 1 AS from_cache FROM golden_query_embeddings WHERE view_label = 'method' UNION ALL
SELECT DISTINCT query_id, 0 FROM golden_query_embeddings WHERE query_id NOT IN (SELECT query_id FROM golden_query_embeddings WHERE view_label = 'method')""")
def cached_search(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_query_embeddings")
    cache = g.where("view_label = 'method'").select("query_id").distinct()
    plans = g.select("query_id", F.lit("dense ranking").alias("query")).distinct().join(cache, "query_id", "left_anti")
    found = external.searched(plans, lambda: external.TableSearch([{"title": "dense ranking"}]), "fixture")
    return cache.select("query_id", F.lit(1).alias("from_cache")).unionByName(found.select("query_id", F.lit(0).alias("from_cache")))


@query("sc19_json_document", "SELECT c_custkey, c_name FROM customer")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    """One document a nation, in a file each."""
    path = shared_folder(spark)
    doc = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("customers"))
    doc.repartition("c_nationkey").write.partitionBy("c_nationkey").json(path)
    return readers.json_document(spark, path, "customers array<struct<c_custkey:bigint,c_name:string>>").select(F.inline("customers"))


@query("s25_banner_texts", """
WITH e AS (SELECT paper_id, doc_kind, min(doc_id) AS pos, '=== ' || doc_kind || ' ===' || chr(10) || string_agg(source, chr(10) ORDER BY doc_id) AS t
           FROM documents WHERE paper_id IS NOT NULL AND length(trim(source)) > 0 GROUP BY paper_id, doc_kind)
SELECT paper_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS content FROM e GROUP BY paper_id""")
def banner_texts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("paper_id IS NOT NULL")
    return exemplars.banner_text(x, "paper_id", "doc_kind", "source", "doc_id")


@query("s27_line_classes", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (WHERE len(regexp_replace(line, '\s', '', 'g')) = 0 OR len(regexp_replace(line, '[^\p{L}]', '', 'g')) * 2 < len(regexp_replace(line, '\s', '', 'g'))) AS noise,
  count(*) FILTER (WHERE regexp_matches(lower(strip(line)), '^[#\d. ]*(appendix|appendices|supplementary material)\b')) AS appendix FROM l GROUP BY doc_id""")
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.when(exemplars.is_noise(F.col("line")), 1)).alias("noise"), F.count(F.when(exemplars.is_appendix_heading(F.col("line")), 1)).alias("appendix"))


@query("s28_before_references", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: regexp_replace(lower(strip(x)), '^[#\d. ]+', '') IN ({headings})), true), 0) AS p FROM l)
SELECT doc_id, array_to_string(CASE WHEN p > 0 THEN l[1:p - 1] ELSE l END, chr(10)) AS body FROM p""".replace("{headings}", ", ".join(f"'{h}'" for h in exemplars.REFERENCE_HEADINGS)))
def before_references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", exemplars.before_references(F.col("text")).alias("body"))


@query("g7_enqueued", """
WITH h AS (SELECT sha1(concat(coalesce(source_query, ''), chr(10), coalesce(paper_title, ''), chr(10), coalesce(arxiv_id, ''), chr(10), coalesce(url, ''))) AS candidate_key, min(hn_id) AS hn_id FROM hard_negative_papers GROUP BY 1)
SELECT candidate_key, hn_id, 'pending' AS review_status FROM h""")
def enqueued(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hard_negative_papers").select("hn_id", F.col("source_query").alias("query_key"), F.col("paper_title").alias("title"), "arxiv_id", "url")
    return exemplars.enqueued(x, ["hn_id"]).select("candidate_key", "hn_id", "review_status")


@query("q12_enqueue_upsert", Q + """, n AS (SELECT candidate_key, candidate_title || '!' AS title, 'new' AS s FROM q WHERE id % 3 = 0 UNION ALL SELECT 'n' || id, 'fresh', 'new' FROM q WHERE id % 100 = 0),
b AS (SELECT candidate_key, candidate_title AS title, review_status AS s FROM q)
SELECT coalesce(b.candidate_key, n.candidate_key) AS candidate_key, CASE WHEN n.candidate_key IS NOT NULL THEN n.title ELSE b.title END AS title, CASE WHEN b.candidate_key IS NOT NULL THEN b.s ELSE n.s END AS s
FROM b FULL JOIN n USING (candidate_key)""")
def enqueue_upsert(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d)
    base = x.select("candidate_key", F.col("candidate_title").alias("title"), F.col("review_status").alias("s"))
    known = x.where("id % 3 = 0").select("candidate_key", F.concat("candidate_title", F.lit("!")).alias("title"), F.lit("new").alias("s"))
    fresh = x.where("id % 100 = 0").select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("candidate_key"), F.lit("fresh").alias("title"), F.lit("new").alias("s"))
    return store.upsert(base, known.unionByName(fresh), ["candidate_key"], protected=["s"])


@query("j13_canonical_update", Q + """, c AS (SELECT id FROM q QUALIFY row_number() OVER (PARTITION BY query_key, retrieval_rank ORDER BY
  CASE review_status WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END,
  CASE parse_status WHEN 'parsed' THEN 0 WHEN 'metadata_only' THEN 1 WHEN 'no_pdf' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END, review_payload IS NULL, updated_at DESC NULLS LAST, id DESC) = 1)
SELECT review_status, count(*) AS n FROM q WHERE id IN (SELECT id FROM c) GROUP BY review_status""")
def canonical_update(spark: SparkSession, d: str) -> DataFrame:
    return queue.status_counts(queue.canonical_rows(_q(spark, d)), "review_status")


@query("m7_scores_parsed", "SELECT DISTINCT retrieval_rank AS r, CASE WHEN retrieval_rank BETWEEN 1 AND 5 THEN retrieval_rank END AS score FROM candidate_queue")
def scores_parsed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").select(F.col("retrieval_rank").alias("r")).distinct()
    return x.withColumn("score", style.judged_score(F.col("r").cast("string")))


@query("x4_control_characters", "SELECT DISTINCT paper_id, row_no, len(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))::INTEGER AS n FROM paper_records")
def control_characters(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "paper_records").distinct()
    return x.select("paper_id", "row_no", F.length(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")).alias("n")).distinct()


@query("s20_cited_names", r"SELECT doc_id, list_distinct(regexp_extract_all(text, '([A-Z][\p{L}]+ et al)', 1)) AS cited FROM documents WHERE regexp_matches(text, '[A-Z][\p{L}]+ et al')".replace("list_distinct(", "list_sort(list_distinct(").replace(", 1))", ", 1)))"))
def cited_names(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][\p{L}]+ et al)"), 1)))
    return table(spark, d, "documents").select("doc_id", found.alias("cited")).where("size(cited) > 0")


@query("sk13_resumed", "SELECT DISTINCT id, title FROM openreview_papers WHERE id IN (SELECT min(id) FROM openreview_papers GROUP BY id) AND downloaded_at = (SELECT min(downloaded_at) FROM openreview_papers p WHERE p.id = openreview_papers.id)")
def resumed(spark: SparkSession, d: str) -> DataFrame:
    """First half done, then the run resumes with what is missing; the result is that of one run."""
    from folioforge.operators.dedupe import keep_first, remaining

    p = table(spark, d, "openreview_papers")
    first = p.groupBy("id").agg(F.min("downloaded_at").alias("downloaded_at"))
    todo = p.join(first, ["id", "downloaded_at"]).select("id", "title").distinct()
    path = shared_folder(spark)
    todo.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).write.parquet(path)
    done = spark.read.parquet(path)
    remaining(todo, done, ["id"]).write.mode("append").parquet(path)
    return keep_first(spark.read.parquet(path), ["id", "title"], ["id"])
