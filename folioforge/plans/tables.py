"""Queries of sources, joins, sets, keyed stores, queues, notes and feedback.

``q`` in the SQL is the candidate queue with each id once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import dedupe, notes, queue, store, style
from folioforge.plans.registry import query
from folioforge.session import shared_folder
from folioforge.sources import readers, table, writers

Q = "WITH q AS (SELECT DISTINCT ON (id) * FROM candidate_queue)"
AS_OF = "2026-01-01 00:00:00"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_queue").dropDuplicates(["id"])


# --- sources -------------------------------------------------------------------------------


@query("sc1_jsonl_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark) + "/docs.jsonl"
    writers.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path)
    return readers.jsonl(spark, path, "doc_id long, text string, lang string, source string")


@query("sc2_tsv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, coalesce(c_mktsegment, '') AS c_mktsegment, '' AS missing FROM customer")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark) + "/customers.tsv"
    x = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    x.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return readers.tsv(spark, path, ["c_custkey", "c_name", "c_mktsegment", "missing"])


@query("sk6_csv_round_trip", "SELECT DISTINCT hn_id::VARCHAR AS hn_id, paper_title AS title FROM hard_negative_papers")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark) + "/titles.csv"
    x = table(spark, d, "hard_negative_papers").select(F.col("hn_id").cast("string").alias("hn_id"), F.col("paper_title").alias("title")).distinct()
    x.select(sorted(x.columns)).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.csv(spark, path, ["hn_id", "title"])


@query("sc4_corpus_papers", r"""
WITH r AS (SELECT DISTINCT representation_type, regexp_replace(regexp_replace(strip(paper_id), '\.restored$', ''), '\.docling$', '') AS paper_id, source_path, row_no, text
           FROM paper_records WHERE length(text) > 0)
SELECT representation_type, paper_id, strip(string_agg(text, chr(10) || chr(10) ORDER BY source_path, row_no)) AS text, list_sort(list_distinct(list(source_path))) AS source_paths
FROM r GROUP BY ALL""")
def corpus_papers(spark: SparkSession, d: str) -> DataFrame:
    return readers.corpus_papers(table(spark, d, "paper_records").distinct(), ["source_path", "row_no"])


@query("sc5_query_records", """
WITH v AS (SELECT id, strip(query_key) AS query_id, strip(query_text) AS query_text, strip(paper_id) AS target_paper_id, source_view AS aspect_group FROM candidate_queue
           WHERE length(strip(query_key)) > 0 AND length(strip(query_text)) > 0 AND length(strip(paper_id)) > 0)
SELECT query_id, query_text, target_paper_id, aspect_group FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) = 1""")
def query_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_queue").where("length(trim(query_key)) > 0").select("query_key", "query_text", "paper_id", "source_view", F.col("id").alias("pos"))
    return readers.query_records(rows, "pos")


@query("sc7_one_query_records", """
WITH v AS (SELECT id, strip(query_key) AS query_id, strip(query_text) AS query_text, strip(paper_id) AS target_paper_id, source_view AS aspect_group FROM candidate_queue
           WHERE length(strip(query_key)) > 0 AND length(strip(query_text)) > 0 AND length(strip(paper_id)) > 0 AND source_view = 'method')
SELECT query_id, query_text, target_paper_id, aspect_group FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) = 1""")
def one_query_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_queue").where("length(trim(query_key)) > 0 AND source_view = 'method'")
    return readers.query_records(rows.select("query_key", "query_text", "paper_id", "source_view", F.col("id").alias("pos")), "pos", source_first=True)


@query("sc8_rankings", "SELECT query_key AS query_id, candidate_key AS paper_id, retrieval_rank::INTEGER AS rank FROM q WHERE retrieval_rank >= 1".replace("FROM q", "FROM (SELECT DISTINCT ON (id) * FROM candidate_queue)"))
def rankings(spark: SparkSession, d: str) -> DataFrame:
    rows = _q(spark, d).select(F.col("query_key").alias("query_id"), F.col("candidate_key").alias("paper_id"), F.col("retrieval_rank").cast("string").alias("rank"))
    return readers.rankings(rows)


@query("sc9_embedding_map", """
SELECT label AS key, min(vec_id) AS position, round(max_by(embedding[1]::DOUBLE, vec_id), 6) AS first_number FROM embeddings GROUP BY label""")
def embedding_map(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.functions.vectors import encoded

    rows = table(spark, d, "embeddings").select(F.col("label").alias("key"), encoded(F.col("embedding")).alias("text"), "vec_id")
    x = readers.embedding_map(rows, "key", "text", "vec_id")
    return x.select("key", "position", F.round(F.col("vector")[0], 6).alias("first_number"))


@query("sc10_ids_in_order", "SELECT strip(paper_id) AS paper_id, min(id) AS first_position FROM candidate_queue GROUP BY 1")
def ids_in_order(spark: SparkSession, d: str) -> DataFrame:
    return readers.ids_in_order(table(spark, d, "candidate_queue"), "paper_id", "id")


@query("sc21_extraction_jobs", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def extraction_jobs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    corpus = table(spark, d, "orders").withColumnRenamed("o_custkey", "belonging_shard")
    have = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("belonging_shard"))
    done = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("belonging_shard"))
    return readers.extraction_jobs(corpus, have, done).select("o_orderkey")


@query("sk4_metric_table", """
SELECT round(100 * avg(CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END), 2) AS low, round(100 * avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 2) AS zero FROM embeddings""")
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = e.agg(F.avg(F.when(F.col("label") < 5, 1.0).otherwise(0.0)).alias("low"), F.avg(F.when(F.col("label") == 0, 1.0).otherwise(0.0)).alias("zero"))
    long = m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in m.columns])))
    return writers.metric_table(long, ["low", "zero"])


@query("sk4_ranking_documents", """
SELECT query_id, list(item_id ORDER BY rank) AS ranked_ids FROM (
  SELECT paper_id AS query_id, candidate_key AS item_id, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS rank FROM (SELECT DISTINCT ON (id) * FROM candidate_queue) QUALIFY rank <= 5)
GROUP BY query_id""")
def ranking_documents(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy("id")
    x = _q(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    x = x.select(F.col("paper_id").alias("query_id"), F.col("candidate_key").alias("paper_id"), "rank", F.lit(1.0).alias("score"))
    return writers.ranking_documents(x).select("query_id", "ranked_ids")


# --- keyed stores ---------------------------------------------------------------------------

BASE_SQL = """
WITH base AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 < 8),
delta AS (SELECT o_orderkey AS k, o_totalprice * 1.5 AS price, 'N' AS status FROM orders WHERE o_orderkey % 10 >= 6)
"""


def _base_delta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return o.where("k % 10 < 8"), o.where("k % 10 >= 6").select("k", (F.col("price") * 1.5).alias("price"), F.lit("N").alias("status"))


@query("sk8_upsert", BASE_SQL + """
SELECT coalesce(b.k, d.k) AS k, round(CASE WHEN d.k IS NOT NULL THEN d.price ELSE b.price END, 6) AS price, CASE WHEN b.k IS NOT NULL THEN b.status ELSE d.status END AS status
FROM base b FULL JOIN delta d ON b.k = d.k""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_base_delta(spark, d), ["k"], protected=["status"]).withColumn("price", F.round("price", 6))


@query("sk9_insert_ignore", BASE_SQL + "SELECT k, round(price, 6) AS price, status FROM base UNION ALL SELECT k, round(price, 6), status FROM delta WHERE k NOT IN (SELECT k FROM base)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return store.insert_ignore(*_base_delta(spark, d), ["k"]).withColumn("price", F.round("price", 6))


@query("sk10_replace_all", BASE_SQL + """
SELECT coalesce(b.k, d.k) AS k, round(CASE WHEN d.k IS NOT NULL THEN d.price ELSE b.price END, 6) AS price, CASE WHEN d.k IS NOT NULL THEN d.status ELSE b.status END AS status
FROM base b FULL JOIN delta d ON b.k = d.k""")
def replace_all(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_base_delta(spark, d), ["k"]).withColumn("price", F.round("price", 6))


@query("sk11_latest_feedback", """
SELECT task, paper_forum_id, query_id, feedback_item_id, reviewer_username, judgement FROM human_feedback
QUALIFY row_number() OVER (PARTITION BY task, paper_forum_id, query_id, feedback_item_id, reviewer_username ORDER BY updated_at DESC, id DESC) = 1""")
def latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    keys = ["task", "paper_forum_id", "query_id", "feedback_item_id", "reviewer_username"]
    x = table(spark, d, "human_feedback").groupBy(*keys).agg(F.max(F.struct("updated_at", "id", "judgement")).alias("last"))
    return x.select(*keys, F.col("last.judgement").alias("judgement"))


@query("sk12_delete", BASE_SQL + "SELECT k, status FROM base WHERE k NOT IN (SELECT k FROM delta)")
def delete(spark: SparkSession, d: str) -> DataFrame:
    base, delta = _base_delta(spark, d)
    return store.delete_keys(base, delta, ["k"]).select("k", "status")


@query("q9_write_back", BASE_SQL + "SELECT b.k, coalesce(CASE WHEN b.k % 3 = 0 THEN d.status END, b.status) AS status FROM base b LEFT JOIN delta d USING (k)")
def write_back(spark: SparkSession, d: str) -> DataFrame:
    base, delta = _base_delta(spark, d)
    results = delta.select("k", F.when(F.col("k") % 3 == 0, F.col("status")).alias("status"))
    return store.write_back(base, results, ["k"], ["status"]).select("k", "status")


@query("j15_resume", BASE_SQL + "SELECT k FROM delta WHERE k NOT IN (SELECT k FROM base)")
def resume(spark: SparkSession, d: str) -> DataFrame:
    base, delta = _base_delta(spark, d)
    return dedupe.remaining(delta, base, ["k"]).select("k")


@query("st2_merge_override", BASE_SQL + "SELECT k, status FROM delta UNION ALL SELECT k, status FROM base WHERE k NOT IN (SELECT k FROM delta)")
def merge_override(spark: SparkSession, d: str) -> DataFrame:
    base, delta = _base_delta(spark, d)
    return dedupe.merge_override(base, delta, ["k"]).select("k", "status")


@query("st1_union_all", "SELECT query_text, count(*) AS n FROM (SELECT query_text FROM candidate_queue UNION ALL SELECT query_text FROM golden_query_embeddings) GROUP BY query_text")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "candidate_queue").select("query_text"), table(spark, d, "golden_query_embeddings").select("query_text")
    return a.unionByName(b).groupBy("query_text").agg(F.count("*").alias("n"))


@query("st3_keep_first", "SELECT id, title, num_citations FROM openreview_papers QUALIFY row_number() OVER (PARTITION BY id ORDER BY downloaded_at, num_citations, title) = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_first(table(spark, d, "openreview_papers"), ["id"], ["downloaded_at", F.col("num_citations").asc_nulls_last(), "title"]).select("id", "title", "num_citations")


@query("w5_first_place_last_value", "SELECT paper_id, min(id) AS id, max_by(candidate_title, id) AS candidate_title FROM (SELECT DISTINCT ON (id) * FROM candidate_queue) GROUP BY paper_id")
def first_place_last_value(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.first_place_last_value(_q(spark, d), ["paper_id"], "id", ["candidate_title"])


@query("st4_unique_titles", Q + r""", t AS (SELECT query_key, id, strip(regexp_replace(lower(candidate_title), '\s+', ' ', 'g')) AS title FROM q WHERE query_key IS NOT NULL),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_key, title ORDER BY id) = 1)
SELECT query_key, id FROM f QUALIFY row_number() OVER (PARTITION BY query_key ORDER BY id) <= 10""")
def unique_titles(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d).where("query_key IS NOT NULL")
    return dedupe.unique_titles(x, ["query_key"], tx.title_key(F.col("candidate_title")), ["id"], 10).select("query_key", "id")


@query("st5_unique_listings", "SELECT coalesce(nullif(replace(strip(arxiv_id), '/', '_'), ''), substr(sha1(coalesce(paper_title, '')), 1, 12)) AS paper_id, min(hn_id) AS hn_id FROM hard_negative_papers GROUP BY 1")
def unique_listings(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.functions.keys import listing_paper_id

    x = table(spark, d, "hard_negative_papers").withColumn("paper_id", listing_paper_id(F.col("arxiv_id"), F.col("paper_title")))
    return x.groupBy("paper_id").agg(F.min("hn_id").alias("hn_id"))


@query("st7_subset_groups", """
WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'), a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'O')
SELECT DISTINCT o_custkey FROM e WHERE o_custkey NOT IN (SELECT o_custkey FROM (SELECT * FROM e EXCEPT SELECT * FROM a))""")
def subset_groups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    keys = ["o_custkey", "o_orderpriority"]
    return dedupe.contains_all(o.where("o_orderstatus = 'O'").select(*keys).distinct(), o.where("o_orderstatus <> 'O'").select(*keys).distinct(), *keys)


# --- queue ----------------------------------------------------------------------------------

PRIORITY = """CASE review_status WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END,
  CASE parse_status WHEN 'parsed' THEN 0 WHEN 'metadata_only' THEN 1 WHEN 'no_pdf' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END,
  review_payload IS NULL, updated_at DESC NULLS LAST, id DESC"""
CANONICAL = Q + f", c AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query_key, retrieval_rank ORDER BY {PRIORITY}) = 1)"


@query("w1_canonical_rows", CANONICAL + " SELECT query_key, retrieval_rank, id FROM c")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    return queue.canonical_rows(_q(spark, d)).select("query_key", "retrieval_rank", "id")


PROGRESS = Q + """, p AS (SELECT query_key, count(*) FILTER (WHERE review_status = 'completed') AS completed,
  count(*) FILTER (WHERE review_status = 'completed' AND review_label = 'hard_negative') AS hard_negatives FROM q GROUP BY query_key)"""


@query("ag21_progress", PROGRESS + " SELECT * FROM p")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return queue.progress(_q(spark, d))


@query("q1_claim_within_budget", PROGRESS + """
SELECT q.id, q.query_key, q.retrieval_rank FROM q LEFT JOIN p USING (query_key) WHERE review_status = 'pending' AND coalesce(hard_negatives, 0) < 10 AND coalesce(completed, 0) < 30
ORDER BY query_key NULLS FIRST, retrieval_rank NULLS FIRST, id LIMIT 200""")
def claim_within_budget(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim_within_budget(_q(spark, d), 200).select("id", "query_key", "retrieval_rank")


@query("q2_claim_with_minimum", Q + """
SELECT id FROM q WHERE parse_status = 'pending' AND query_key IN (SELECT query_key FROM q GROUP BY query_key HAVING count(*) >= 25)
ORDER BY query_key, retrieval_rank NULLS FIRST, id LIMIT 200""")
def claim_with_minimum(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim_with_minimum(_q(spark, d), "pending", 200).select("id")


@query("q4_claim_download", Q + """
SELECT id FROM q WHERE candidate_pdf_url IS NOT NULL AND (NOT json_valid(review_payload) OR review_payload IS NULL OR json_extract_string(review_payload, '$.candidate_full_text_path') IS NULL)
ORDER BY query_key NULLS FIRST, retrieval_rank NULLS FIRST, id LIMIT 200""")
def claim_download(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d).where(F.col("candidate_pdf_url").isNotNull() & F.get_json_object("review_payload", "$.candidate_full_text_path").isNull())
    return queue.first_in_order(x, 200).select("id")


@query("q6_close_satisfied", PROGRESS + """, f AS (SELECT query_key FROM p WHERE hard_negatives >= 10 OR completed >= 30)
SELECT id, CASE WHEN review_status = 'pending' AND query_key IN (SELECT query_key FROM f WHERE query_key IS NOT NULL) THEN 'completed' ELSE review_status END AS review_status,
  CASE WHEN review_status = 'pending' AND query_key IN (SELECT query_key FROM f WHERE query_key IS NOT NULL) THEN 'ignored' ELSE review_label END AS review_label FROM q""")
def close_satisfied(spark: SparkSession, d: str) -> DataFrame:
    return queue.close_satisfied(_q(spark, d)).select("id", "review_status", "review_label")


@query("q7_reset_stale", Q + f"""
SELECT id, CASE WHEN review_status = 'processing' AND updated_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 600 SECOND THEN 'pending' ELSE review_status END AS review_status FROM q""")
def reset_stale(spark: SparkSession, d: str) -> DataFrame:
    return queue.reset_stale(_q(spark, d), F.lit(AS_OF).cast("timestamp"), 600).select("id", "review_status")


@query("q8_reset_failed", CANONICAL + """
SELECT id, CASE WHEN id IN (SELECT id FROM c WHERE review_status = 'failed' AND error_message IS NOT NULL) THEN 'pending' ELSE review_status END AS review_status FROM q""")
def reset_failed(spark: SparkSession, d: str) -> DataFrame:
    return queue.reset_failed(_q(spark, d), F.col("error_message").isNotNull()).select("id", "review_status")


@query("ag20_status_counts", Q + """
SELECT coalesce(s, review_status) AS review_status, coalesce(n, 0) AS n FROM (SELECT review_status, count(*) AS n FROM q GROUP BY review_status)
FULL JOIN (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('none')) v(s) ON s = review_status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return queue.status_counts(_q(spark, d), "review_status", ("pending", "processing", "completed", "failed", "none"))


@query("tk9_early_stop", Q + """, r AS (SELECT *, coalesce(sum((review_label = 'hard_negative')::INT) OVER (PARTITION BY query_key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM q WHERE query_key IS NOT NULL)
SELECT id, query_key FROM r WHERE seen < 3""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return queue.early_stop(_q(spark, d).where("query_key IS NOT NULL"), "query_key", "id", "review_label", 3).select("id", "query_key")


@query("tk12_latest_completed", Q + " SELECT id, updated_at FROM q WHERE review_status = 'completed' ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 25")
def latest_completed(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d).where("review_status = 'completed'").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(25)
    return x.select("id", "updated_at")


@query("tk13_nulls_last", """
SELECT id, row_number() OVER (PARTITION BY venue ORDER BY cdate ASC NULLS LAST, submission_number::VARCHAR, id)::INTEGER AS place
FROM (SELECT DISTINCT ON (id) id, venue, cdate, submission_number FROM openreview_papers ORDER BY id, downloaded_at, cdate NULLS LAST)""")
def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    p = dedupe.keep_first(table(spark, d, "openreview_papers"), ["id"], ["downloaded_at", F.col("cdate").asc_nulls_last()])
    w = Window.partitionBy("venue").orderBy(F.col("cdate").asc_nulls_last(), F.col("submission_number").cast("string"), "id")
    return p.select("id", F.row_number().over(w).alias("place"))


@query("q13_worker_health", """
WITH w AS (SELECT user_id AS worker, max(ts) AS last, min(ts) AS started, max_by(event_type, (ts, event_type)) AS ev FROM events GROUP BY user_id)
SELECT worker, CASE WHEN ev = 'exit' THEN 'exited' WHEN epoch(date_trunc('second', TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(last)) >= 43200 THEN 'silent'
  WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(started)) >= 2500000 THEN 'long_running' ELSE 'healthy' END AS health FROM w""")
def worker_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))
    return queue.worker_health(e, F.lit("2024-01-30 12:00:00").cast("timestamp"), 43200, 2_500_000)


@query("ag26_interval_rates", """
SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def interval_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    x = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return x.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "mean")


# --- joins and nested records -----------------------------------------------------------------


@query("pf14_complete_views", """
WITH low AS (SELECT l_orderkey AS paper, l_linenumber % 3 AS view FROM lineitem WHERE l_returnflag <> 'A'),
ok AS (SELECT paper FROM low GROUP BY paper HAVING count(DISTINCT view) = 3)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT paper FROM ok)""")
def complete_views(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    ok = x.where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.countDistinct(F.col("l_linenumber") % 3).alias("views")).where("views = 3").select("l_orderkey")
    return x.where("l_linestatus = 'O'").join(ok, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j17_division", """
WITH e AS (SELECT DISTINCT query_key, source_view FROM candidate_queue WHERE query_key IS NOT NULL), a AS (SELECT DISTINCT query_key, source_view FROM candidate_queue WHERE review_label IS NOT NULL AND query_key IS NOT NULL)
SELECT DISTINCT query_key FROM e WHERE query_key NOT IN (SELECT query_key FROM (SELECT * FROM e EXCEPT SELECT * FROM a))""")
def division(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").where("query_key IS NOT NULL")
    return dedupe.contains_all(x.select("query_key", "source_view").distinct(), x.where("review_label IS NOT NULL").select("query_key", "source_view").distinct(), "query_key", "source_view")


@query("j7_assembled", """
WITH a AS (SELECT paper_id, min(id) AS position, count(*) AS n_candidates FROM (SELECT DISTINCT ON (id) * FROM candidate_queue) GROUP BY paper_id),
b AS (SELECT paper_forum_id AS paper_id, min(id) AS position, count(DISTINCT id) AS n_feedback FROM human_feedback GROUP BY 1),
c AS (SELECT paper_id, min(doc_id) AS position, count(*) AS n_documents FROM documents WHERE paper_id IS NOT NULL GROUP BY 1),
s AS (SELECT paper_id, 0 AS stage, position FROM a UNION ALL SELECT paper_id, 1, position FROM b UNION ALL SELECT paper_id, 2, position FROM c),
f AS (SELECT paper_id, min(stage) AS first_stage, arg_min(position, stage) AS first_position FROM s GROUP BY paper_id)
SELECT paper_id, first_stage, first_position, n_candidates, n_feedback, n_documents FROM f LEFT JOIN a USING (paper_id) LEFT JOIN b USING (paper_id) LEFT JOIN c USING (paper_id)""")
def assembled(spark: SparkSession, d: str) -> DataFrame:
    a = _q(spark, d).groupBy("paper_id").agg(F.min("id").alias("position"), F.count("*").alias("n_candidates"))
    b = table(spark, d, "human_feedback").groupBy(F.col("paper_forum_id").alias("paper_id")).agg(F.min("id").alias("position"), F.countDistinct("id").alias("n_feedback"))
    c = table(spark, d, "documents").where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("doc_id").alias("position"), F.count("*").alias("n_documents"))
    return notes.assembled([a, b, c], "paper_id")


@query("j7_final_document", """
WITH q AS (SELECT DISTINCT ON (id) * FROM candidate_queue),
a AS (SELECT paper_id, min(id) AS position, max(paper_title) AS queue_title, count(*) AS n_candidates FROM q GROUP BY paper_id),
b AS (SELECT paper_forum_id AS paper_id, min(id) AS position, count(DISTINCT id) AS n_feedback FROM human_feedback GROUP BY 1),
c AS (SELECT paper_id, min(doc_id) AS position, count(*) AS n_documents FROM documents WHERE paper_id IS NOT NULL GROUP BY 1),
e AS (SELECT id AS paper_id, min(submission_number)::BIGINT AS position, max(title) AS own_title FROM openreview_papers GROUP BY 1),
g AS (SELECT paper_id, min(chunk_index)::BIGINT AS position, count(DISTINCT chunk_id) AS n_chunks FROM chunk_records GROUP BY 1),
s AS (SELECT paper_id, 0 AS stage, position FROM a UNION ALL SELECT paper_id, 1, position FROM b UNION ALL SELECT paper_id, 2, position FROM c UNION ALL SELECT paper_id, 3, position FROM e UNION ALL SELECT paper_id, 4, position FROM g),
f AS (SELECT paper_id, min(stage) AS first_stage FROM s GROUP BY paper_id),
k AS (SELECT DISTINCT paper_id, query_text, source_view, query_type FROM q),
r AS (SELECT paper_id, query_text, source_view, query_type, count(*) FILTER (WHERE review_label = 'hard_negative') AS hard FROM q GROUP BY ALL),
n AS (SELECT k.paper_id, count(*) AS n_queries, sum(hard)::BIGINT AS hard FROM k LEFT JOIN r ON k.paper_id = r.paper_id AND k.query_text IS NOT DISTINCT FROM r.query_text AND k.source_view IS NOT DISTINCT FROM r.source_view
  AND k.query_type IS NOT DISTINCT FROM r.query_type GROUP BY k.paper_id)
SELECT f.paper_id, first_stage, coalesce(nullif(strip(own_title), ''), nullif(strip(queue_title), '')) AS title, n_candidates, n_feedback, n_documents, n_chunks, coalesce(n_queries, 0)::INTEGER AS n_queries, coalesce(hard, 0) AS hard
FROM f LEFT JOIN a USING (paper_id) LEFT JOIN b USING (paper_id) LEFT JOIN c USING (paper_id) LEFT JOIN e USING (paper_id) LEFT JOIN g USING (paper_id) LEFT JOIN n USING (paper_id)""")
def final_document(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    a = q.groupBy("paper_id").agg(F.min("id").alias("position"), F.max("paper_title").alias("queue_title"), F.count("*").alias("n_candidates"))
    b = table(spark, d, "human_feedback").groupBy(F.col("paper_forum_id").alias("paper_id")).agg(F.min("id").alias("position"), F.countDistinct("id").alias("n_feedback"))
    c = table(spark, d, "documents").where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("doc_id").alias("position"), F.count("*").alias("n_documents"))
    e = table(spark, d, "openreview_papers").groupBy(F.col("id").alias("paper_id")).agg(F.min("submission_number").cast("long").alias("position"), F.max("title").alias("own_title"))
    g = table(spark, d, "chunk_records").groupBy("paper_id").agg(F.min("chunk_index").cast("long").alias("position"), F.countDistinct("chunk_id").alias("n_chunks"))
    keys = ["paper_id", "query_text", "source_view", "query_type"]
    hard = q.groupBy(*keys).agg(F.count_if(F.col("review_label") == "hard_negative").alias("hard"))
    rows = notes.with_results(q.select(*keys).distinct(), hard, keys)
    x = notes.final_document([a, b, c, e, g], "paper_id", ["own_title", "queue_title"], rows, ["query_text", "source_view", "query_type", "hard"], ["query_text", "source_view"])
    total = F.aggregate("queries", F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r["hard"], F.lit(0)))
    return x.select("paper_id", "first_stage", "title", "n_candidates", "n_feedback", "n_documents", "n_chunks", F.size("queries").alias("n_queries"), total.alias("hard"))


KIND = """CASE WHEN doc_kind LIKE '%decision%' THEN 'decision' WHEN doc_kind LIKE '%meta_review%' THEN 'meta_review' WHEN doc_kind LIKE '%rebuttal%' OR doc_kind LIKE '%response%' THEN 'rebuttal'
  WHEN doc_kind LIKE '%review%' THEN 'review' WHEN doc_kind LIKE '%comment%' THEN 'comment' ELSE 'other' END"""


@query("pf11_note_kinds", f"SELECT doc_id, {KIND} AS kind FROM documents")
def note_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", notes.note_kind(F.col("doc_kind"), F.array().cast("array<string>")).alias("kind"))


@query("pf12_note_buckets", f"""
WITH n AS (SELECT paper_id, doc_id, {KIND} AS kind FROM documents WHERE paper_id IS NOT NULL)
SELECT paper_id, {', '.join(f"coalesce(list(doc_id ORDER BY doc_id) FILTER (WHERE kind = '{k}'), []) AS {k}" for k in notes.KINDS)} FROM n GROUP BY paper_id""")
def note_buckets(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("paper_id IS NOT NULL").withColumn("kind", notes.note_kind(F.col("doc_kind"), F.array().cast("array<string>")))
    return notes.kind_buckets(x.withColumn("item", F.col("doc_id")), "paper_id", "kind", "item", ["doc_id"])


@query("x10_feedback_rows", """
WITH p AS (SELECT query_id, reviewer_username, feedback_item_id AS item, judgement FROM human_feedback WHERE judgement IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY query_id, reviewer_username, item ORDER BY updated_at DESC, id DESC) = 1)
SELECT query_id, reviewer_username, item AS feedback_item_id, judgement FROM p""")
def feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    keys = ["query_id", "reviewer_username"]
    payload = notes.feedback_payload(table(spark, d, "human_feedback").where("judgement IS NOT NULL"), keys)
    nested = payload.select(*keys, F.col("items")["query_relevance"].alias("query_relevance"), F.col("items")["human_like"].alias("human_like"),
                            F.map_filter("items", lambda k, v: k.startswith("cand_")).alias("checks"))
    return notes.feedback_rows(nested, keys, ["query_relevance", "human_like"], "checks")


@query("ag16_weighted_merge", """
SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS l_extendedprice, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_returnflag""")
def weighted_merge(spark: SparkSession, d: str) -> DataFrame:
    x = style.weighted_merge(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", ["l_extendedprice"])
    return x.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("m6_centred_fit", "SELECT DISTINCT related_bullet_indice AS score, CASE WHEN related_bullet_indice BETWEEN 1 AND 5 THEN greatest(0.0, 1 - abs(related_bullet_indice - 3) / 2) END AS fit FROM candidate_queue")
def centred_fit(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").select(F.col("related_bullet_indice").alias("score")).distinct()
    return x.withColumn("fit", style.centred_fit(style.judged_score(F.col("score").cast("string"))))


@query("pf20_refresh", """
WITH n AS (SELECT id, arg_max(title, (downloaded_at, title)) AS title FROM openreview_papers GROUP BY id)
SELECT DISTINCT q.paper_id, q.paper_title, coalesce(nullif(trim(n.title), ''), q.paper_title) AS title FROM candidate_queue q LEFT JOIN n ON n.id = q.paper_id""")
def refresh(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "openreview_papers").groupBy("id").agg(F.max(F.struct("downloaded_at", "title")).alias("n")).select(F.col("id").alias("paper_id"), F.col("n.title").alias("new"))
    x = table(spark, d, "candidate_queue").select("paper_id", "paper_title").distinct().join(new, "paper_id", "left")
    return x.select("paper_id", "paper_title", F.coalesce(F.nullif(F.trim("new"), F.lit("")), F.col("paper_title")).alias("title"))


@query("pf19_venue_year", r"""
SELECT DISTINCT id, coalesce(nullif(trim(venue), ''), split_part(venueid, '/', 1)) AS venue,
  coalesce(CASE WHEN year BETWEEN 1900 AND 2099 THEN year END, nullif(regexp_extract(venue, '\b((?:19|20)\d{2})\b', 1), '')::INTEGER) AS year FROM openreview_papers""")
def venue_year(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "openreview_papers")
    venue = F.coalesce(F.nullif(F.trim("venue"), F.lit("")), F.get(F.split("venueid", "/"), F.lit(0)))
    return p.select("id", venue.alias("venue"), F.coalesce(F.when(F.col("year").between(1900, 2099), F.col("year")), tx.year_in(F.col("venue"))).alias("year")).distinct()
