"""Queries of record shaping, exemplars, policies, connectors and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions import vectors
from folioforge.operators import exemplars, external, notes, style
from folioforge.plans.registry import query
from folioforge.session import shared_folder
from folioforge.sources import readers, table
from folioforge.streaming import queues

Q = "WITH q AS (SELECT DISTINCT ON (id) * FROM candidate_queue)"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_queue").dropDuplicates(["id"])


@query("pf3_view_labels", r"""
SELECT DISTINCT view_label, CASE WHEN strip(regexp_replace(lower(view_label), '\s+', ' ', 'g')) IN ('experiment', 'experiments', 'result', 'results', 'experiment/result', 'experiments/results')
  THEN 'experiment/result' ELSE strip(regexp_replace(lower(view_label), '\s+', ' ', 'g')) END AS folded FROM golden_query_embeddings""")
def view_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings").select("view_label").distinct()
    return x.withColumn("folded", tx.view_label(F.col("view_label")))


@query("pf15_restricted", Q + "SELECT id FROM q WHERE paper_id IN (SELECT paper_forum_id FROM human_feedback)")
def restricted(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "human_feedback").select(F.col("paper_forum_id").alias("paper_id"))
    return exemplars.restricted(_q(spark, d), ids, "paper_id").select("id")


@query("pf18_policy_default", "SELECT DISTINCT model_name, coalesce(n, true) AS normalise FROM paper_text_embeddings LEFT JOIN (VALUES ('pebble-embed-v1', false)) p(m, n) ON m = model_name")
def policy_default(spark: SparkSession, d: str) -> DataFrame:
    policy = spark.createDataFrame([("pebble-embed-v1", False)], "model_name string, n boolean")
    x = table(spark, d, "paper_text_embeddings").select("model_name").distinct().join(F.broadcast(policy), "model_name", "left")
    return x.select("model_name", F.coalesce("n", F.lit(True)).alias("normalise"))


@query("g4_ranking_rows", """
SELECT paper_id AS query_id, row_number() OVER (PARTITION BY paper_id ORDER BY id)::INTEGER AS rank, candidate_key AS item FROM (SELECT DISTINCT ON (id) * FROM candidate_queue)""")
def ranking_rows(spark: SparkSession, d: str) -> DataFrame:
    top = F.array_sort(F.collect_list(F.struct("id", "candidate_key")))
    x = _q(spark, d).groupBy(F.col("paper_id").alias("query_id")).agg(top.alias("t"))
    x = x.select("query_id", F.transform("t", lambda s: s["candidate_key"]).alias("ids"), F.transform("t", lambda s: s["id"].cast("double")).alias("scores"))
    return exemplars.ranking_rows(x, "query_id", "ids", "scores").select("query_id", "rank", F.col("paper_id").alias("item"))


@query("g5_exemplars_per_label", Q + """, u AS (SELECT id, query_key, unnest(keywords_extracted::JSON::VARCHAR[]) AS view_label FROM q WHERE query_key IS NOT NULL)
SELECT DISTINCT id, query_key || '__' || regexp_replace(view_label, '[/ ]', '_', 'g') AS example_id FROM u""")
def exemplars_per_label(spark: SparkSession, d: str) -> DataFrame:
    x = exemplars.per_label(_q(spark, d).where("query_key IS NOT NULL"), "query_key", tx.delimited_list(F.col("keywords_extracted")))
    return x.select("id", "example_id").distinct()


@query("j9_positional", Q + """, n AS (SELECT id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS i FROM q),
r AS (SELECT paper_forum_id AS paper_id, row_number() OVER (PARTITION BY paper_forum_id ORDER BY id) AS i, judgement FROM (SELECT DISTINCT ON (id) * FROM human_feedback))
SELECT n.id, i::INTEGER AS "index", judgement FROM n LEFT JOIN r USING (paper_id, i)""")
def positional(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("paper_forum_id").orderBy("id")
    r = table(spark, d, "human_feedback").dropDuplicates(["id"]).withColumn("index", F.row_number().over(w)).select(F.col("paper_forum_id").alias("paper_id"), "index", "judgement")
    return exemplars.positional(_q(spark, d), r, "paper_id", "id").select("id", "index", "judgement")


@query("j16_flags", Q + """, b AS (SELECT query_key, source_view, related_bullet_indice, max((multimodal_rationale IS NOT NULL)::INT) AS f FROM q GROUP BY ALL)
SELECT q.id, coalesce(f = 1, false) AS shows FROM q LEFT JOIN b ON q.query_key = b.query_key AND q.source_view = b.source_view AND q.related_bullet_indice = b.related_bullet_indice""")
def flags(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d)
    keys = ["query_key", "source_view", "related_bullet_indice"]
    bullets = x.select(*keys, F.col("multimodal_rationale").isNotNull().alias("shows"))
    return exemplars.flagged(x.select("id", *keys), bullets, keys, "shows").select("id", "shows")


@query("x2_renamed_keys", "SELECT doc_id, doc_kind AS review, coalesce(source, '-') AS pros, lang FROM documents")
def renamed_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    m = F.create_map(F.lit("summary"), F.col("doc_kind"), F.lit("strengths"), F.col("source"), F.lit("lang"), F.col("lang"))
    r = exemplars.renamed_keys(m, {"summary": "review", "strengths": "pros"})
    return x.select("doc_id", r["review"].alias("review"), F.coalesce(F.element_at(r, "pros"), F.lit("-")).alias("pros"), F.element_at(r, "lang").alias("lang"))


@query("x6_first_positive", "SELECT o_orderkey, CASE WHEN o_custkey % 5 - 2 > 0 THEN o_custkey % 5 - 2 ELSE o_custkey % 3 + 1 END::INTEGER AS n FROM orders")
def first_positive(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", exemplars.first_positive(F.array(F.lit("x"), (F.col("o_custkey") % 5 - 2).cast("string"), (F.col("o_custkey") % 3 + 1).cast("string"))).alias("n"))


@query("s18_sentence_summaries")
def sentence_summaries(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text IS NOT NULL")
    return x.select("doc_id", exemplars.sentence_summary(F.col("text"), 700).alias("summary"))


@query("s26_snippets", r"""
SELECT doc_id, CASE WHEN len(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS snippet FROM (SELECT doc_id, strip(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents)""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", exemplars.snippet(F.col("text"), 200).alias("snippet"))


@query("s30_prompt_formats", "SELECT DISTINCT example_id, 'Instruct: find papers' || chr(10) || 'Query:' || query_text AS pair, query_text AS plain FROM golden_query_embeddings")
def prompt_formats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings")
    return x.select("example_id", exemplars.prompt_format("pair", F.lit("find papers"), F.col("query_text")).alias("pair"), exemplars.prompt_format("plain", F.lit(""), F.col("query_text")).alias("plain")).distinct()


@query("s29_retrieval_texts", "SELECT DISTINCT id, concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), '')) AS t FROM openreview_papers")
def retrieval_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "openreview_papers")
    return p.select("id", F.concat_ws(" ", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("abstract"), F.lit(""))).alias("t")).distinct()


@query("g2_note_entries", "SELECT doc_id, 'Note/' || k AS path, v AS text FROM (SELECT doc_id, 'kind' AS k, doc_kind AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) WHERE length(strip(v)) > 0")
def note_entries(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    e = notes.entries(F.array(F.lit("kind"), F.lit("source")), F.array("doc_kind", "source"), F.lit("Note"))
    return x.select("doc_id", F.inline(e))


@query("ag25_reviewer_payloads", """
WITH l AS (SELECT query_id, reviewer_username, feedback_item_id, judgement FROM human_feedback QUALIFY row_number() OVER (PARTITION BY query_id, reviewer_username, feedback_item_id ORDER BY updated_at DESC, id DESC) = 1)
SELECT query_id, reviewer_username, count(*) AS items, string_agg(feedback_item_id, ',' ORDER BY feedback_item_id) AS names FROM l GROUP BY ALL""")
def reviewer_payloads(spark: SparkSession, d: str) -> DataFrame:
    p = notes.feedback_payload(table(spark, d, "human_feedback"), ["query_id", "reviewer_username"])
    return p.select("query_id", "reviewer_username", F.size("items").cast("long").alias("items"), F.array_join(F.array_sort(F.map_keys("items")), ",").alias("names"))


@query("ag17_human_closeness", """
WITH v AS (SELECT doc_kind AS side, len(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL AND doc_kind IN ('review', 'abstract')),
n AS (SELECT v, count(*) FILTER (WHERE side = 'review') AS na, count(*) FILTER (WHERE side = 'abstract') AS nb FROM v GROUP BY v),
c AS (SELECT v, sum(na) OVER (ORDER BY v) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS fb, lead(v) OVER (ORDER BY v) AS nxt FROM n)
SELECT round(exp(-sum(abs(fa - fb) * (nxt - v)) / ((SELECT stddev_pop(v) FROM v WHERE side = 'review') + 1e-8)), 6) AS closeness FROM c""")
def human_closeness(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_kind", F.length("text").cast("double").alias("v"))
    spread = x.where("doc_kind = 'review'").agg(F.stddev_pop("v").alias("spread"))
    both = style.wasserstein(x, "doc_kind", "review", "abstract", "v").crossJoin(F.broadcast(spread))  # one row each
    return both.select(F.round(style.human_closeness(F.col("distance"), F.col("spread")), 6).alias("closeness"))


@query("m3_cosine_distances", """
SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_distances(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x = e.join(b, "vec_id")
    return x.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"), F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query("m10_planar_points")
def planar_points(spark: SparkSession, d: str) -> DataFrame:
    return exemplars.planar(table(spark, d, "embeddings"), "embedding", ["vec_id", "label"])


@query("sk5_embedding_cache_keys", """
SELECT DISTINCT query_text, sha1(concat('m', chr(10), 'u', chr(10), 'i', chr(10), query_text)) AS key FROM golden_query_embeddings""")
def embedding_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings").select("query_text").distinct()
    return x.withColumn("key", external.embedding_key("m", "u", "i", F.col("query_text")))


@query("u1_hash_embeddings")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings").select("query_id", "query_text").distinct()
    return external.embedded(x, "query_text", lambda: external.HashEmbedder(32))


@query("tk8_reranked", Q + """, c AS (SELECT query_key AS query_id, row_number() OVER (PARTITION BY query_key ORDER BY id)::INTEGER AS position, id, candidate_citations::DOUBLE AS score FROM q WHERE query_key IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(score) OVER (PARTITION BY query_id) AS scored FROM c),
r AS (SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 AND scored > 0 THEN -score END NULLS LAST, position)::INTEGER AS retrieval_rank
      FROM n WHERE n <= 10 OR scored = 0 OR score IS NOT NULL)
SELECT * FROM r WHERE retrieval_rank <= 10""")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_key").orderBy("id")
    c = _q(spark, d).where("query_key IS NOT NULL").select(F.col("query_key").alias("query_id"), F.row_number().over(w).alias("position"), "id", F.col("candidate_citations").cast("double").alias("s"))
    scores = c.select("query_id", "position", F.col("s").alias("score"))
    return external.reranked(c.drop("s"), scores, 10).select("id", "retrieval_rank")


@query("sc16_searched_candidates")
def searched_candidates(spark: SparkSession, d: str) -> DataFrame:
    records = [{"title": f"{a} {b}", "year": 2020} for a in ("dense", "sparse", "hybrid") for b in ("retrieval", "ranking", "search")]
    plans = table(spark, d, "golden_query_embeddings").select("query_id", F.concat(F.lit("dense ranking "), F.col("query_text")).alias("query")).distinct()
    return external.searched(plans, lambda: external.TableSearch(records), "fixture", limit=5)


@query("j3_queries_with_vectors", """
SELECT count(*) AS n, count(DISTINCT q.query_id) AS queries FROM (SELECT DISTINCT trim(query_key) AS query_id FROM candidate_queue WHERE length(trim(query_key)) > 0) q
JOIN (SELECT DISTINCT query_id FROM golden_query_embeddings WHERE embedding IS NOT NULL) g ON g.query_id = q.query_id""")
def queries_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "candidate_queue").where("length(trim(query_key)) > 0").select(F.trim("query_key").alias("query_id")).distinct()
    g = table(spark, d, "golden_query_embeddings").where("embedding IS NOT NULL").select("query_id").distinct()
    return q.join(g, "query_id").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@query("tk14_paper_limit", "SELECT DISTINCT paper_id FROM paper_records ORDER BY paper_id LIMIT 50")
def paper_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_records").select("paper_id").distinct()
    return rows.orderBy("paper_id").limit(50)


@query("tk15_ordered_lists", Q + "SELECT query_key, list(id ORDER BY retrieval_rank NULLS FIRST, id) AS ids FROM q WHERE query_key IS NOT NULL GROUP BY query_key")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    top = F.array_sort(F.collect_list(F.struct(F.coalesce("retrieval_rank", F.lit(-1)).alias("r"), "id")))
    return _q(spark, d).where("query_key IS NOT NULL").groupBy("query_key").agg(F.transform(top, lambda s: s["id"]).alias("ids"))


@query("st6_shared_refs", """
WITH k AS (SELECT id, any_value(keywords) AS k FROM openreview_papers GROUP BY id), c AS (SELECT DISTINCT paper_id, keywords_extracted::JSON::VARCHAR[] AS e FROM candidate_queue)
SELECT paper_id, len(list_intersect(list_distinct(k), list_distinct(e))) AS shared, len(list_distinct(list_concat(k, e))) AS either FROM c JOIN k ON k.id = paper_id""")
def shared_refs(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "openreview_papers").select(F.col("id").alias("paper_id"), "keywords").dropDuplicates(["paper_id"])
    c = table(spark, d, "candidate_queue").select("paper_id", "keywords_extracted").distinct()
    c = c.select("paper_id", F.from_json("keywords_extracted", "array<string>").alias("e")).distinct()
    x = c.join(k, "paper_id")
    return x.select("paper_id", F.size(F.array_intersect("keywords", "e")).cast("long").alias("shared"), F.size(F.array_union("keywords", "e")).cast("long").alias("either"))


@query("stream_interval_rates", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_interval_rates(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; a closing event far ahead moves the watermark past the end."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    folder = shared_folder(spark)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    rates = queues.interval_rates(stream, ["event_type"], "value", every="1 day", late="1 day")
    run = lambda: rates.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    run()
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
                                                F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    end.write.mode("append").parquet(f"{folder}/in")
    run()
    out = spark.read.schema("event_type string, start timestamp, end timestamp, n long, mean double").parquet(f"{folder}/out")
    return out.where("event_type <> 'end'").select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 6).alias("mean"))


@query("sc13_positions", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name)::BIGINT AS position FROM nation")
def positions(spark: SparkSession, d: str) -> DataFrame:
    return readers.with_positions(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name"])
