"""Queries of record shaping, reports, claims and chained joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import exemplars, queue, ranking, records, reports, style
from folioforge.plans.registry import query
from folioforge.plans.retrieval import RANK_SQL
from folioforge.plans.textual import _PLAN_SQL, EVIDENCE_SQL, WS
from folioforge.sources import table

Q = "WITH q AS (SELECT DISTINCT ON (id) * FROM candidate_queue)"
AS_OF = "2025-01-01 00:00:00"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_queue").dropDuplicates(["id"])


# --- records -----------------------------------------------------------------------------------


@query("w6_nonempty_index", """
WITH s AS (SELECT doc_id, text, unnest(range(0, len(text), 64)) AS a FROM documents WHERE len(text) > 0),
w AS (SELECT doc_id, a, strip(substr(text, a + 1, 64)) AS piece FROM s)
SELECT doc_id, piece, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INTEGER AS piece_index FROM w WHERE piece <> ''""")
def nonempty_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(records.numbered_windows(F.col("text"), 64)).alias("piece_index", "piece"))


@query("w7_distinct_keywords", _PLAN_SQL.replace("{ws}", WS).replace("{more}", " || k"))
def distinct_keywords(spark: SparkSession, d: str) -> DataFrame:
    keys = tx.delimited_list(F.col("keywords_extracted"))
    return _q(spark, d).select("id", F.array_distinct(F.concat(tx.search_plan(keys), keys)).alias("plan"))


@query("x5_aliased_fields", Q + """
SELECT id, coalesce(CASE WHEN json_valid(review_payload) THEN json_extract_string(review_payload, '$.label') END, CASE WHEN json_valid(review_payload) THEN json_extract_string(review_payload, '$.confidence') END, review_label) AS value FROM q""")
def aliased_fields(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("id", records.aliased(F.col("review_payload"), ["label", "confidence"], F.col("review_label")).alias("value"))


X7_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, strip(b) AS text, regexp_extract_all(b, '(?i)\b(?:figure|table) \d+') AS refs, lower(strip(CASE doc_id % 4 WHEN 0 THEN ' Necessary' WHEN 1 THEN 'vital' WHEN 2 THEN 'supportive' END)) AS level, nullif(strip(source), '') AS why FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS index FROM c WHERE text <> '')
SELECT doc_id, index, text, array_to_string(refs, '|') AS refs, CASE WHEN len(refs) > 0 AND level IN ('necessary', 'supportive') THEN level ELSE 'none' END AS dependency, CASE WHEN len(refs) > 0 THEN why END AS rationale FROM k"""


@query("x7_bullets", X7_SQL)
def bullets(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("doc_id") % 4 == 0, " Necessary").when(F.col("doc_id") % 4 == 1, "vital").when(F.col("doc_id") % 4 == 2, "supportive")

    def bullet(line):
        refs = F.concat(F.regexp_extract_all(line, F.lit(r"(?i)\b(?:figure|table) \d+"), F.lit(0)), F.array(F.lit(" ")))
        return F.struct(line.alias("text"), F.array("source").alias("source_refs"), refs.alias("refs"), level.alias("dependency"), F.col("source").alias("rationale"))

    x = table(spark, d, "documents").where("text IS NOT NULL")
    x = x.select("doc_id", F.inline(records.bullets(F.transform(F.split("text", "\n"), bullet))))
    return x.select("doc_id", "index", "text", F.array_join("refs", "|").alias("refs"), "dependency", "rationale")


def _compact(name: str) -> str:
    return f"""CASE WHEN strip({name}) <> '' THEN '"{name}":' || to_json({name}) END"""


@query("x8_compact_json", f"SELECT doc_id, '{{' || concat_ws(',', {', '.join(_compact(n) for n in ('lang', 'source', 'paper_id'))}) || '}}' AS json FROM documents")
def compact_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", exemplars.compact_json(["lang", "source", "paper_id"]).alias("json"))


@query("x9_json_merged", "SELECT DISTINCT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def json_merged(spark: SparkSession, d: str) -> DataFrame:
    merged = records.merged_maps(F.create_map(F.lit("status"), F.lit("?"), F.lit("priority"), F.col("o_orderpriority")), F.create_map(F.lit("status"), F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", merged.alias("m")).select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"))


@query("x11_selection_lists", "SELECT id, any_value(CASE WHEN len(selection_type) > 0 THEN selection_type END) AS selection FROM human_feedback GROUP BY id")
def selection_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "human_feedback").dropDuplicates(["id"]).select("id", records.selection(F.col("selection_type")).alias("selection"))


@query("x12_decoded_lists", """
SELECT example_id || ':' || form AS id, list_transform(target_papers::JSON::VARCHAR[], lambda p: strip(p)) AS papers
FROM (SELECT example_id, any_value(target_papers) AS target_papers FROM golden_query_embeddings GROUP BY example_id), (VALUES ('json'), ('comma'), ('bar')) f(form)""")
def decoded_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each list as it stands, and again divided by commas and by bars."""
    x = table(spark, d, "golden_query_embeddings").dropDuplicates(["example_id"])
    given = F.from_json("target_papers", "array<string>")
    forms = F.array(*[F.struct(F.lit(n).alias("form"), t.alias("t")) for n, t in (("json", F.col("target_papers")), ("comma", F.array_join(given, " , ")), ("bar", F.array_join(given, "|")))])
    return x.select("example_id", F.inline(forms)).select(F.concat_ws(":", "example_id", "form").alias("id"), tx.delimited_list(F.col("t")).alias("papers"))


@query("x15_keyword_lists", """
SELECT id, list_filter(list_transform(arg_min(keywords, downloaded_at), lambda k: strip(k)), lambda k: k <> '') AS keywords FROM openreview_papers GROUP BY id""")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "openreview_papers").groupBy("id").agg(F.min_by("keywords", "downloaded_at").alias("keywords"))
    return x.select("id", records.keywords(F.col("keywords")).alias("keywords"))


@query("x16_source_labels", """
SELECT DISTINCT example_id, n, CASE WHEN n = 'pasa' THEN 'pasa' WHEN n = 'LitSearch' THEN 'litsearch' ELSE 'golden' END AS label FROM golden_query_embeddings, (VALUES ('pasa'), ('LitSearch'), ('other')) v(n)""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings").select("example_id", F.explode(F.array(*[F.lit(n) for n in ("pasa", "LitSearch", "other")])).alias("n")).distinct()
    return x.withColumn("label", records.golden_source(F.col("n"), F.col("example_id")))


@query("g3_evidence_rows", EVIDENCE_SQL.rstrip().removesuffix("SELECT doc_id, list(ref ORDER BY place) AS refs FROM r GROUP BY doc_id") + "SELECT doc_id, ref FROM r")
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(tx.evidence_refs(F.col("text"))).alias("ref"))


@query("s20_quoted_titles", """
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[“"]([^”"]{8,220})[”"]', 1) || regexp_extract_all(text, '[‘'']([^’'']{8,220})[’'']', 1), lambda x: trim(regexp_replace(x, '{ws}', ' ', 'g'))) AS t
           FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter(t, lambda x: x <> '') AS t FROM t)
SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS titles FROM f WHERE len(t) > 0""".replace("{ws}", WS))
def quoted_titles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text IS NOT NULL")
    return x.select("doc_id", records.quoted_titles(F.col("text")).alias("titles")).where("size(titles) > 0")


# --- joins, rules and claims -------------------------------------------------------------------


@query("j4_chunk_papers", "SELECT chunk_id, any_value(title) AS title FROM chunk_records JOIN (SELECT id, min(title) AS title FROM openreview_papers GROUP BY id) p ON p.id = paper_id GROUP BY chunk_id")
def chunk_papers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "openreview_papers").groupBy(F.col("id").alias("paper_id")).agg(F.min("title").alias("title"))
    return records.with_parent(table(spark, d, "chunk_records").dropDuplicates(["chunk_id"]), p, "paper_id").select("chunk_id", "title")


@query("j5_unknown_members", "SELECT count(*) AS unknown FROM (SELECT DISTINCT paper_id FROM chunk_records) WHERE paper_id NOT IN (SELECT id FROM openreview_papers)")
def unknown_members(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "openreview_papers").select(F.col("id").alias("paper_id"))
    return records.unknown_parents(table(spark, d, "chunk_records"), p, "paper_id").agg(F.count("*").alias("unknown"))


@query("j5_strict_members", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def strict_members(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return records.with_parent(table(spark, d, "lineitem"), o, "l_orderkey", strict=True).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("j6_semi_join", Q + "SELECT id FROM q WHERE query_key IN (SELECT query_id FROM golden_query_embeddings)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_query_embeddings").select(F.col("query_id").alias("query_key"))
    return records.of_kept(_q(spark, d), g, "query_key").select("id")


@query("j8_left_chain", Q + """SELECT q.id, p.title, c.n FROM q LEFT JOIN (SELECT id, max(title) AS title FROM openreview_papers GROUP BY id) p ON p.id = q.paper_id
LEFT JOIN (SELECT paper_id, count(*) AS n FROM chunk_records GROUP BY paper_id) c ON c.paper_id = q.paper_id""")
def left_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "openreview_papers").select(F.col("id").alias("paper_id"), "title")
    c = table(spark, d, "chunk_records").groupBy("paper_id").agg(F.count("*").alias("n"))
    return records.with_details(_q(spark, d), {"p": p, "c": c}, "paper_id").select("id", F.col("p.title").alias("title"), F.col("c.n").alias("n"))


@query("j10_judged_rows", Q + """
SELECT a.id, a.related_bullet_indice AS constraints, b.retrieval_rank AS score FROM q a JOIN q b USING (id) WHERE a.query_type IS NOT NULL AND b.retrieval_rank BETWEEN 1 AND 5 AND a.related_bullet_indice IS NOT NULL""")
def judged_rows(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d)
    left = x.where("query_type IS NOT NULL").select("id", F.col("related_bullet_indice").alias("constraints"))
    return records.by_index(left, x.select("id", style.judged_score(F.col("retrieval_rank").cast("string")).alias("score")), ["id"])


@query("pf8_stage_one", r"""
SELECT doc_id, coalesce(lang = 'en', false) AND fine AS accepted, coalesce(source LIKE '%thesis%', false) AND fine AS similar, coalesce(len(text) >= 400, false) AND fine AS evidence,
  fine AND lang = 'en' AND NOT source LIKE '%thesis%' AND len(text) >= 400 AS passed
FROM (SELECT *, lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AS fine FROM documents)""")
def stage_one(spark: SparkSession, d: str) -> DataFrame:
    x = records.stage_one(table(spark, d, "documents"), F.col("lang") == "en", F.col("source").contains("thesis"), F.length("text"), 400)
    return x.select("doc_id", "accepted", "similar", "evidence", "passed")


@query("pf16_kept_queries", Q + """, k AS (SELECT id, paper_id, strip(query_text) AS query_text FROM q WHERE is_multimodal = 'true' AND strip(query_text) <> '')
SELECT id, query_text FROM k QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY id) <= 3""")
def kept_queries(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d).withColumn("is_multimodal", tx.truthy(F.col("is_multimodal")))
    return records.kept_queries(x, "paper_id", ["id"], 3, multimodal_only=True).select("id", "query_text")


@query("q3_claim_by_column", Q + " SELECT id FROM q WHERE parse_status = 'no_pdf' AND review_label = 'hard_negative' ORDER BY query_key NULLS FIRST, retrieval_rank NULLS FIRST, id LIMIT 50")
def claim_by_column(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim_where(_q(spark, d), "parse_status", "no_pdf", ["hard_negative"], 50).select("id")


@query("q5_claim_one_query", Q + " SELECT id FROM q WHERE review_status = 'pending' AND query_key = (SELECT min(query_key) FROM q WHERE review_status = 'pending' AND length(trim(query_key)) > 0)")
def claim_one_query(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim_query(_q(spark, d)).select("id")


@query("tk6_best_chunks", RANK_SQL.replace(" AND q.vec_id <> x.vec_id", "") + """, b AS (SELECT query_id, item_id, label, score FROM top JOIN embeddings ON vec_id = item_id WHERE rank <= 20)
SELECT query_id, label, item_id FROM b QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) <= 3""")
def best_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's twenty best chunks the three best of every label."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = ranking.dense_topk(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 20)
    hits = hits.join(e.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return ranking.best_per_group(hits, ["query_id", "label"], 3).select("query_id", "label", "item_id")


# --- reports -----------------------------------------------------------------------------------


@query("ag12_frequent_templates", "WITH t AS (SELECT CASE " + " ".join(
    f"WHEN regexp_matches(lower(strip(query_text)), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for p, n in style.QUESTION_TEMPLATES)
    + " END AS template FROM (SELECT DISTINCT query_text FROM candidate_queue)) SELECT template, count(*) AS n FROM t WHERE template IS NOT NULL GROUP BY template HAVING count(*) >= 4")
def frequent_templates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").select(style.question_template(F.col("query_text")).alias("template"), "query_text").distinct()
    return reports.frequent(x, "template")


@query("ag13_judge_summary", """
WITH q AS (SELECT DISTINCT ON (id) * FROM candidate_queue), s AS (SELECT query_type, related_bullet_indice AS i, CASE WHEN related_bullet_indice BETWEEN 1 AND 5 THEN related_bullet_indice END AS score FROM q),
m AS (SELECT query_type, 'score' AS measure, score::DOUBLE AS v FROM s UNION ALL SELECT query_type, 'fit', greatest(0.0, 1 - abs(score - 3) / 2)::DOUBLE FROM s WHERE score IS NOT NULL UNION ALL SELECT query_type, 'fit', NULL FROM s WHERE score IS NULL),
r AS (SELECT query_type, count(*) FILTER (WHERE i > 0) AS hits, round(count(*) FILTER (WHERE i > 0) / count(*), 9) AS ratio FROM s GROUP BY query_type)
SELECT query_type, measure, count(v) AS n, round(avg(v), 9) AS mean, min(v) AS least, max(v) AS most, hits, ratio FROM m JOIN r USING (query_type) GROUP BY ALL""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    score = style.judged_score(F.col("related_bullet_indice").cast("string"))
    x = _q(spark, d).where("query_type IS NOT NULL")
    m = reports.measures(x, ["query_type"], {"score": score, "fit": style.centred_fit(score)}).withColumn("mean", F.round("mean", 9))
    r = reports.shares(x, ["query_type"], F.col("related_bullet_indice") > 0).select("query_type", "hits", F.round("ratio", 9).alias("ratio"))
    return m.join(r, "query_type")


@query("ag14_dataset_summary", Q + """
SELECT 'decision' AS measure, coalesce(review_label, 'none') AS value, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'view', source_view, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'type', query_type, count(*) FROM q GROUP BY 2""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.value_counts(_q(spark, d), {"decision": F.coalesce("review_label", F.lit("none")), "view": F.col("source_view"), "type": F.col("query_type")})


@query("ag14_dataset_lengths", Q + f"""
, w AS (SELECT len(query_text)::DOUBLE AS c, len(list_filter(string_split_regex(query_text, '{WS}'), lambda w: w <> ''))::DOUBLE AS n FROM q)
SELECT 'chars' AS measure, count(c) AS n, round(avg(c), 6) AS mean, min(c) AS least, max(c) AS most FROM w UNION ALL SELECT 'words', count(n), round(avg(n), 6), min(n), max(n) FROM w""")
def dataset_lengths(spark: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("query_text").isNotNull(), tx.word_count(F.col("query_text")))
    return reports.measures(_q(spark, d), [], {"chars": F.length("query_text"), "words": words}).withColumn("mean", F.round("mean", 6))


@query("ag17_overall", Q + """
, j AS (SELECT is_multimodal = 'true' AS human, related_bullet_indice::DOUBLE AS c, CASE WHEN retrieval_rank BETWEEN 1 AND 5 THEN retrieval_rank::DOUBLE END AS s FROM q),
k AS (SELECT * FROM j WHERE c IS NOT NULL AND s IS NOT NULL AND human IS NOT NULL),
v AS (SELECT 'constraints' AS measure, c AS v, human FROM k UNION ALL SELECT 'score', s, human FROM k),
n AS (SELECT measure, v, count(*) FILTER (WHERE human) AS na, count(*) FILTER (WHERE NOT human) AS nb FROM v GROUP BY ALL),
f AS (SELECT measure, v, sum(na) OVER (PARTITION BY measure ORDER BY v) / sum(na) OVER (PARTITION BY measure) AS fa, sum(nb) OVER (PARTITION BY measure ORDER BY v) / sum(nb) OVER (PARTITION BY measure) AS fb,
  lead(v) OVER (PARTITION BY measure ORDER BY v) AS nxt FROM n),
w AS (SELECT measure, sum(abs(fa - fb) * (nxt - v)) AS distance FROM f GROUP BY measure),
h AS (SELECT measure, distance, CASE measure WHEN 'constraints' THEN exp(-distance / ((SELECT stddev_pop(c) FROM k WHERE human) + 1e-8)) ELSE least(greatest(1 - distance / 4, 0), 1) END AS closeness FROM w)
SELECT measure, round(distance, 6) AS distance, round(closeness, 6) AS closeness FROM h UNION ALL SELECT 'overall', NULL, round(avg(closeness), 6) FROM h""")
def overall_closeness(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d).select(F.col("is_multimodal").alias("side"), F.col("related_bullet_indice").alias("constraints"), style.judged_score(F.col("retrieval_rank").cast("string")).alias("score"))
    x = x.where("side IS NOT NULL").withColumn("side", F.when(F.col("side") == "true", "human").otherwise("other"))
    found = reports.human_closeness(x, "side", "human", "other", "constraints", ["score"])
    return found.withColumns({c: F.round(c, 6) for c in ("distance", "closeness")})


_CANON = """c AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query_key, retrieval_rank ORDER BY
  CASE review_status WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END,
  CASE parse_status WHEN 'parsed' THEN 0 WHEN 'metadata_only' THEN 1 WHEN 'no_pdf' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END, review_payload IS NULL, updated_at DESC NULLS LAST, id DESC) = 1)"""


@query("ag20_snapshot", Q + ", " + _CANON + " " + " UNION ALL ".join(
    f"SELECT '{kind} {c}' AS measure, {c} AS value, count(*) AS n FROM {t} GROUP BY {c}" for kind, t in (("raw", "q"), ("canonical", "c")) for c in ("review_status", "review_label", "parse_status"))
    + f" UNION ALL SELECT 'queries', NULL, count(DISTINCT query_key) FROM q UNION ALL SELECT 'stale', NULL, count(*) FILTER (WHERE review_status = 'processing' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 600 SECOND) FROM q")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    x = _q(spark, d)
    return reports.queue_snapshot(x, queue.canonical_rows(x), F.lit(AS_OF).cast("timestamp"), 600)


@query("ag22_review_counts", "SELECT query_id, feedback_item_id, count(DISTINCT id) AS n, count(DISTINCT reviewer_username) AS people FROM human_feedback GROUP BY ALL")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts_per(table(spark, d, "human_feedback").dropDuplicates(["id"]), ["query_id", "feedback_item_id"], "reviewer_username")


@query("ag23_mining_totals", Q + """, t AS (SELECT query_key, count(*) FILTER (WHERE review_label = 'hard_negative') AS h, count(*) FILTER (WHERE review_label = 'positive') AS p FROM q GROUP BY query_key)
SELECT count(*) AS queries, count(*) FILTER (WHERE h > 0) AS with_hard, sum(h)::BIGINT AS hard_negatives, sum(p)::BIGINT AS positives FROM t""")
def mining_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.mining_totals(_q(spark, d), "query_key", "review_label", "hard_negative", "positive")


@query("ag24_exemplar_report", """
WITH e AS (SELECT DISTINCT ON (example_id) * FROM golden_query_embeddings)
SELECT 'kind' AS measure, query_type || ':' || view_label AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'decision', CASE WHEN specific = 1 THEN 'specific' ELSE 'general' END, count(*) FROM e GROUP BY 2""")
def exemplar_report(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings").dropDuplicates(["example_id"])
    return reports.value_counts(x, {"kind": F.concat("query_type", F.lit(":"), "view_label"), "decision": F.when(F.col("specific") == 1, "specific").otherwise("general")})


@query("ag27_rates_between", """
WITH n AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT day, sum(n) OVER (ORDER BY day)::BIGINT AS done, (SELECT count(*) FROM events) AS whole FROM n),
r AS (SELECT day, done, whole - done AS left_over, (done - lag(done) OVER (ORDER BY day)) / (epoch(day) - lag(epoch(day)) OVER (ORDER BY day)) AS rate, done - min(done) OVER (ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS growth FROM s)
SELECT day, done, round(rate, 9) AS rate, round(CASE WHEN rate > 0 THEN left_over / rate END, 3) AS eta, growth FROM r""")
def rates_between(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    n = e.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("day")).agg(F.count("*").alias("n"))
    run, everything = Window.orderBy("day"), Window.partitionBy()  # one row a day
    s = n.select("day", F.sum("n").over(run).alias("done"), (F.sum("n").over(everything) - F.sum("n").over(run)).alias("rest"))
    x = reports.rates(s, "day", "done", "rest")
    return x.select(F.col("day").cast("timestamp_ntz").alias("day"), "done", F.round("rate", 9).alias("rate"), F.round("eta", 3).alias("eta"), "growth")


@query("ag28_search_summary", Q + " SELECT count(*) AS attempts, count(*) FILTER (WHERE error_message IS NOT NULL) AS failures, round((count(*) - count(*) FILTER (WHERE error_message IS NOT NULL)) / count(*) * 100, 6) AS success FROM q")
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.search_summary(_q(spark, d), F.col("error_message").isNotNull()).withColumn("success", F.round("success", 6))


@query("ag28_failed_searches", Q + """
SELECT search_query, count(*) AS n FROM q WHERE error_message IS NOT NULL GROUP BY search_query ORDER BY n DESC, search_query NULLS LAST LIMIT 10""")
def failed_searches(spark: SparkSession, d: str) -> DataFrame:
    return reports.most_failed(_q(spark, d), "search_query", F.col("error_message").isNotNull())


@query("m7_counts_parsed", "SELECT DISTINCT retrieval_rank AS r, greatest(coalesce(retrieval_rank, 0), 0) AS n FROM candidate_queue UNION SELECT -3, 0")
def counts_parsed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").select(F.col("retrieval_rank").alias("r")).distinct().unionByName(spark.createDataFrame([(-3,)], "r int"))
    return x.withColumn("n", style.count_of(F.col("r").cast("string")))
