"""Queries of text functions, rules and style statistics, on documents and exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import keys
from folioforge.functions import text as tx
from folioforge.operators import chunking, dedupe, style
from folioforge.plans.registry import query
from folioforge.sources import table

WS = f"[{tx.WHITE}]+"
_TOK = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: len(t) > 2))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", "paper_id", "doc_kind")


@query("pf1_aspect_view", """
WITH v AS (SELECT source_view, count(*) AS n FROM candidate_queue GROUP BY source_view
           UNION ALL SELECT * FROM (VALUES (' Experiment_Result ', 1::BIGINT), ('experiment', 1), ('result', 1), (NULL, 1), ('method' || chr(10), 1), (chr(160) || 'motivation', 1)))
SELECT source_view, n, CASE WHEN replace(lower(strip(source_view)), '_', '/') = 'experiment' THEN 'experiment/result'
  WHEN replace(lower(strip(source_view)), '_', '/') IN ('motivation', 'method', 'experiment/result') THEN replace(lower(strip(source_view)), '_', '/') END AS aspect,
  CASE WHEN replace(lower(strip(source_view)), '_', '/') = 'experiment' THEN 'experiment/result' ELSE replace(lower(strip(source_view)), '_', '/') END AS loose
FROM v""")
def aspect_view(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").groupBy("source_view").agg(F.count("*").alias("n"))
    extra = spark.createDataFrame([(" Experiment_Result ", 1), ("experiment", 1), ("result", 1), (None, 1), ("method\n", 1), ("\u00a0motivation", 1)], "source_view string, n long")
    return x.unionByName(extra).select("source_view", "n", tx.aspect_view(F.col("source_view")).alias("aspect"), tx.aspect_view(F.col("source_view"), reject=False).alias("loose"))


@query("pf4_canonical_id", """
SELECT id, regexp_replace(regexp_replace(strip(id || sfx), '\\.restored$', ''), '\\.docling$', '') AS canonical
FROM (SELECT DISTINCT id FROM openreview_papers), (VALUES ('.docling'), ('.docling.restored'), ('.restored.docling'), (' ')) t(sfx)""")
def canonical_id(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "openreview_papers").select("id").distinct()
    x = ids.withColumn("raw", F.explode(F.transform(F.array(*[F.lit(s) for s in (".docling", ".docling.restored", ".restored.docling", " ")]), lambda s: F.concat("id", s))))
    return x.select("id", tx.canonical_id(F.col("raw")).alias("canonical"))


@query("pf6_pattern_density", f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
c AS (SELECT doc_id, len(list_filter(string_split_regex(t, '{WS}'), lambda w: w <> '')) AS words,
  (len(t) - len(replace(t, 'et al', ''))) / 5 + (len(t) - len(replace(t, 'arxiv', ''))) / 5 + (len(t) - len(replace(t, 'proceedings', ''))) / 11 AS hits FROM t)
SELECT doc_id, round(CASE WHEN words > 0 THEN hits / words ELSE 0.0 END, 9) AS density FROM c""")
def pattern_density(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(tx.pattern_density(F.col("text"), ("et al", "arxiv", "proceedings")), 9).alias("density"))


@query("pf17_char_limit", """
SELECT doc_id, len(substr(text, 1, lim))::INTEGER AS kept, doc_kind FROM documents JOIN (VALUES ('abstract', 300), ('review', 512), ('section', 1024)) p(kind, lim) ON doc_kind = kind""")
def char_limit(spark: SparkSession, d: str) -> DataFrame:
    policy = spark.createDataFrame([("abstract", 300), ("review", 512), ("section", 1024)], "doc_kind string, lim int")
    return _docs(spark, d).join(F.broadcast(policy), "doc_kind").select("doc_id", F.length(F.substring("text", F.lit(1), F.col("lim"))).alias("kept"), "doc_kind")


@query("pf22_flags", "SELECT is_multimodal, count(*) AS n, coalesce(lower(strip(is_multimodal)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS flag FROM candidate_queue GROUP BY is_multimodal")
def flags(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").groupBy("is_multimodal").agg(F.count("*").alias("n"))
    return x.withColumn("flag", tx.truthy(F.col("is_multimodal")))


@query("s1_slugs", """
SELECT DISTINCT paper_title AS title, coalesce(nullif(regexp_replace(regexp_replace(lower(paper_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug
FROM hard_negative_papers""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hard_negative_papers").select(F.col("paper_title").alias("title")).distinct().withColumn("slug", tx.slug(F.col("title")))


@query("s2_dataset_slugs", r"SELECT DISTINCT source AS name, regexp_replace(source, '[^\p{L}\p{N}_-]', '_', 'g') AS slug FROM documents")
def dataset_slugs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("source").alias("name")).distinct().withColumn("slug", tx.dataset_slug(F.col("name")))


@query("s3_spaces", f"SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS t FROM documents")
def spaces(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.collapse_spaces(F.col("text")).alias("t"))


@query("s4_nul_removed", "SELECT paper_id, row_no, len(replace(text, chr(0), '')) AS n FROM (SELECT DISTINCT * FROM paper_records)")
def nul_removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_records").distinct().select("paper_id", "row_no", F.length(tx.remove_nul(F.col("text"))).cast("long").alias("n"))


WINDOW_SQL = f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '') AS tokens FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, tokens, len(tokens) AS n FROM t WHERE len(tokens) > 0),
w AS (SELECT doc_id, tokens, n, unnest(range(0, greatest(0, ceil((n - 64) / 48)::BIGINT) + 1)) AS i FROM n)
SELECT doc_id, i::INTEGER AS chunk_index, least(i * 48 + 64, n)::INTEGER - (i * 48)::INTEGER AS token_count,
  CASE WHEN i = 0 THEN 0 ELSE 16 END AS overlap_tokens, array_to_string(tokens[i * 48 + 1:least(i * 48 + 64, n)], ' ') AS chunk_text
FROM w"""


@query("s5_token_windows", WINDOW_SQL)
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    x = chunking.token_windows(_docs(spark, d).where("text IS NOT NULL"), tx.word_list(F.col("text")), 64, 16)
    return x.select("doc_id", "chunk_index", "token_count", "overlap_tokens", F.array_join("chunk_tokens", " ").alias("chunk_text"))


@query("g1_chunk_ids", WINDOW_SQL.replace("SELECT doc_id, i::INTEGER AS chunk_index", "SELECT 'text::' || doc_id || '::chunk::' || lpad(i::VARCHAR, 4, '0') AS chunk_id, i::INTEGER AS chunk_index"))
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    x = token_windows(spark, d)
    return x.withColumn("chunk_id", chunking.chunk_id(F.lit("text"), F.col("doc_id").cast("string"), F.col("chunk_index"))).drop("doc_id")


EVIDENCE_SQL = r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{ref}', 1)) AS kind, unnest(regexp_extract_all(text, '{ref}', 2)) AS label,
             generate_subscripts(regexp_extract_all(text, '{ref}', 1), 1) AS i FROM documents),
p AS (SELECT doc_id, i, CASE WHEN lower(kind) LIKE 'fig%' THEN 'Figure' WHEN lower(kind) LIKE 'tab%' THEN 'Table' WHEN lower(kind) LIKE 'eq%' THEN 'Equation' ELSE 'Algorithm' END AS kind,
             string_split_regex(label, '(?i)\s*(,|and)\s*') AS parts FROM m),
u AS (SELECT doc_id, i, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM p),
r AS (SELECT doc_id, kind || ' ' || regexp_replace(part, '\s+', '', 'g') AS ref, min(i * 1000 + j) AS place FROM u WHERE regexp_replace(part, '\s+', '', 'g') <> '' GROUP BY ALL)
SELECT doc_id, list(ref ORDER BY place) AS refs FROM r GROUP BY doc_id
""".replace("{ref}", tx.EVIDENCE_REF)


@query("s7_evidence_refs", EVIDENCE_SQL)
def evidence_refs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.evidence_refs(F.col("text")).alias("refs")).where("size(refs) > 0")


@query("ag19_evidence_groups", EVIDENCE_SQL.rstrip().removesuffix("SELECT doc_id, list(ref ORDER BY place) AS refs FROM r GROUP BY doc_id") +
       "SELECT ref, count(*) AS n, min(doc_id) AS first_doc FROM r GROUP BY ref")
def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    x = evidence_refs(spark, d).select("doc_id", F.explode("refs").alias("ref"))
    return x.groupBy("ref").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("s8_discussion", r"SELECT doc_id, coalesce(regexp_matches(lower(text), '\b(" + "|".join(tx.DISCUSSION_TERMS) + r")\b'), false) AS discusses FROM documents")
def discussion(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.discusses_evidence(F.col("text")).alias("discusses"))


@query("pf7_evidence_rule", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, regexp_matches(line, '{ref}') AND regexp_matches(lower(line), '\b({terms})\b') AS ok FROM l)
SELECT doc_id, count(*) FILTER (WHERE ok) AS snippets, count(*) FILTER (WHERE ok) >= 2 AS passed FROM s GROUP BY doc_id
""".replace("{ref}", tx.EVIDENCE_REF).replace("{terms}", "|".join(tx.DISCUSSION_TERMS)))
def evidence_rule(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    ok = F.col("line").rlike(tx.EVIDENCE_REF) & tx.discusses_evidence(F.col("line"))
    x = lines.groupBy("doc_id").agg(F.count(F.when(ok, 1)).alias("snippets"))
    return x.withColumn("passed", F.col("snippets") >= 2)


@query("s10_cleaned_queries", r"""
SELECT example_id, any_value(strip(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip(replace(query_text, '(multimodal)', '')),
  '(?i)\b(?:fig(?:ure)?|table|eq(?:uation)?|alg(?:orithm)?)\.?\s*\(?\s*[A-Za-z]?\d+(?:\.\d+)?\s*\)?', '', 'g'), '(?i)\bappendix\b\s*[A-Za-z0-9. -]*', '', 'g'),
  '[{white}]+', ' ', 'g'), ' +([?.!,])', '\1', 'g'))) AS cleaned FROM golden_query_embeddings GROUP BY example_id""".replace("{white}", tx.WHITE))
def cleaned_queries(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings").select("example_id", "query_text").dropDuplicates(["example_id"])
    return x.select("example_id", tx.cleaned_query(F.col("query_text")).alias("cleaned"))


@query("s12_lengths", f"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '{WS}'), lambda w: w <> ''))::INTEGER AS words, len(text)::INTEGER AS chars FROM documents")
def lengths(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))




@query("s13_token_jaccard", f"""
WITH q AS (SELECT id, {_TOK.format(c='any_value(paper_title)')} AS a, {_TOK.format(c='any_value(candidate_title)')} AS b FROM candidate_queue GROUP BY id)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard FROM q""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").dropDuplicates(["id"])
    return x.select("id", F.round(tx.token_jaccard(F.col("paper_title"), F.col("candidate_title")), 9).alias("jaccard"))


_BULLET_REF = "regexp_extract_all(b, '(?i)\\b(?:figure|table) \\d+')"


@query("s14_near_duplicate_bullets", f"""
WITH RECURSIVE l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE doc_kind = 'bullets'),
t AS (SELECT doc_id, source, b, place, {_TOK.format(c='b')} AS t, list_sort(list_distinct(list_transform({_BULLET_REF}, lambda r: lower(r)))) AS r FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM t WHERE len(t) > 0),
near AS (SELECT y.doc_id, y.i, list(x.i) FILTER (WHERE CASE WHEN len(y.r) > 0 THEN x.r = y.r AND x.source IS NOT NULL
    ELSE len(list_intersect(x.t, y.t)) > 0 AND len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.82 END) AS like_me
  FROM n y JOIN n x ON x.doc_id = y.doc_id AND x.i < y.i GROUP BY ALL),
fold AS (
  SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS kept, NULL::BIGINT AS dup FROM (SELECT DISTINCT doc_id FROM n)
  UNION ALL
  SELECT f.doc_id, f.i + 1, CASE WHEN len(list_intersect(coalesce(p.like_me, []), f.kept)) > 0 THEN f.kept ELSE list_append(f.kept, f.i + 1) END,
    list_min(list_intersect(coalesce(p.like_me, []), f.kept))
  FROM fold f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1 LEFT JOIN near p ON p.doc_id = n.doc_id AND p.i = n.i)
SELECT a.doc_id, a.place::INTEGER AS place, o.place::INTEGER AS duplicate_of FROM fold f JOIN n a ON a.doc_id = f.doc_id AND a.i = f.i LEFT JOIN n o ON o.doc_id = f.doc_id AND o.i = f.dup""")
def near_duplicate_bullets(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("doc_kind = 'bullets'")
    bullets = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("place", "bullet"))
    tokens = F.array_distinct(F.filter(tx.alnum_tokens(F.col("bullet")), lambda t: F.length(t) > 2))
    refs = F.transform(F.regexp_extract_all("bullet", F.lit(r"(?i)\b(?:figure|table) \d+"), 0), lambda r: F.lower(r))
    x = bullets.select("doc_id", "place", tokens.alias("tokens"), refs.alias("refs"), F.array_compact(F.array("source")).alias("sources")).where("size(tokens) > 0")
    return dedupe.near_duplicates_of_earlier(x, ["doc_id"], "place", "tokens", 0.82, "refs", "sources")


@query("s15_extracted_ids", r"""
SELECT hn_id, any_value(nullif(regexp_extract(source_query, '\b((?:19|20)\d{2})\b', 1), ''))::INTEGER AS year_in_query,
  any_value(coalesce(nullif(regexp_extract(arxiv_id, '(\d{4}\.\d{4,5})', 1), ''), nullif(regexp_extract(arxiv_id, '([a-z-]+/\d{7})', 1), ''))) AS arxiv,
  any_value(nullif(regexp_extract(url, '(10\.\d{4,9}/[^\s"<>]+)', 1), '')) AS doi
FROM hard_negative_papers GROUP BY hn_id""")
def extracted_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hard_negative_papers").dropDuplicates(["hn_id"])
    return x.select("hn_id", tx.year_in(F.col("source_query")).alias("year_in_query"), tx.arxiv_id_in(F.col("arxiv_id")).alias("arxiv"), tx.doi_in(F.col("url")).alias("doi"))


@query("s16_pdf_urls", r"SELECT DISTINCT 'https://arxiv.org/pdf/' || regexp_extract(arxiv_id, '(\d{4}\.\d{4,5})', 1) || '.pdf' AS pdf FROM hard_negative_papers WHERE regexp_matches(arxiv_id, '\d{4}\.\d{4,5}')")
def pdf_urls(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hard_negative_papers").where(F.col("arxiv_id").rlike(r"\d{4}\.\d{4,5}"))
    return x.select(tx.pdf_url(tx.arxiv_id_in(F.col("arxiv_id"))).alias("pdf")).distinct()


@query("s17_tags_stripped", f"""
SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '{WS}', ' ', 'g')) AS plain FROM documents""")
def tags_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.strip_tags(F.col("text")).alias("plain"))


@query("s21_label_lists", """
SELECT id, list_transform(keywords_extracted::JSON::VARCHAR[], lambda k: strip(k)) AS labels FROM (SELECT id, any_value(keywords_extracted) AS keywords_extracted FROM candidate_queue GROUP BY id)
""")
def label_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").dropDuplicates(["id"])
    return x.select("id", tx.delimited_list(F.col("keywords_extracted")).alias("labels"))


_PLAN_SQL = """
WITH q AS (SELECT id, list_transform(any_value(keywords_extracted)::JSON::VARCHAR[], lambda k: strip(k)) AS k FROM candidate_queue GROUP BY id),
s AS (SELECT id, k, list_filter(list_transform(k, lambda x: array_to_string(list_filter(string_split_regex(x, '{ws}'), lambda w: w <> '')[1:4], ' ')), lambda x: x <> '') AS short FROM q),
p AS (SELECT id, list_concat(CASE WHEN len(short) > 1 THEN [array_to_string(short[1:2], ' ')] ELSE [] END, short){more} AS p FROM s)
SELECT id, list_filter(p, lambda x, i: list_position(p, x) = i) AS plan FROM p"""


@query("s23_search_plan", _PLAN_SQL.replace("{ws}", WS).replace("{more}", ""))
def search_plan(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").dropDuplicates(["id"])
    return x.select("id", tx.search_plan(tx.delimited_list(F.col("keywords_extracted"))).alias("plan"))


@query("s24_rendered_prompts", "SELECT DISTINCT query_id, 'View ' || coalesce(view_label, '') || ': ' || coalesce(query_text, '') AS prompt FROM golden_query_embeddings")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings")
    return x.select("query_id", tx.render("View {{view}}: {{query}}", {"view": F.col("view_label"), "query": F.col("query_text")}).alias("prompt")).distinct()


@query("s22_labeled_content", """
SELECT DISTINCT example_id, concat_ws(chr(10), CASE WHEN len(strip(query_text)) > 0 THEN 'Query: ' || strip(query_text) END,
  CASE WHEN len(strip(answer_tldr)) > 0 THEN 'TLDR: ' || strip(answer_tldr) END, CASE WHEN len(strip(human_view_note)) > 0 THEN 'Note: ' || strip(human_view_note) END) AS content
FROM golden_query_embeddings""")
def labeled_content(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "golden_query_embeddings")
    parts = [F.concat(F.lit(f"{n}: "), tx.blank_to_null(F.col(c))) for n, c in (("Query", "query_text"), ("TLDR", "answer_tldr"), ("Note", "human_view_note"))]
    return x.select("example_id", F.concat_ws("\n", *parts).alias("content")).distinct()


@query("x3_json_payloads", r"""
WITH p AS (SELECT id, strip(regexp_replace(any_value(review_payload), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS t FROM candidate_queue GROUP BY id),
c AS (SELECT id, [t, regexp_extract(t, '(?s)(\{.*\})', 1), regexp_extract(t, '(?s)(\[.*\])', 1)] AS tries FROM p)
SELECT id, list_filter(tries, lambda x: json_valid(x) AND x <> '')[1] AS json FROM c""")
def json_payloads(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").dropDuplicates(["id"])
    return x.select("id", tx.json_in(F.concat(F.lit("```json\n"), "review_payload", F.lit("\n```"))).alias("json"))


@query("x1_unwrapped_labels", "SELECT id, any_value(coalesce(CASE WHEN json_valid(review_payload) THEN json_extract_string(review_payload, '$.label') END, review_payload)) AS label FROM candidate_queue GROUP BY id")
def unwrapped_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").dropDuplicates(["id"])
    return x.select("id", F.coalesce(F.get_json_object("review_payload", "$.label"), F.col("review_payload")).alias("label"))


@query("x13_query_keys", """
SELECT DISTINCT sha1(concat(coalesce(paper_id, ''), chr(10), coalesce(query_text, ''), chr(10), coalesce(source_view, ''), chr(10), coalesce(query_type, ''))) AS query_key,
  sha1(concat(sha1(concat(coalesce(paper_id, ''), chr(10), coalesce(query_text, ''), chr(10), coalesce(source_view, ''), chr(10), coalesce(query_type, ''))), chr(10),
    coalesce(candidate_title, ''), chr(10), coalesce(candidate_arxiv_id, ''), chr(10), coalesce(candidate_url, ''))) AS candidate_key
FROM candidate_queue""")
def query_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue")
    q = keys.query_key(F.col("paper_id"), F.col("query_text"), F.col("source_view"), F.col("query_type"))
    return x.select(q.alias("query_key"), keys.candidate_key(q, F.col("candidate_title"), F.col("candidate_arxiv_id"), F.col("candidate_url")).alias("candidate_key")).distinct()


@query("x13_listing_ids", """
SELECT DISTINCT hn_id, coalesce(nullif(replace(strip(arxiv_id), '/', '_'), ''), substr(sha1(coalesce(paper_title, '')), 1, 12)) AS paper_id FROM hard_negative_papers""")
def listing_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hard_negative_papers")
    return x.select("hn_id", keys.listing_paper_id(F.col("arxiv_id"), F.col("paper_title")).alias("paper_id")).distinct()


@query("x13_stable_field_ids", """
SELECT query_id, feedback_item_id, list_reduce(list_concat([0::BIGINT], list_transform(string_split(feedback_item_id, ''), lambda c, i: (i * ord(c))::BIGINT)), lambda a, b: (a + b) % 1000000007) AS field_id
FROM (SELECT DISTINCT query_id, feedback_item_id FROM human_feedback)""")
def stable_field_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "human_feedback").select("query_id", "feedback_item_id").distinct()
    return x.withColumn("field_id", keys.stable_field_id(F.col("feedback_item_id")))


@query("s11_templates", "SELECT DISTINCT query_text, CASE " + " ".join(
    f"WHEN regexp_matches(lower(strip(query_text)), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for p, n in style.QUESTION_TEMPLATES) + " END AS template FROM candidate_queue")
def templates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_queue").select("query_text").distinct().withColumn("template", style.question_template(F.col("query_text")))


@query("ag10_length_stats", f"""
WITH m AS (SELECT doc_kind, 'chars' AS measure, len(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL
           UNION ALL SELECT doc_kind, 'words', len(list_filter(string_split_regex(text, '{WS}'), lambda w: w <> ''))::DOUBLE FROM documents WHERE text IS NOT NULL)
SELECT doc_kind, measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM m GROUP BY ALL""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    x = style.length_stats(_docs(spark, d), ["doc_kind"], "text")
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "median", "p75")})


_TEMPLATES = "WITH q AS (SELECT query_text, min(id) AS pos FROM candidate_queue GROUP BY query_text), t AS (SELECT *, CASE " + " ".join(
    f"WHEN regexp_matches(lower(strip(query_text)), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for p, n in style.QUESTION_TEMPLATES) + " END AS template FROM q)"


@query("ag11_template_distribution", _TEMPLATES + " SELECT template, count(*) AS n, round(count(*) / (SELECT count(*) FROM q), 9) AS ratio, list(query_text ORDER BY pos)[1:3] AS examples FROM t GROUP BY template")
def template_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").groupBy("query_text").agg(F.min("id").alias("pos"))
    return style.template_distribution(x, "query_text", "pos").withColumn("ratio", F.round("ratio", 9))


@query("tk10_examples", _TEMPLATES + """
, p AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY pos) AS place, min(pos) OVER (PARTITION BY template) AS first_seen FROM t WHERE template IS NOT NULL)
SELECT template, pos, query_text FROM p WHERE place <= greatest(1, 12 // (SELECT count(DISTINCT template) FROM p)) ORDER BY first_seen, pos LIMIT 12""")
def examples(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "candidate_queue").groupBy("query_text").agg(F.min("id").alias("pos"))
    return style.representative_examples(x, "query_text", "pos", 12)


@query("ag15_histogram", f"""
WITH w AS (SELECT lang, len(list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '')) AS bin FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
b AS (SELECT unnest(range((SELECT min(bin) FROM w), (SELECT max(bin) FROM w) + 1)) AS bin), g AS (SELECT DISTINCT lang FROM w)
SELECT lang, bin::BIGINT AS bin, (SELECT count(*) FROM w WHERE w.lang = g.lang AND w.bin = b.bin) AS n FROM g, b""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return style.histogram(_docs(spark, d).where("text IS NOT NULL AND lang IS NOT NULL"), "lang", tx.word_count(F.col("text")))


@query("ag17_wasserstein", """
WITH v AS (SELECT doc_kind AS side, len(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL AND doc_kind IN ('review', 'abstract')),
n AS (SELECT v, count(*) FILTER (WHERE side = 'review') AS na, count(*) FILTER (WHERE side = 'abstract') AS nb FROM v GROUP BY v),
c AS (SELECT v, sum(na) OVER (ORDER BY v) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS fb, lead(v) OVER (ORDER BY v) AS nxt FROM n)
SELECT round(sum(abs(fa - fb) * (nxt - v)), 6) AS distance FROM c""")
def wasserstein(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).select("doc_kind", F.length("text").cast("double").alias("v"))
    return style.wasserstein(x, "doc_kind", "review", "abstract", "v").withColumn("distance", F.round("distance", 6))


@query("ag18_centroids", """
WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY label),
s AS (SELECT label, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS spread FROM p JOIN c USING (label) GROUP BY label)
SELECT a.label AS left_label, b.label AS right_label, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) AS distance,
  round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) / ((sa.spread + sb.spread) / 2), 6) AS separation
FROM c a JOIN c b ON a.label < b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return style.centroid_separation(e, "label", "x", "y").withColumns({c: F.round(c, 6) for c in ("distance", "separation")})
