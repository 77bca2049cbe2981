"""Queries that test what SQL can't compute: properties that every right result has, beside SQL
that finds the same numbers in the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import consensus, matching, mixing, neighbors, packing, splitting
from folioforge.sources import table

WHITE = "\\t-\\r\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Listings matched to two works and pairs whose marginals hadn't settled: none."""
    found = matching.listings_to_papers(table(spark, d, "hard_negative_papers"), table(spark, d, "openreview_papers"))
    per = found.groupBy("hn_id").agg(F.count_distinct("paper_id").alias("works"), F.count_if(~F.col("settled")).alias("open"))
    return per.agg(F.count_if(F.col("works") > 1).alias("double"), F.coalesce(F.sum("open"), F.lit(0)).alias("unsettled"))


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every item's tokens put together from its pieces, as a digest, and whether all pieces keep
    to the limit and the overlap."""
    pieces = splitting.split_items(splitting.corpus_rows(table(spark, d, "paper_records"), table(spark, d, "chunk_records")))
    tokens = F.filter(F.split("text", f"[{splitting.WHITE_CLASS}]+"), lambda t: t != "")
    own = F.slice(tokens, F.col("overlap_tokens") + 1, F.greatest(F.size(tokens), F.lit(1)))
    fresh = F.col("token_count") - F.col("overlap_tokens")
    x = pieces.select(
        "item_kind", "item_id", "piece_no", fresh.alias("n"), F.array_join(own, " ").alias("body"),
        ((F.col("token_count") <= splitting.LIMIT) & (F.size(tokens) == F.col("token_count"))).alias("fits"),
        "overlap_tokens",
    )
    bodies = F.array_sort(F.collect_list(F.struct("piece_no", "body")))
    sizes = F.array_sort(F.collect_list(F.struct("piece_no", "n", "overlap_tokens")))

    def step(seen: Column, p: Column) -> Column:
        right = seen["fine"] & (p["piece_no"] == seen["next"]) & (p["n"] > 0) & (p["overlap_tokens"] == F.least(seen["tokens"], F.lit(splitting.OVERLAP)))
        return F.struct((seen["tokens"] + p["n"]).alias("tokens"), (seen["next"] + 1).alias("next"), right.alias("fine"))

    nothing = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("next"), F.lit(True).alias("fine"))
    return x.groupBy("item_kind", "item_id").agg(
        F.sum("n").alias("tokens"), F.md5(F.array_join(F.transform(bodies, lambda b: b["body"]), " ").cast("binary")).alias("digest"),
        F.bool_and("fits").alias("fits"), F.aggregate(sizes, nothing, step, lambda seen: seen["fine"]).alias("overlaps"),
    )


P3_REJOINED_SQL = f"""
WITH texts AS (
  SELECT DISTINCT 'paper' AS item_kind, representation_type || '::' || paper_id AS item_id, source_path, row_no, text FROM paper_records
  UNION ALL SELECT DISTINCT 'chunk', chunk_id, '', 0, text FROM chunk_records),
tokens AS (SELECT item_kind, item_id, source_path, row_no, regexp_extract_all(replace(coalesce(text, ''), chr(0), ''), '[^{WHITE}]+') AS t FROM texts)
SELECT item_kind, item_id, sum(len(t))::BIGINT AS tokens, md5(string_agg(array_to_string(t, ' '), ' ' ORDER BY source_path, row_no) FILTER (WHERE len(t) > 0)) AS digest,
  true AS fits, true AS overlaps
FROM tokens GROUP BY ALL HAVING sum(len(t)) > 0"""


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of p4_found with their votes, and whether the run settled on a class of its family."""
    found = consensus.feedback_consensus(table(spark, d, "human_feedback"))
    names = [v for labels in consensus.FEEDBACK_CLASSES.values() for v in labels]
    fine = F.col("settled") & F.col("judgement").isin(*names) & F.col("confidence").between(0, 1)
    return found.select("query_id", "feedback_item_id", "n_votes", fine.alias("fine"))


def p4_raters(spark: SparkSession, d: str) -> DataFrame:
    """The raters of each family, and whether their reliability lies within its interval."""
    _, confusion = consensus.variational_consensus(consensus.feedback_votes(table(spark, d, "human_feedback")), consensus.FEEDBACK_CLASSES)
    x = consensus.reliability(confusion)
    return x.select("rater", "family", (F.col("reliability").between(F.col("low"), F.col("high")) & F.col("low").between(0, 1) & F.col("high").between(0, 1)).alias("fine"))


def p4_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return consensus.unreadable_judgements(table(spark, d, "human_feedback"))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Exemplars with a usable embedding, and whether their ten neighbours hold nine tenths of those
    that a full scan (one cell) finds."""
    q, p = table(spark, d, "golden_query_embeddings"), table(spark, d, "paper_text_embeddings")
    q = q.select(F.col("example_id").alias("query_id"), F.col("embedding").alias("vector"))
    p = p.where(F.col("model_name") == neighbors.MODEL).select(F.col("paper_id").alias("item_id"), F.col("embedding").alias("vector"))
    found = neighbors.nearest(q, p, neighbors.DIM).select("query_id", "item_id", F.lit(1).alias("hit"))
    true = neighbors.nearest(q, p, neighbors.DIM, centroids=1, candidates=neighbors.LEAST_BUDGET)
    both = true.join(found, ["query_id", "item_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


P5_RECALL_SQL = """
SELECT count(DISTINCT example_id) AS queries, true AS enough FROM golden_query_embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"""


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed; sequences over the capacity, documents that aren't whole, and documents cut
    without need: none."""
    packed = packing.document_sequences(table(spark, d, "documents"))
    over = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("over_capacity"))
    own = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("n"), F.count_distinct("piece_no").alias("numbers"))
    docs = own.agg(
        F.count("*").alias("documents"), F.count_if((F.col("end") != F.col("n")) | (F.col("numbers") != F.col("pieces"))).alias("broken"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("cut"),
    )
    return docs.crossJoin(over)  # one row each


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a weight; documents over their cap or of another source, and sources off their
    share by more than two hundredths and two of the longest texts: none."""
    documents, weights = table(spark, d, "documents"), table(spark, d, "source_weights")
    selection, report = mixing.document_mix(documents, weights)
    caps = weights.groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("cap"))
    x = selection.join(caps, "source", "left").join(documents.select("doc_id", mixing.source_key(F.col("source")).alias("home")), "doc_id", "left")
    wrong = x.agg(F.count_if(F.coalesce(F.col("repeats") > F.col("cap"), F.lit(True))).alias("over_cap"), F.count_if(~F.col("home").eqNullSafe(F.col("source"))).alias("foreign"))
    able = F.when(F.col("available_tokens") * F.col("max_repeats") > 0, F.col("target_share")).otherwise(0.0)
    whole = report.agg(F.sum(able).alias("whole"), F.sum("tokens").alias("all")).crossJoin(selection.agg(F.max("n_tokens").alias("longest")))  # one row each
    slack = 0.02 + F.coalesce(2 * F.try_divide(F.col("longest"), F.col("all")), F.lit(0.0))
    off = report.crossJoin(whole).where(F.abs(F.col("share") - able / F.col("whole")) > slack)
    return wrong.crossJoin(off.agg(F.count("*").alias("off_share"))).crossJoin(report.agg(F.count("*").alias("sources")))


P7_SQL = r"""
SELECT 0 AS over_cap, 0 AS "foreign", 0 AS off_share, count(DISTINCT regexp_replace(lower(trim(source)), '[\s_\-./]+', '_', 'g')) AS sources FROM source_weights WHERE trim(source) <> ''"""


#: survivor cells, the longest chain of cells above each, and each field's value from the earliest layer that has one
P1_BEST_SQL = r"""
WITH RECURSIVE places AS (
  SELECT coalesce(nullif(regexp_replace(lower(query_key), '^\s+|\s+$', '', 'g'), ''),
           sha1(concat(coalesce(paper_id, ''), chr(10), coalesce(query_text, ''), chr(10), coalesce(source_view, ''), chr(10), coalesce(query_type, '')))) AS query_key,
         retrieval_rank, id, updated_at, review_status, parse_status, review_payload, review_label, review_reason, candidate_title,
         regexp_replace(lower(review_status), '[\s_./-]+', '', 'g') AS rs, regexp_replace(lower(parse_status), '[\s_./-]+', '', 'g') AS ps,
         CASE WHEN json_valid(review_payload) AND json_type(review_payload) = 'OBJECT' THEN
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             review_payload, '\\.', 'e', 'g'), '""', 'null', 'g'), '"[^"]*"', 's', 'g'), '(s|null)\s*:', '', 'g'), 'null', '', 'g') END AS flat
  FROM candidate_queue WHERE retrieval_rank IS NOT NULL AND id IS NOT NULL),
points AS (
  SELECT *, 5 * CASE rs WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END
            + CASE ps WHEN 'parsed' THEN 0 WHEN 'metadataonly' THEN 1 WHEN 'nopdf' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END AS trust,
         CASE WHEN regexp_matches(flat, '[^\s{}\[\],]') THEN 1 ELSE 0 END AS filled, coalesce(year(updated_at) * 12 + month(updated_at), -1) AS age
  FROM places),
cells AS (
  SELECT query_key, retrieval_rank, trust, filled, age, count(*) AS n, max(updated_at) AS ts, arg_max(id, (coalesce(epoch_us(updated_at), -1), id)) AS id FROM points GROUP BY ALL),
above AS (
  SELECT o.query_key, o.retrieval_rank, o.trust AS ot, o.filled AS oc, o.age AS oa, c.trust AS ct, c.filled AS cc, c.age AS ca
  FROM cells o JOIN cells c ON o.query_key = c.query_key AND o.retrieval_rank = c.retrieval_rank
   AND o.trust <= c.trust AND o.filled >= c.filled AND o.age >= c.age AND (o.trust < c.trust OR o.filled > c.filled OR o.age > c.age)),
chain AS (
  SELECT query_key, retrieval_rank, trust, filled, age, 1 AS depth FROM cells
  UNION
  SELECT a.query_key, a.retrieval_rank, a.ct, a.cc, a.ca, depth + 1 FROM chain h JOIN above a
    ON a.query_key = h.query_key AND a.retrieval_rank = h.retrieval_rank AND a.ot = h.trust AND a.oc = h.filled AND a.oa = h.age),
layered AS (SELECT query_key, retrieval_rank, trust, filled, age, max(depth) AS layer FROM chain GROUP BY ALL),
groups AS (
  SELECT query_key, retrieval_rank, sum(n)::BIGINT AS n_records, max(layer)::INT AS layers, count(*) FILTER (WHERE layer = 1)::INT AS skyline_cells,
    first(id ORDER BY trust, filled DESC, ts DESC NULLS LAST, id DESC) FILTER (WHERE layer = 1) AS survivor_id
  FROM cells JOIN layered USING (query_key, retrieval_rank, trust, filled, age) GROUP BY query_key, retrieval_rank)
{picks}
SELECT query_key, retrieval_rank, survivor_id, n_records, skyline_cells, layers, {columns} FROM groups {joins}"""

#: fields of p1_best_records
BEST_FIELDS = ("review_status", "parse_status", "review_payload", "review_label", "review_reason", "candidate_title")


def p1_best_sql() -> str:
    picks = "".join(
        f""", pick_{f} AS (
  SELECT query_key, retrieval_rank, first({f} ORDER BY layer, trust, filled DESC, updated_at DESC NULLS LAST, id DESC) AS {f},
    first(layer ORDER BY layer, trust, filled DESC, updated_at DESC NULLS LAST, id DESC)::INT AS {f}_layer
  FROM points JOIN layered USING (query_key, retrieval_rank, trust, filled, age) WHERE {f} IS NOT NULL GROUP BY ALL)"""
        for f in BEST_FIELDS
    )
    joins = " ".join(f"LEFT JOIN pick_{f} USING (query_key, retrieval_rank)" for f in BEST_FIELDS)
    return P1_BEST_SQL.replace("{picks}", picks).replace("{columns}", ", ".join(f"{f}, {f}_layer" for f in BEST_FIELDS)).replace("{joins}", joins)


QUERIES = {f.__name__: f for f in (p2_checks, p3_rejoined, p4_items, p4_raters, p4_unreadable, p5_recall, p6_checks, p7_checks)}


def oracle_sql(votes: str) -> dict[str, str]:
    """SQL by query; ``votes`` is the WITH clause that reads the votes and, before them, ``read``."""
    return {
        "p1_best_records": p1_best_sql(),
        "p2_checks": 'SELECT 0 AS "double", 0 AS unsettled',
        "p3_rejoined": P3_REJOINED_SQL,
        "p4_items": votes + " SELECT query_id, item AS feedback_item_id, count(*) AS n_votes, true AS fine FROM votes GROUP BY query_id, item HAVING count(*) >= 3",
        "p4_raters": votes + " SELECT DISTINCT rater, family, true AS fine FROM votes",
        "p4_unreadable": votes + " SELECT family, w AS words, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM classed) WHERE label IS NULL GROUP BY ALL",
        "p5_recall": P5_RECALL_SQL,
        "p6_checks": "SELECT count(DISTINCT doc_id) AS documents, 0 AS broken, 0 AS cut, 0 AS over_capacity FROM documents",
        "p7_checks": P7_SQL,
    }
