"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import consensus, invariants, matching, mixing, neighbors, packing, residue, residue_sql, splitting, survivor
from folioforge.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    places = survivor.queue_survivors(table(spark, d, "candidate_queue"), min_ids=2)
    return places.select("query_key", "retrieval_rank", "survivor_id")


def p1_best_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.queue_survivors(table(spark, d, "candidate_queue"), invariants.BEST_FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # chunks within the limit can't be found, so their texts stay where they are
    rows = splitting.corpus_rows(table(spark, d, "paper_records"), table(spark, d, "chunk_records"), splitting.LIMIT)
    plan = splitting.plan_pieces(splitting.placed_rows(splitting.row_profiles(rows)))
    return plan.groupBy("item_kind", "item_id").count().select("item_kind", "item_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(splitting.corpus_rows(table(spark, d, "paper_records"), table(spark, d, "chunk_records")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = matching.listings_to_papers(table(spark, d, "hard_negative_papers"), table(spark, d, "openreview_papers"))
    return found.select("hn_id", "paper_id")


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    found = matching.listings_to_papers(table(spark, d, "hard_negative_papers"), table(spark, d, "openreview_papers"), threshold=0.05)
    return found.withColumn("confidence", F.round("confidence", 4))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.feedback_consensus(table(spark, d, "human_feedback")).select("query_id", "feedback_item_id", "judgement")


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, confusion = consensus.variational_consensus(consensus.feedback_votes(table(spark, d, "human_feedback")), consensus.FEEDBACK_CLASSES)
    return consensus.reliability(confusion)


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    found = consensus.krippendorff_alpha(consensus.feedback_votes(table(spark, d, "human_feedback")))
    return found.withColumn("alpha", F.round("alpha", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbors.exemplar_neighbors(table(spark, d, "golden_query_embeddings"), table(spark, d, "paper_text_embeddings"), 10, 0.9)
    return found.select("example_id", "paper_id")


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.exemplar_neighbors(table(spark, d, "golden_query_embeddings"), table(spark, d, "paper_text_embeddings"), 10)


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.document_sequences(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.document_sequences(table(spark, d, "documents")))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    selection, _ = mixing.document_mix(table(spark, d, "documents"), table(spark, d, "source_weights"))
    return selection


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.document_mix(table(spark, d, "documents"), table(spark, d, "source_weights"))
    return report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents")).select("doc_id")


def p8_messages(spark: SparkSession, d: str) -> DataFrame:
    found = residue.classified(residue.candidate_messages(table(spark, d, "documents")))
    return found.where("grade > 0 AND (recurs OR grade = 3)").select("mask", "kind", "grade", "n_docs", "n_sources")


P1_SQL = r"""
WITH places AS (
  SELECT coalesce(nullif(regexp_replace(lower(query_key), '^\s+|\s+$', '', 'g'), ''),
                  sha1(concat(coalesce(paper_id, ''), chr(10), coalesce(query_text, ''), chr(10),
                              coalesce(source_view, ''), chr(10), coalesce(query_type, '')))) AS query_key,
         retrieval_rank, id, updated_at,
         regexp_replace(lower(review_status), '[\s_./-]+', '', 'g') AS rs,
         regexp_replace(lower(parse_status), '[\s_./-]+', '', 'g') AS ps,
         CASE WHEN json_valid(review_payload) AND json_type(review_payload) = 'OBJECT' THEN
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             review_payload, '\\.', 'e', 'g'), '""', 'null', 'g'), '"[^"]*"', 's', 'g'), '(s|null)\s*:', '', 'g'), 'null', '', 'g')
         END AS flat
  FROM candidate_queue WHERE retrieval_rank IS NOT NULL),
ranked AS (
  SELECT query_key, retrieval_rank, id,
         row_number() OVER (PARTITION BY query_key, retrieval_rank ORDER BY
           CASE rs WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END,
           CASE ps WHEN 'parsed' THEN 0 WHEN 'metadataonly' THEN 1 WHEN 'nopdf' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END,
           CASE WHEN regexp_matches(flat, '[^\s{}\[\],]') THEN 0 ELSE 1 END,
           updated_at DESC NULLS LAST, id DESC) AS place
  FROM places)
SELECT query_key, retrieval_rank, max(id) FILTER (WHERE place = 1) AS survivor_id
FROM ranked GROUP BY query_key, retrieval_rank HAVING count(DISTINCT id) > 1
"""

P3_SQL = r"""
WITH texts AS (
  SELECT DISTINCT 'paper' AS item_kind, representation_type || '::' || paper_id AS item_id, source_path, row_no, text FROM paper_records
  UNION ALL
  SELECT DISTINCT 'chunk', chunk_id, '', 0, text FROM chunk_records)
SELECT item_kind, item_id FROM texts
GROUP BY item_kind, item_id
HAVING sum(len(regexp_extract_all(replace(coalesce(text, ''), chr(0), ''),
  '[^\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))) > 512
"""


P4_AGREEMENT_SQL = r"""
WITH words AS (
  SELECT query_id, feedback_item_id AS item, id, updated_at,
         nullif(regexp_replace(lower(split_part(reviewer_username, '@', 1)), '[^\p{L}\p{N}]+', '', 'g'), '') AS rater,
         CASE WHEN feedback_item_id = 'query_relevance' THEN 'query_relevance' WHEN feedback_item_id = 'human_like' THEN 'human_like'
              WHEN regexp_matches(feedback_item_id, '^cand_[0-9]+$') THEN 'candidate' END AS family,
         trim(regexp_replace(lower(judgement), '[^\p{L}\p{N}]+', ' ', 'g')) AS w
  FROM human_feedback),
classed AS (SELECT *, CASE {cases} END AS label FROM words),
read AS (SELECT * FROM classed WHERE rater IS NOT NULL AND query_id IS NOT NULL),
votes AS (
  SELECT query_id, item, rater, family, label FROM read WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, item, rater, family ORDER BY updated_at DESC NULLS LAST, id DESC) = 1),
per AS (SELECT family, query_id, item, label, count(*) AS n FROM votes GROUP BY ALL),
units AS (SELECT family, query_id, item, sum(n) AS m, sum(n * n) AS same FROM per GROUP BY ALL HAVING sum(n) > 1),
observed AS (SELECT family, sum(m) AS n, count(*) AS items, sum((m * m - same) / (m - 1)) AS disagree FROM units GROUP BY family),
chance AS (
  SELECT family, sum(n * n) AS same FROM (SELECT family, label, sum(n) AS n FROM per JOIN units USING (family, query_id, item) GROUP BY ALL) GROUP BY family)
SELECT family, items, n::BIGINT AS votes,
       round(1 - disagree / ((n::DOUBLE * n - same) / (n - 1)), 9) AS alpha
FROM observed JOIN chance USING (family)
"""

P5_SQL = """
WITH q AS (SELECT DISTINCT example_id, embedding::DOUBLE[] AS e FROM golden_query_embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
             AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
p AS (SELECT paper_id, embedding::DOUBLE[] AS e FROM paper_text_embeddings
      WHERE model_name = 'pebble-embed-v2' AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
        AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
s AS (SELECT example_id, paper_id, max(list_cosine_similarity(q.e, p.e)) AS s FROM q, p GROUP BY ALL)
SELECT example_id, paper_id FROM s WHERE s >= 0.9
QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY s DESC, paper_id) <= 10
"""


def _agreement_sql() -> str:
    cases = " ".join(
        f"WHEN family = '{family}' AND w IN ({', '.join(repr(f) for f in forms)}) THEN '{label}'"
        for family, labels in consensus.SYNONYMS.items()
        for label, forms in labels.items()
    )
    return P4_AGREEMENT_SQL.replace("{cases}", cases)


def _votes_sql() -> str:
    """The beginning of the agreement's SQL that reads the votes."""
    sql = _agreement_sql()
    return sql[: sql.index(",\nper AS")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_best_records": p1_best_records,
        "p2_found": p2_found,
        "p2_matches": p2_matches,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_reliability": p4_reliability,
        "p4_agreement": p4_agreement,
        "p5_found": p5_found,
        "p5_neighbors": p5_neighbors,
        "p6_sequences": p6_sequences,
        "p6_fill": p6_fill,
        "p7_selection": p7_selection,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_messages": p8_messages,
        **invariants.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p4_agreement": _agreement_sql(), "p5_found": P5_SQL, "p8_found": residue_sql.found_sql(), "p8_messages": residue_sql.messages_sql(), **invariants.oracle_sql(_votes_sql())}
