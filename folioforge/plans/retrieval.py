"""Queries of ranking, pooling and evaluation.

Roles on the test tables: every vector is an item, every tenth a query, its label the target
"paper"; an item's paper is its id divided by 5; documents are ranked for exemplar queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import vectors
from folioforge.operators import evaluation, ranking
from folioforge.plans.registry import query
from folioforge.sources import table

VIEW_SQL = "CASE (vec_id // 10) % 3 WHEN 0 THEN 'motivation' WHEN 1 THEN 'method' ELSE 'experiment/result' END"
VIEWS = ("motivation", "method", "experiment/result")

RANK_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
scores AS (SELECT q.vec_id AS query_id, x.vec_id AS item_id, list_cosine_similarity(q.e, x.e) AS score
           FROM v q, v x WHERE q.vec_id % 10 = 0 AND q.vec_id <> x.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores QUALIFY rank <= 20),
ranks AS (
  SELECT q.vec_id AS query_id, q.label AS target, """ + VIEW_SQL + """ AS aspect,
         (SELECT min(t.rank) FROM top t JOIN v x ON x.vec_id = t.item_id WHERE t.query_id = q.vec_id AND x.label = q.label) AS target_rank
  FROM v q WHERE q.vec_id % 10 = 0)
"""  # fmt: skip


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def _top20(spark: SparkSession, d: str) -> DataFrame:
    return ranking.dense_topk(*_vectors(spark, d), k=20, exclude_self=True)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("paper_id"))
    hits = _top20(spark, d).join(labels, "item_id").select("query_id", "paper_id", "rank")
    view = F.element_at(F.array(*[F.lit(v) for v in VIEWS]), (F.floor(F.col("vec_id") / 10) % 3 + 1).cast("int"))
    queries = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("target_paper_id"), view.alias("aspect_group"))
    return evaluation.target_ranks(queries, hits)


@query("tk1_dense_topk", RANK_SQL + "SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM top")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top20(spark, d).withColumn("score", F.round("score", 6))


@query("j1_target_ranks", RANK_SQL + "SELECT query_id, target AS target_paper_id, aspect AS aspect_group, target_rank::INTEGER AS target_rank FROM ranks")
def target_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("query_id", "target_paper_id", "aspect_group", "target_rank")


_CUT_SQL = """
SELECT * FROM (
  SELECT 'AnyAspect@{k}' AS metric, round(avg(a), 9) AS value FROM (SELECT max(coalesce(target_rank <= {k}, false)::INT) AS a FROM ranks GROUP BY target)
  UNION ALL SELECT 'AllAspect@{k}', round(avg(a), 9) FROM (SELECT min(coalesce(target_rank <= {k}, false)::INT) AS a FROM ranks GROUP BY target)
  UNION ALL SELECT 'AspectCoverage@{k}', round(avg(a), 9) FROM (SELECT avg(coalesce(target_rank <= {k}, false)::INT) AS a FROM ranks GROUP BY target)
  UNION ALL SELECT CASE aspect WHEN 'motivation' THEN 'Motivation' WHEN 'method' THEN 'Method' ELSE 'Experiment/Result' END || ' R@{k}', round(avg(coalesce(target_rank <= {k}, false)::INT), 9) FROM ranks GROUP BY aspect)
"""
METRIC_SQL = (
    RANK_SQL + " UNION ALL ".join(_CUT_SQL.replace("{k}", str(k)) for k in (5, 20))
    + " UNION ALL SELECT 'query_count', count(*)::DOUBLE FROM ranks UNION ALL SELECT 'paper_count', count(DISTINCT target)::DOUBLE FROM ranks"
)


@query("ag0_aspect_metrics", METRIC_SQL)
def aspect_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.aspect_metrics(_rows(spark, d)).withColumn("value", F.round("value", 9))


@query("ag1_3_paper_hits", RANK_SQL + """
SELECT target AS target_paper_id,
  max(coalesce(target_rank <= 5, false)::INT)::DOUBLE AS any_5, min(coalesce(target_rank <= 5, false)::INT)::DOUBLE AS all_5,
  round(avg(coalesce(target_rank <= 5, false)::INT), 9) AS coverage_5,
  max(coalesce(target_rank <= 20, false)::INT)::DOUBLE AS any_20, min(coalesce(target_rank <= 20, false)::INT)::DOUBLE AS all_20,
  round(avg(coalesce(target_rank <= 20, false)::INT), 9) AS coverage_20
FROM ranks GROUP BY target""")
def paper_hits(spark: SparkSession, d: str) -> DataFrame:
    x = evaluation.paper_hits(_rows(spark, d))
    return x.withColumns({c: F.round(c, 9) for c in ("coverage_5", "coverage_20")})


@query("m4_ndcg_hits", RANK_SQL + """
SELECT query_id, CASE WHEN target_rank <= 10 THEN round(1 / log2(target_rank + 1), 9) ELSE 0.0 END AS ndcg_10,
       coalesce(target_rank <= 20, false)::INT AS hit_20 FROM ranks""")
def ndcg_hits(spark: SparkSession, d: str) -> DataFrame:
    x = _rows(spark, d)
    return x.select("query_id", F.round(evaluation.ndcg(F.col("target_rank")), 9).alias("ndcg_10"), evaluation.hit(F.col("target_rank"), 20).alias("hit_20"))


@query("ag6_one_query_summary", RANK_SQL + """
SELECT target::INTEGER AS position, 'model-' || target AS model, count(*) AS n_queries,
  round(100 * avg(CASE WHEN target_rank <= 10 THEN 1 / log2(target_rank + 1) ELSE 0.0 END), 6) AS ndcg_10,
  round(100 * avg(coalesce(target_rank <= 20, false)::INT), 6) AS recall_20
FROM ranks GROUP BY target""")
def one_query_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("model", F.concat(F.lit("model-"), F.col("target_paper_id").cast("string")))
    order = table(spark, d, "embeddings").select(F.col("label").alias("position")).distinct().withColumn("model", F.concat(F.lit("model-"), F.col("position").cast("string")))
    return evaluation.one_query_summary(rows, order).withColumns({c: F.round(c, 6) for c in ("ndcg_10", "recall_20")})


HITS_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
hits AS (SELECT q.vec_id AS query_id, x.vec_id AS chunk_id, x.vec_id // 5 AS paper_id, list_cosine_similarity(q.e, x.e) AS score
         FROM v q, v x WHERE q.vec_id % 10 = 0)
"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    q, x = _vectors(spark, d)
    top = ranking.dense_topk(q, x, k)
    return top.select("query_id", F.col("item_id").alias("chunk_id"), F.floor(F.col("item_id") / 5).alias("paper_id"), "score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "paper_id", F.round("score", 6).alias("score"), "rank")


for _name, _strategy, _agg in (("max", "max", "max(score)"), ("avg_topk", "avg", "avg(score) FILTER (WHERE place <= 3)")):
    _exhaustive = HITS_SQL + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC) AS place FROM hits),
    pooled AS (SELECT query_id, paper_id, {_agg} AS score FROM placed GROUP BY ALL)
    SELECT query_id, paper_id, round(score, 6) AS score, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM pooled) WHERE rank <= 20"""
    _overfetch = HITS_SQL + f""", few AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 160),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC) AS place FROM few),
    pooled AS (SELECT query_id, paper_id, {_agg} AS score FROM placed GROUP BY ALL)
    SELECT query_id, paper_id, round(score, 6) AS score, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM pooled) WHERE rank <= 20"""

    @query(f"ag7_8_tk4_overfetch_{_name}", _overfetch)
    def overfetch(spark: SparkSession, d: str, s: str = _strategy) -> DataFrame:
        return _rounded(ranking.pooled_ranking(_hits(spark, d, 160), s, 20))

    @query(f"tk5_exhaustive_{_name}", _exhaustive)
    def exhaustive(spark: SparkSession, d: str, s: str = _strategy) -> DataFrame:
        q, x = _vectors(spark, d)
        chunks = x.select(F.col("item_id").alias("chunk_id"), F.floor(F.col("item_id") / 5).alias("paper_id"), "vector")
        return _rounded(ranking.dense_pooled_topk(q, chunks, 20, s))


@query("ag9_mean_vectors", """
SELECT vec_id // 5 AS paper_id, list_transform(range(1, 65), lambda i: round(avg(embedding[i]::DOUBLE), 6)) AS vector FROM embeddings GROUP BY 1
""".replace("list_transform(range(1, 65), lambda i: round(avg(embedding[i]::DOUBLE), 6))",
            "[" + ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 6)" for i in range(1, 65)) + "]"))
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("paper_id"), F.col("embedding").alias("vector"))
    return ranking.pool_mean_vectors(x, "paper_id", "vector").withColumn("vector", F.transform("vector", lambda v: F.round(v, 6)))


@query("tk7_filtered_neighbors", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query_id, x.vec_id AS item_id, round(1 - list_cosine_similarity(q.e, x.e), 6) AS distance
FROM v q, v x WHERE q.vec_id % 20 = 0 AND x.label = 1
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, x.e), 9) DESC, x.vec_id) <= 5""")
def filtered_neighbors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ranking.filtered_neighbors(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label"), F.col("label") == 1, 5)
    return found.select("query_id", "item_id", F.round("distance", 6).alias("distance"))



@query("m1_unit_vectors", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS n FROM v)
SELECT vec_id, round(n, 6) AS length, list_transform(e, lambda x: round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6)) AS unit FROM n""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.transform(vectors.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("m11_vector_text")
def vector_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", vectors.encoded(F.col("embedding")).alias("encoded"))
    return e.select("vec_id", "encoded", F.size(vectors.decoded(F.col("encoded"))).alias("numbers"))


BM25_SQL = """
WITH d AS (SELECT doc_id AS item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM d),
p AS (SELECT item_id, len(tokens) AS dl, unnest(tokens) AS term FROM d),
tf AS (SELECT item_id, term, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM
        (SELECT example_id AS query_id, unnest(regexp_extract_all(lower(any_value(query_text)), '[a-z0-9]+')) AS term FROM golden_query_embeddings GROUP BY example_id) GROUP BY ALL),
s AS (SELECT query_id, item_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, round(round(score, 8), 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 20
"""


@query("tk3_bm25_topk", BM25_SQL)
def bm25(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "golden_query_embeddings").select(F.col("example_id").alias("query_id"), F.col("query_text").alias("text")).dropDuplicates(["query_id"])
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    # sums differ in the last bits with the order of addition, so ties are made at 8 decimals
    return ranking.bm25_topk(queries, docs, 20, decimals=8).withColumn("score", F.round("score", 6))
