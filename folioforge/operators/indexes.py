"""Search indexes as tables: vectors with their metadata, and postings with statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions import vectors
from folioforge.functions.staging import spread, staged
from folioforge.operators import ranking


def save_dense_index(items: DataFrame, path: str) -> None:
    """(item_id, vector, metadata...) as one Parquet table with unit vectors, so that vectors and
    metadata can't get out of step; null vectors are left out."""
    items.where("vector IS NOT NULL").withColumn("vector", vectors.unit(F.col("vector"))).write.mode("overwrite").parquet(path)


def dense_search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    return ranking.dense_topk(queries, spark.read.parquet(path).select("item_id", "vector"), k)


def save_bm25_index(docs: DataFrame, path: str) -> None:
    """Postings (term, item_id, tf, dl), sorted by term within files so that a search reads few row
    groups, the terms with their document frequency, and one row of statistics. Terms are
    counted within each row; only if an id comes twice are postings shuffled."""
    n, most = docs.groupBy("item_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    x = staged(spread(docs.select("item_id", "text")), _words=F.sort_array(tx.alnum_tokens(F.col("text")))).where(F.size("_words") > 0)
    words, size = F.col("_words"), F.size("_words")
    x = staged(x, _starts=F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))))
    counts = F.transform("_starts", lambda i, j: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get("_starts", j + 1), size) - i).cast("long").alias("tf")))
    p = x.select("item_id", size.alias("dl"), F.explode(counts).alias("c")).select("c.term", "item_id", "c.tf", "dl")
    if (most or 0) > 1:  # rows of one id are one document; its length is that of any of them
        p = p.groupBy("term", "item_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    p.sortWithinPartitions("term", "item_id").write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).write.mode("overwrite").parquet(f"{path}/terms")
    stats = spark.read.parquet(f"{path}/terms").agg(F.lit(n).cast("long").alias("n"), (F.coalesce(F.sum("tf"), F.lit(0)) / F.lit(float(max(n, 1)))).alias("avgdl"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def bm25_search(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, decimals: int | None = None) -> DataFrame:
    """Top ``k`` from a saved index: the queries' terms pick postings, which meet the queries in
    blocks of bounded size (``ranking.bm25_blocks``), so that no pair of query and posting
    becomes a row."""
    n, avgdl = spark.read.parquet(f"{path}/stats").first()
    tokens = queries.select("query_id", tx.alnum_tokens(F.col("text")).alias("tokens"))
    q = tokens.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = spark.read.parquet(f"{path}/terms").join(q.select("term").distinct(), "term", "left_semi").select("term", "df")
    n_queries, n_terms = tokens.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    n_postings = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    part = F.col("tf") / (F.col("tf") + F.lit(k1) * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    p = spark.read.parquet(f"{path}/postings").join(terms, "term").select("item_id", "term", (idf * part).alias("part"))
    return ranking.bm25_blocks(q, p, k, n, n_postings, n_queries, n_terms, decimals)


def manifest(df: DataFrame, **facts: str) -> dict[str, object]:
    """A small description of an index: its columns, rows and the given facts."""
    return {"columns": df.columns, "rows": df.count(), **facts}
