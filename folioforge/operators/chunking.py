"""Token-window chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_windows(docs: DataFrame, tokens: Column, size: int = 512, overlap: int = 128) -> DataFrame:
    """Overlapping windows over each row's token array: chunk_index, start, end, token_count,
    overlap_tokens and ``chunk_tokens``, beside the row's other columns.

    Windows start every ``size - overlap`` tokens; the first that reaches the end is the last.
    Rows without tokens give none. The window starts are a sequence, so a row is cut in one
    pass without a join or shuffle.
    """
    step = size - overlap
    x = docs.withColumn("_tokens", tokens).withColumn("_n", F.size("_tokens"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    x = x.where("_n > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.col("_n"))
    return x.select(
        *[F.col(c) for c in docs.columns],
        "chunk_index",
        start.alias("start"),
        end.alias("end"),
        (end - start).alias("token_count"),
        F.when(F.col("chunk_index") == 0, 0).otherwise(overlap).alias("overlap_tokens"),
        F.slice("_tokens", start + 1, end - start).alias("chunk_tokens"),
    )


def chunk_id(representation: Column, paper_id: Column, index: Column) -> Column:
    return F.concat_ws("::", representation, paper_id, F.lit("chunk"), F.lpad(index.cast("string"), 4, "0"))
