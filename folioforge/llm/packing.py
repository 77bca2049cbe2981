"""Filling fixed-capacity sequences with whole documents, by harmonic packing.

A document of n tokens belongs to class k if capacity/(k+1) < n <= capacity/k, and a
sequence of class k takes exactly k documents of the class, which always fit. Shards of
bounded size fill the sequences of every class independently. With ``top_up``, the default,
what a sequence of a class has left is offered to the documents of smaller classes, largest
first, before those fill sequences of their own, so the harmonic filling is only improved.
Documents above the capacity, and only they,
are cut: full pieces take a sequence each, the remainder is packed as a document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import tokens
from folioforge.session import cut_lineage

CAPACITY = 2048
SHARD_ROWS = 25_000


def pack(lengths: np.ndarray, capacity: int, top_up: bool = True) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``; each at most ``capacity`` in sum. Without
    ``top_up`` a sequence holds documents of one class only."""
    order = np.argsort(-lengths, kind="stable")
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1]:
        by_length[int(lengths[i])].append(int(i))  # popped from the end: in input order
    # below[n]: a length <= n that may still have documents; halved paths as lengths run out
    below = list(range(capacity + 1))

    def largest(n: int) -> int:
        while n > 0 and not by_length[n]:
            m = below[n] if below[n] < n else n - 1
            if not by_length[m] and m > 0 and below[m] < m:
                below[n] = below[m]
            else:
                below[n] = m
            n = below[n]
        return n

    out: list[list[int]] = []
    while (n := largest(capacity)) > 0:
        k = capacity // n
        low = capacity // (k + 1) + 1  # the class's smallest length
        chosen, left = [], capacity
        for _ in range(k):  # the class's fixed count
            n = largest(min(left, capacity // k))
            if n < low:
                break
            chosen.append(by_length[n].pop())
            left -= n
        while top_up and left > 0 and (n := largest(left)) > 0:  # what is left over, to smaller classes
            chosen.append(by_length[n].pop())
            left -= n
        out.append(chosen)
    for turn, i in enumerate(reversed(by_length[0])):  # documents without a token stand at the ends of the sequences, in turn
        if not out:
            out.append([])
        out[turn % len(out)].append(i)
    return out


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, top_up: bool = True) -> DataFrame:
    """(doc_id, n_tokens) -> sequence_id, position, doc_id, piece_no, start_token, n_tokens, offset.

    ``offset`` is the piece's first place in its sequence, ``start_token`` its first token in
    its document. Documents without a token, and null sizes as 0, are placed without taking
    room. Repeated doc_ids are packed each time; null ids like any other. No rows give none.
    """
    spark = sizes.sparkSession
    full = F.floor((F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / capacity)
    x = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    x = x.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    x = x.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("start_token"),
                 F.least(F.col("n_tokens") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n_tokens"))
    x = cut_lineage(x)  # counted here, packed below: the texts are tokenised once
    shards = max(1, -(-x.count() // shard_rows))
    x = x.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["n_tokens"].to_numpy()
        rows, seq, pos, off = [], [], [], []
        base = int(pdf["shard"].iloc[0]) << 32
        for s, members in enumerate(pack(lengths, capacity, top_up)):
            at = 0
            for p, i in enumerate(members):
                rows.append(i)
                seq.append(base + s)
                pos.append(p)
                off.append(at)
                at += int(lengths[i])
        out = pdf.iloc[rows]
        return pd.DataFrame({"sequence_id": seq, "position": np.array(pos, np.int32), "doc_id": out["doc_id"].to_numpy(), "piece_no": out["piece_no"].to_numpy(),
                             "start_token": out["start_token"].to_numpy(), "n_tokens": out["n_tokens"].to_numpy(), "offset": np.array(off, np.int64)})

    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"sequence_id long, position int, doc_id {kind}, piece_no int, start_token long, n_tokens long, offset long"
    if not shards:
        return spark.createDataFrame([], schema)
    return x.groupBy("shard").applyInPandas(run, schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, documents, tokens, mean fill, and sequences under 90 percent."""
    per = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("used"))
    seqs = per.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(F.avg(F.col("used") / capacity), 6).alias("fill"),
        F.sum(F.when(F.col("used") < 0.9 * capacity, 1).otherwise(0)).alias("under_90_percent"),
    )
    return seqs.crossJoin(packed.agg(F.count("*").alias("pieces"), F.count_distinct("doc_id").alias("documents")))


def document_sequences(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Packed sequences of documents.text in tokens of a public tokenizer."""
    return pack_documents(tokens.with_token_counts(documents.select("doc_id", "text"), path=vocabulary), capacity)
