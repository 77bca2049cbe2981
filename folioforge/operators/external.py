"""Places where models and services plug in, with deterministic doubles for tests.

An embedder, scorer or search client is created once a task inside the Arrow batches; the
engine around it handles batching, retries, caching by key and resuming.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.keys import joined_sha1
from folioforge.operators.dedupe import keep_first


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Scorer(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float | None]: ...


class SearchClient(Protocol):
    def search(self, query: str, limit: int) -> Sequence[dict]: ...


class HashEmbedder:
    """Signed feature hashing of words: equal texts get equal vectors, on every machine."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class TableSearch:
    """A search client over a fixed list of titled records: most shared words first."""

    def __init__(self, records: Sequence[dict]) -> None:
        self.records = list(records)

    def search(self, query: str, limit: int) -> list[dict]:
        words = set(query.lower().split())
        scored = [(-len(words & set(r["title"].lower().split())), i) for i, r in enumerate(self.records)]
        return [self.records[i] for s, i in sorted(scored) if s < 0][:limit]


def retried[T](call: Callable[[], T], attempts: int = 3, wait: float = 0.5, pause: Callable[[float], None] = time.sleep) -> T:
    """The result of the first attempt that succeeds; waits double between attempts."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            pause(wait * 2**n)
    raise ValueError("attempts must be positive")


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder], batch: int = 32, limit: int | None = None) -> DataFrame:
    """``df`` with ``embedding`` and ``embed_error``. Texts are cut to ``limit`` characters; null and
    blank texts get neither. A failing batch is halved until the failing rows are single;
    those get the error, the rest their vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def some(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
            try:
                vectors = model.embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return [([float(x) for x in v], None) for v in vectors]
            except Exception as e:  # noqa: BLE001
                if len(texts) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                half = len(texts) // 2
                return some(texts[:half]) + some(texts[half:])

        for pdf in batches:
            texts = [None if t is None or t != t or not t.strip() else t[:limit] for t in pdf[text]]
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list[tuple[list[float] | None, str | None]] = [(None, None)] * len(texts)
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                for i, r in zip(part, some([texts[i] for i in part])):
                    out[i] = r
            yield pdf.assign(embedding=[v for v, _ in out], embed_error=[e for _, e in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", embedding array<double>, embed_error string"
    return df.mapInPandas(run, schema)


def embedding_key(model: str, url: str, instruction: str, text: Column) -> Column:
    """Cache key of an embedding: sha1 of model, url, instruction and text."""
    return joined_sha1(F.lit(model), F.lit(url), F.lit(instruction), text)


def embed_missing(df: DataFrame, cache: DataFrame, key: str, text: str, make: Callable[[], Embedder]) -> DataFrame:
    """The cache with the embeddings of the keys it lacked; each key is embedded once."""
    new = keep_first(df.select(key, text).where(F.col(text).isNotNull()), [key], [text]).join(cache.select(key), key, "left_anti")
    return cache.unionByName(embedded(new, text, make).where("embedding IS NOT NULL").select(*cache.columns))


CANDIDATE = "query_id string, position int, title string, arxiv_id string, year int, url string, source string"


def searched(plans: DataFrame, make: Callable[[], SearchClient], source: str, limit: int = 100, attempts: int = 3) -> DataFrame:
    """Candidates of (query_id, query) rows from a search client, in its order. A query that fails
    every attempt gives no rows."""
    columns = [c.split()[0] for c in CANDIDATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            rows = []
            for qid, text in zip(pdf["query_id"], pdf["query"]):
                try:
                    found = retried(lambda t=text: client.search(t, limit), attempts)
                except Exception:  # noqa: BLE001
                    found = []
                rows += [(qid, i, r.get("title"), r.get("arxiv_id"), r.get("year"), r.get("url"), source) for i, r in enumerate(found[:limit])]
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"year": "Int32", "position": "int32"})

    return plans.where("query_id IS NOT NULL AND length(trim(query)) > 0").select("query_id", "query").mapInPandas(run, CANDIDATE)


def reranked(candidates: DataFrame, scores: DataFrame, keep: int = 30) -> DataFrame:
    """At most ``keep`` candidates of each query: those with a valid score (query_id, position,
    score) best first; a query without any valid score keeps its first ones in order; queries
    with no more than ``keep`` candidates stay as they are."""
    from pyspark.sql import Window

    valid = keep_first(scores.where(F.col("score").isNotNull()), ["query_id", "position"], [F.col("score").desc()])
    x = candidates.join(valid, ["query_id", "position"], "left")
    q = Window.partitionBy("query_id")
    x = x.withColumn("_n", F.count("*").over(q)).withColumn("_scored", F.count("score").over(q))
    x = x.where((F.col("_n") <= keep) | (F.col("_scored") == 0) | F.col("score").isNotNull())
    by_score = (F.col("_n") > keep) & (F.col("_scored") > 0)
    w = q.orderBy(F.when(by_score, -F.col("score")).asc_nulls_last(), "position")
    return x.withColumn("retrieval_rank", F.row_number().over(w)).where(F.col("retrieval_rank") <= keep).drop("_n", "_scored", "score")


def best_attempt(attempts: DataFrame, keys: Sequence[str], coverage: str, order: str) -> DataFrame:
    """Of several attempts at a key the one with the most coverage; the first of equals."""
    return keep_first(attempts, keys, [F.col(coverage).desc_nulls_last(), order])
