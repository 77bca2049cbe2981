"""Dense and lexical ranking, rank assignment, pooling.

Rankings stay in long form: query_id, item_id, score, rank. Ties: smaller id first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text, vectors

QUERY_BLOCK, ITEM_BLOCK = 4_096, 20_000
#: of ``bm25_blocks``: postings, query terms and results of a task, items scored at once, terms of a query with a sum of their own
POSTINGS, QUERY_TERMS, RESULTS, STRIP, LEVELS = 1_000_000, 400_000, 600_000, 16_384, 24


def ranked(scores: DataFrame, k: int | None = None, by: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """``rank`` 1..n within each query, by score descending and id ascending; at most ``k``.

    The limit becomes a partial and a final group limit, so no query's scores are shuffled
    beyond k rows a task. Null scores rank last."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), F.col(item).asc())
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k is not None else out


def dense_topk(queries: DataFrame, items: DataFrame, k: int, normalise: bool = True, exclude_self: bool = False) -> DataFrame:
    """Exact top ``k`` items of each query by inner product (cosine with ``normalise``).

    queries (query_id, vector) x items (item_id, vector) in blocks: item blocks and query
    blocks of bounded size meet in one task each, which keeps k rows a query; nothing is
    broadcast and no pair leaves a task unranked. Null vectors take no part; vectors of a
    query and an item must have one size; zero vectors score 0. No rows on a side: none out.
    """
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    x = items.where("vector IS NOT NULL").select("item_id", F.col("vector").cast("array<float>").alias("vector"))
    cores = items.sparkSession.sparkContext.defaultParallelism
    counts = q.select(F.lit(1).alias("side")).unionAll(x.select(F.lit(2).alias("side"))).groupBy("side").count().collect()
    n = {r["side"]: r["count"] for r in counts}
    q_blocks = max(1, -(-n.get(1, 0) // QUERY_BLOCK))
    x_blocks = max(min(cores, -(-n.get(2, 0) // 1000)), -(-n.get(2, 0) // ITEM_BLOCK), 1)
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    q = q.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    x = x.withColumn("xb", F.pmod(F.xxhash64("item_id"), F.lit(x_blocks)).cast("int"))
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def matrix(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_numpy()).astype(np.float64)
        if normalise:
            length = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(length == 0, 1, length)
        return m

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype=object), "item_id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        b = b.sort_values("item_id", kind="stable")
        s = matrix(a["vector"]) @ matrix(b["vector"]).T
        ids, qids = b["item_id"].to_numpy(), a["query_id"].to_numpy()
        if exclude_self:
            s[qids[:, None] == ids[None, :]] = -np.inf
        top = min(k, s.shape[1])
        if top < s.shape[1]:
            cut = -np.partition(-s, top - 1, axis=1)[:, top - 1]
            rows, cols = np.nonzero(s >= cut[:, None])  # ties at the cut go on to the ranking
        else:
            rows, cols = np.nonzero(np.ones_like(s, dtype=bool))
        score = s[rows, cols]
        fine = score > -np.inf
        return pd.DataFrame({"query_id": qids[rows[fine]], "item_id": ids[cols[fine]], "score": score[fine]})

    kinds = q.schema["query_id"].dataType.simpleString(), x.schema["item_id"].dataType.simpleString()
    found = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInPandas(block, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    return ranked(found, k)


def postings(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(doc, term, tf, dl): term frequencies and document length, one row a document and term."""
    x = docs.select(F.col(doc_id).alias("doc"), tokens.alias("tokens")).select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return x.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, decimals: int | None = None) -> DataFrame:
    """BM25 top ``k`` for queries (query_id, text) over docs (item_id, text).

    Tokens are lower-case [a-z0-9] runs; a query term counts as often as it occurs. Only
    documents that share a term with a query are scored. Postings are cut to the queries'
    terms before anything is shuffled; blocks of documents and of queries of bounded size
    meet in one task each, add up scores term by term and pass on k rows a query, so that
    the postings of frequent terms are never paired with queries as rows. ``decimals``
    rounds the scores before they are compared. Null texts have no tokens.
    """
    d = docs.select("item_id", text.alnum_tokens(F.col("text")).alias("tokens"))
    n, avgdl = d.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    q = queries.select("query_id", F.explode(text.alnum_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = q.select("term").distinct()
    p = d.select("item_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    p = p.groupBy("item_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    q = q.join(df, "term").withColumn("weight", F.col("qtf") * F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("tf") / (F.col("tf") + F.lit(k1) * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    n_queries = queries.count()
    q_blocks, x_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // ITEM_BLOCK), min(docs.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)))
    x = p.select("item_id", "term", part.alias("part"), F.pmod(F.xxhash64("item_id"), F.lit(x_blocks)).cast("int").alias("xb"))
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    y = q.select("query_id", "term", "weight", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"))
    y = y.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))

    def block(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if a.empty or c.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype=object), "item_id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        at, items = pd.factorize(c["item_id"], sort=True)
        order = np.argsort(c["term"].to_numpy().astype(object), kind="stable")
        terms, at, part = c["term"].to_numpy().astype(object)[order], at[order], c["part"].to_numpy()[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        span = {t: (s, e) for t, s, e in zip(terms[starts], starts, np.append(starts[1:], len(terms)))}
        ids, found, scores = [], [], []
        for qid, rows in a.groupby("query_id", sort=False):
            total = np.zeros(len(items))
            for t, w in zip(rows["term"], rows["weight"]):
                if t in span:
                    s, e = span[t]
                    total[at[s:e]] += w * part[s:e]  # an item has a term once
            if decimals is not None:
                total = total.round(decimals)
            hit = np.flatnonzero(total > 0)
            if len(hit) > k:
                cut = -np.partition(-total[hit], k - 1)[k - 1]
                hit = hit[total[hit] >= cut]  # ties at the cut go on to the ranking
            ids += [qid] * len(hit)
            found.append(hit)
            scores.append(total[hit])
        found = np.concatenate(found)
        return pd.DataFrame({"query_id": pd.Series(ids, dtype=a["query_id"].dtype), "item_id": np.asarray(items)[found], "score": np.concatenate(scores)})

    kinds = y.schema["query_id"].dataType.simpleString(), x.schema["item_id"].dataType.simpleString()
    hits = y.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInPandas(block, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    return ranked(hits, k)


def bm25_blocks(queries: DataFrame, parts: DataFrame, k: int, n_items: int, n_postings: int, n_queries: int, n_terms: int, decimals: int | None = None) -> DataFrame:
    """Exact top ``k`` for query terms (query_id, term, qtf) over parts (item_id, term, part), the score
    being the sum of qtf * part over the terms of both; every part is above 0.

    The counts size the blocks. A task adds up whole columns of items, a strip at a time: queries
    are sorted by their terms, most used first, and a query starts from the sum of the terms
    that it shares with the one before. ``decimals`` rounds the scores before they are compared.
    """
    cores = parts.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-n_terms // QUERY_TERMS), -(-n_queries * k // RESULTS))
    x_blocks = max(1, -(-n_postings // POSTINGS), min(cores, -(-n_items // 1000)))
    x = parts.select("item_id", "term", "part", F.pmod(F.xxhash64("item_id"), F.lit(x_blocks)).cast("int").alias("xb"))
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    y = queries.select("query_id", "term", "qtf", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"))
    y = y.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    near = 0.0 if decimals is None else 2 * 10.0**-decimals  # scores so near may be equal or change places when rounded

    def codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """The distinct values in order, null first, and each row's place among them."""
        values = pc.unique(column)
        values = values.take(pc.sort_indices(values, null_placement="at_start"))
        return values, pc.index_in(column, value_set=values).to_numpy()

    def sequences(a: pa.Table, terms: pa.Array) -> tuple[pa.Array, list[tuple[int, list[int], int]]]:
        """Query ids, and in order (place of the id, its terms as count * number of terms + term, how many are those of the one before)."""
        a = a.append_column("t", pc.index_in(a["term"], value_set=terms)).filter(pc.field("t").is_valid())
        qids, at = codes(a["query_id"])
        t, f = a["t"].to_numpy(), a["qtf"].to_numpy()
        order = np.lexsort((t, -np.bincount(t, minlength=len(terms))[t], at))
        coded = (f[order] * len(terms) + t[order]).tolist()
        ends = np.cumsum(np.bincount(at, minlength=len(qids))).tolist()
        found, before = [], []
        for own, i in sorted((coded[s:e], i) for i, (s, e) in enumerate(zip([0, *ends], ends))):
            same = next((j for j, (u, v) in enumerate(zip(own, before)) if u != v), min(len(own), len(before)))
            found.append((i, own, min(same, LEVELS - 1)))
            before = own
        return qids, found

    def block(a: pa.Table, c: pa.Table) -> pa.Table:
        terms, t = codes(c["term"])
        qids, asked = sequences(a, terms)
        items, at = codes(c["item_id"])
        part = c["part"].to_numpy()
        order = np.lexsort((at, t, at // STRIP))
        t, at, part = t[order], at[order], part[order]
        spans = np.append(np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (at[1:] // STRIP != at[:-1] // STRIP))), len(t)) if len(t) else np.zeros(1, int)
        best: list = [None] * len(qids)
        floor = np.zeros(len(qids))
        width = min(STRIP, -(-len(items) // 64) * 64)
        sums = np.zeros((min(LEVELS, max((len(own) for _, own, _ in asked), default=0)) + 1, width))
        span = 0
        for base in range(0, len(items), STRIP):
            columns: list = [None] * len(terms)
            while span + 1 < len(spans) and at[spans[span]] < base + STRIP:
                s, e = spans[span], spans[span + 1]
                where, value = at[s:e] - base, part[s:e]
                if e - s > width // 16:
                    dense = np.zeros(width)
                    dense[where] = value
                    columns[t[s]] = None, dense
                else:
                    columns[t[s]] = where, value
                span += 1
            for i, own, same in asked:
                for level, code in enumerate(own[same:], same):
                    f, term = divmod(code, len(terms))
                    low, high = sums[min(level, LEVELS - 1)], sums[min(level + 1, LEVELS)]
                    if level >= LEVELS:
                        low = high
                    if columns[term] is None:
                        if low is not high:
                            high[:] = low
                        continue
                    where, value = columns[term]
                    if f != 1:
                        value = f * value
                    if where is None:
                        np.add(low, value, out=high)
                    else:
                        if low is not high:
                            high[:] = low
                        high[where] += value  # an item has a term once
                total = sums[min(len(own), LEVELS)]
                # k items of different columns are at least as good as the k-th best column
                peaks = total.reshape(64, -1).max(axis=0)
                cut = max(floor[i], np.partition(peaks, -k)[-k] if len(peaks) > k else 0.0) - near
                hit = np.flatnonzero(total >= cut) if cut > 0 else np.flatnonzero(total)
                if len(hit):
                    score = total[hit] if decimals is None else total[hit].round(decimals)
                    hit = hit + base
                    if best[i] is not None:
                        hit, score = np.append(best[i][0], hit), np.append(best[i][1], score)
                    first = np.lexsort((hit, -score))[:k]
                    best[i] = hit[first], score[first]
                    if len(first) == k:
                        floor[i] = score[first[-1]]
        kept = [(i, *x) for i, x in enumerate(best) if x is not None]
        ids = np.repeat(np.array([i for i, _, _ in kept], int), [len(x) for _, x, _ in kept])
        hits = np.concatenate([np.zeros(0, int), *[x for _, x, _ in kept]])
        scores = np.concatenate([np.zeros(0), *[s for _, _, s in kept]])
        return pa.table({"query_id": qids.take(pa.array(ids)), "item_id": items.take(pa.array(hits)), "score": scores})

    kinds = y.schema["query_id"].dataType.simpleString(), x.schema["item_id"].dataType.simpleString()
    found = y.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInArrow(block, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    return ranked(found, k)


def dense_pooled_topk(queries: DataFrame, chunks: DataFrame, k: int, strategy: str = "max", depth: int = 3, normalise: bool = True) -> DataFrame:
    """Exact top ``k`` papers of each query by pooled scores of all their chunks.

    queries (query_id, vector), chunks (chunk_id, paper_id, vector). ``max`` pools by the best
    chunk, ``avg`` by the mean of the ``depth`` best. Chunks go to blocks by paper, so a
    block pools whole papers and passes on k of them a query; papers with more chunks than a
    block holds are spread by chunk and pass on their ``depth`` best scores instead.
    """
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    x = chunks.where("vector IS NOT NULL AND paper_id IS NOT NULL").select("chunk_id", "paper_id", F.col("vector").cast("array<float>").alias("vector"))
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    nq, nx = q.count(), x.count()
    q_blocks, x_blocks = max(1, -(-nq // QUERY_BLOCK)), max(min(cores, -(-nx // 1000)), -(-nx // ITEM_BLOCK), 1)
    hot = x.groupBy("paper_id").count().where(F.col("count") > ITEM_BLOCK).select("paper_id", F.lit(True).alias("hot"))
    x = x.join(hot, "paper_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    home = F.when(F.col("hot"), F.xxhash64("chunk_id")).otherwise(F.xxhash64("paper_id"))
    x = x.withColumn("xb", F.pmod(home, F.lit(x_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    keep = 1 if strategy == "max" else depth

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_numpy()).astype(np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1, length) if normalise else m

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "paper_id": [], "score": [], "hot": []}
        if a.empty or b.empty:
            kinds = {"query_id": object, "paper_id": object, "score": float, "hot": bool}
            return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in kinds.items()})
        b = b.sort_values("paper_id", kind="stable")
        scores = unit(a["vector"]) @ unit(b["vector"]).T
        papers = b["paper_id"].to_numpy()
        starts = np.flatnonzero(np.append(True, papers[1:] != papers[:-1]))
        names, is_hot = papers[starts], b["hot"].to_numpy()[starts]
        ends = np.append(starts[1:], len(papers))
        pooled = np.full((len(a), len(starts)), -np.inf)
        for c, (s, e) in enumerate(zip(starts, ends)):
            part = scores[:, s:e]
            if is_hot[c]:
                best = -np.sort(-part, axis=1)[:, :keep]
                for r in range(best.shape[1]):
                    out["query_id"].extend(a["query_id"])
                    out["paper_id"].extend([names[c]] * len(a))
                    out["score"].extend(best[:, r])
                    out["hot"].extend([True] * len(a))
            elif strategy == "max":
                pooled[:, c] = part.max(axis=1)
            else:
                n = min(keep, e - s)
                pooled[:, c] = -np.partition(-part, n - 1, axis=1)[:, :n].mean(axis=1) if n < e - s else part.mean(axis=1)
        top = min(k, pooled.shape[1])
        cut = -np.partition(-pooled, top - 1, axis=1)[:, top - 1]
        rows, cols = np.nonzero((pooled >= cut[:, None]) & (pooled > -np.inf))
        cold = pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows], "paper_id": names[cols], "score": pooled[rows, cols], "hot": np.zeros(len(rows), bool)})
        return pd.concat([cold, pd.DataFrame(out)]) if out["hot"] else cold

    kinds = q.schema["query_id"].dataType.simpleString(), x.schema["paper_id"].dataType.simpleString()
    found = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInPandas(block, f"query_id {kinds[0]}, paper_id {kinds[1]}, score double, hot boolean")
    pooled = pool_max(found) if strategy == "max" else pool_avg_topk(found, depth)
    return ranked(pooled, k, item="paper_id")


def pool_max(hits: DataFrame) -> DataFrame:
    """(query_id, paper_id, score): the best chunk score of each paper."""
    return hits.groupBy("query_id", "paper_id").agg(F.max("score").alias("score"))


def pool_avg_topk(hits: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the ``k`` best chunk scores of each paper, over the number present."""
    w = Window.partitionBy("query_id", "paper_id").orderBy(F.col("score").desc())
    top = hits.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k)
    return top.groupBy("query_id", "paper_id").agg(F.avg("score").alias("score"))


def pooled_ranking(hits: DataFrame, strategy: str, k: int, overfetch: int | None = None) -> DataFrame:
    """Chunk hits to paper ranking: optionally only the ``overfetch`` best chunks of a query take
    part (which truncates pools), then pooling, then the ``k`` best papers."""
    if overfetch is not None:
        hits = ranked(hits.withColumnRenamed("chunk_id", "item_id"), overfetch).drop("rank").withColumnRenamed("item_id", "chunk_id")
    pooled = pool_max(hits) if strategy == "max" else pool_avg_topk(hits)
    return ranked(pooled, k, item="paper_id")


def best_per_group(hits: DataFrame, group: Sequence[str], k: int, item: str = "item_id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each group by score, ties to the smaller item."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), item)
    return hits.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def filtered_neighbors(queries: DataFrame, items: DataFrame, keep: Column, k: int) -> DataFrame:
    """query_id, item_id, distance, rank: the ``k`` items nearest by cosine distance among those that ``keep``
    holds for; vectors of length 0 take no part."""
    unit = vectors.unit(F.col("vector"))
    x = items.where(keep & (vectors.norm(F.col("vector")) > 0)).select("item_id", unit.alias("vector"))
    q = queries.where(vectors.norm(F.col("vector")) > 0).select("query_id", unit.alias("vector"))
    return dense_topk(q, x, k).select("query_id", "item_id", (1 - F.col("score")).alias("distance"), "rank")


def pool_mean_vectors(pages: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key over its non-null page vectors; keys without one are left out, and
    numbers beyond the shortest vector of a key as well. Sums are arrays that are added up map-side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = pages.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    short = x.groupBy(key).agg(F.min(F.size(vector)).alias("_n"))
    x = x.join(short, key).select(key, array_to_vector(F.slice(F.col(vector).cast("array<double>"), F.lit(1), F.col("_n"))).alias(vector))
    return x.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col(vector))).alias(vector))
