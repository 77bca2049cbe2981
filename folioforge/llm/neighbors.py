"""Most similar vectors for every query vector, by an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised with its own centroids
(fitted on a bounded sample; every distinct pair of item and vector is indexed). A cell is
a pair of centroids. For a query, cells are visited in order of the summed squared distance
of the two halves to their centroids, drawn from a heap, until the visited cells hold a
budget of different items. The budget follows from a wanted recall: for a bounded sample of
the queries the true neighbours are found by a scan, and the budget is what the walk
needs to meet all but a share of them. With a least similarity there is no budget: every
cell that can hold a vector within the distance it allows is visited, so nothing is lost.
The vectors found are reranked by exact cosine in double precision.

Distribution: a walk ends in one number, the distance of its last cell, from which the
tasks that hold the index find the query's cells again. First-half centroids are put
together to groups of ``PART_ROWS`` rows; a query goes once to every group it visits.
Centroids with more rows are split into numbered parts by id hash (queries go to every
part), and groups with many queries into numbered shares (index rows go to every share),
so one dense spot, or a third of all rows in one cell, spreads over many tasks. Only the
centroid tables, the cell counts, both bounded by the number of cells, and the sampled
queries' neighbours reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.session import cut_lineage

SAMPLE_ROWS = 20_000
#: wanted share of the true neighbours, the queries sampled to find the budget for it, and the least budget a neighbour wanted
RECALL, TRIALS, LEAST_BUDGET = 0.97, 100, 50
PART_ROWS, SHARE_ROWS = 8_000, 20_000
MAX_CENTROIDS = 512
#: distances are in single precision; bounds give way by so much
ROUNDING = 2e-3


def usable(vector: Column, dim: int) -> Column:
    """The vector has ``dim`` finite numbers that aren't all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def centroids_for(rows: int) -> int:
    """Centroids a half: a power of two near a quarter of the root of the rows, 8 to 512."""
    return int(min(MAX_CENTROIDS, max(8, 2 ** round(np.log2(max(rows, 1) ** 0.5 / 4)))))


def _unit(matrix: np.ndarray) -> np.ndarray:
    m = matrix.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow for very long vectors
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = points.astype(np.float32)
    centers = points[rng.permutation(len(points))[:k]].copy()
    if len(centers) < k:
        centers = np.vstack([centers, centers[rng.integers(0, len(centers), k - len(centers))]])
    for _ in range(rounds):
        near = _distances(points, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        full = n > 0
        centers[full] = sums[full] / n[full, None]
        if (~full).any():
            centers[~full] = points[rng.integers(0, len(points), int((~full).sum()))]
    return centers


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)[None, :]


def visit_order(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, candidates: int) -> tuple[list[tuple[int, int]], float]:
    """Cells (i, j) in order of d1[i] + d2[j], by the multi-sequence walk over a heap, until the
    occupied cells visited hold ``candidates`` rows or all cells are done. Empty cells are
    walked through but not returned. Also the last sum, which bounds the walk."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, pushed, out, held, last = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], 0, -1.0
    while heap and held < candidates:
        last, a, b = heapq.heappop(heap)
        i, j = int(o1[a]), int(o2[b])
        if counts[i, j]:
            out.append((i, j))
            held += int(counts[i, j])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(s1) and y < len(s2) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (s1[x] + s2[y], x, y))
    return out, last


def half_bounds(d: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Least distance of each query's half to each centroid's region, from its squared distances
    ``d`` to the centroids: a region ends at the planes halfway to the other centroids."""
    near = d.argmin(1)
    wide = centers.astype(np.float64)
    apart = np.sqrt(np.maximum(_distances(wide, wide), 0))[near]
    gap = d - d[np.arange(len(d)), near][:, None]
    return np.where(apart > 1e-3, np.maximum(gap, 0) / (2 * np.maximum(apart, 1e-3)), 0)


def reachable(d1: np.ndarray, d2: np.ndarray, planes1: np.ndarray, planes2: np.ndarray, far: np.ndarray, min_similarity: float) -> np.ndarray:
    """Whether the cells of one first-half centroid may hold a unit vector of at least
    ``min_similarity``, for each query (rows) and second-half centroid (columns).

    ``d1`` (a number a query) and ``d2`` are squared distances to the centroids, ``planes`` are
    ``half_bounds`` and ``far`` has the largest distance of a cell's vectors to its two
    centroids, -1 if it has none."""
    low1 = np.maximum(np.sqrt(np.maximum(d1, 0))[:, None] - far[0], planes1[:, None])
    low2 = np.maximum(np.sqrt(np.maximum(d2, 0)) - far[1], planes2)
    low1, low2 = np.maximum(low1 - ROUNDING, 0), np.maximum(low2 - ROUNDING, 0)
    return (far[0] >= 0) & (low1**2 + low2**2 <= 2 - 2 * min_similarity)


def budget_for(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, cells: list[list[tuple[int, int]]], recall: float) -> int:
    """Different items a walk must hold to meet all but 1 - ``recall`` of the neighbours, whose
    cells are listed for each query."""
    need = []
    for r, wanted in enumerate(cells):
        sums = (d1[r][:, None] + d2[r][None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        held = np.cumsum(counts.ravel()[order])
        at = np.searchsorted(sums[order], [sums[i * counts.shape[1] + j] for i, j in wanted], side="right") - 1
        need += held[at].tolist()
    return int(np.quantile(need, recall, method="higher")) if need else 0


def centroid_groups(held: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each first-half centroid, parts of each group): neighbours in number share a group
    while they hold ``part_rows`` rows together; larger ones stand alone, in parts."""
    group, parts, room = np.zeros(len(held), np.int64), [], 0
    for i, n in enumerate(held):
        if n > room:
            parts.append(max(1, int(-(-n // part_rows))))
            room = part_rows if n <= part_rows else 0
        room -= min(n, room)
        group[i] = len(parts) - 1 if parts else 0
    return group, np.array(parts or [1], np.int64)


def best_columns(sim: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest numbers of each row that are at least ``least``; ties
    to the smaller column."""
    keep = np.ones_like(sim, bool) if least is None else sim >= least
    if sim.shape[1] > k:
        keep &= sim >= -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        for row in np.flatnonzero(keep.sum(1) > k):  # ties at the last place
            keep[row, np.argsort(-sim[row], kind="stable")[k:]] = False
    return np.nonzero(keep)


def nearest(
    queries: DataFrame,
    index: DataFrame,
    dim: int,
    k: int = 10,
    min_similarity: float | None = None,
    recall: float = RECALL,
    candidates: int | None = None,
    centroids: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> DataFrame:
    """query_id, item_id, similarity, rank: for each query at most ``k`` different items by cosine.

    ``queries`` has query_id and vector, ``index`` item_id and vector; ids are strings. Rows
    with a null id or an unusable vector (null, wrong size, null or non-finite numbers, all
    zero) take no part. An item with several vectors counts once, with the most similar; so
    does a query that came several times. Ties: smaller item_id first. An empty side gives
    no rows. Extra columns are ignored. With ``min_similarity`` the result is exact; without,
    ``recall`` is the wanted share of true neighbours, as measured on ``TRIALS`` queries, unless
    ``candidates`` gives the different items that a walk must hold.
    """
    spark = index.sparkSession
    floats = T.ArrayType(T.FloatType())
    base = index.select(F.col("item_id").cast("string").alias("item_id"), F.col("vector").cast(floats).alias("vector"))
    base = cut_lineage(base.where(F.col("item_id").isNotNull() & usable(F.col("vector"), dim)).dropDuplicates(["item_id", "vector"]))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast(floats).alias("vector"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("vector"), dim)).repartition(tasks, "query_id").dropDuplicates(["query_id", "vector"])
    out_schema = "query_id string, item_id string, similarity double"

    n = base.count()
    if n == 0:
        return spark.createDataFrame([], out_schema + ", rank int")
    kc = centroids or centroids_for(n)
    # The bounded fitting sample: the rows of smallest hash, whatever the partitioning.
    sample = base.select("vector", F.xxhash64("item_id", "vector").alias("h")).orderBy("h").limit(sample_rows).toPandas()["vector"]
    fit = _unit(np.stack([np.asarray(v, np.float32) for v in sample])).astype(np.float32)
    half = dim // 2
    c1, c2 = _kmeans(fit[:, :half], kc, seed), _kmeans(fit[:, half:], kc, seed + 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = _unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32)
                i, j = _distances(u[:, :half], c1).argmin(1), _distances(u[:, half:], c2).argmin(1)
                far1, far2 = np.linalg.norm(u[:, :half] - c1[i], axis=1), np.linalg.norm(u[:, half:] - c2[j], axis=1)
                yield pdf.assign(i=i.astype(np.int32), j=j.astype(np.int32), far1=far1, far2=far2)

    placed = base.mapInPandas(assign, "item_id string, vector array<float>, i int, j int, far1 double, far2 double")
    counts, held, far = np.zeros((kc, kc), np.int64), np.zeros((kc, kc), np.int64), np.full((2, kc, kc), -1.0)
    by_item = placed.groupBy("i", "j", "item_id").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2"))
    by_cell = by_item.groupBy("i", "j").agg(F.count("*").alias("items"), F.sum("n").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2"))
    for row in by_cell.collect():  # at most kc * kc rows
        at = row["i"], row["j"]
        counts[at], held[at], far[0][at], far[1][at] = row["items"], row["n"], row["far1"], row["far2"]
    group, parts = centroid_groups(held.sum(1), PART_ROWS)

    def cell_tests(u: np.ndarray, t: np.ndarray, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """First-half centroid and the cells that each query visits: within its walk, or in reach."""
        d1, d2 = _distances(u[:, :half], c1), _distances(u[:, half:], c2)
        if min_similarity is not None:
            planes1, planes2 = half_bounds(d1, c1), half_bounds(d2, c2)
        for i in np.flatnonzero((counts > 0).any(1)) if only is None else only:
            if min_similarity is None:
                yield i, (counts[i] > 0) & (d1[:, i : i + 1] + d2 <= t[:, None])
            else:
                yield i, reachable(d1[:, i], d2, planes1[:, i], planes2, far[:, i], min_similarity)

    budget = candidates or 0
    if min_similarity is None and candidates is None:
        trial = asked.orderBy(F.xxhash64("query_id", "vector")).limit(TRIALS).toPandas()
        if len(trial):
            probes = _unit(np.stack(trial["vector"].to_numpy()))
            near = _distances(probes[:, :half].astype(np.float32), c1), _distances(probes[:, half:].astype(np.float32), c2)

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        sim = probes @ _unit(np.stack(pdf["vector"].to_numpy())).T
                        x, y = best_columns(sim, k, None)
                        yield pd.DataFrame({"q": x, "item_id": pdf["item_id"].to_numpy()[y], "i": pdf["i"].to_numpy()[y], "j": pdf["j"].to_numpy()[y], "s": sim[x, y]})

            hits = placed.mapInPandas(scan, "q int, item_id string, i int, j int, s double")
            hits = hits.groupBy("q", "item_id").agg(F.max_by(F.struct("i", "j"), "s").alias("cell"), F.max("s").alias("s"))
            true = hits.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "cell")), asc=False), 1, k).alias("top")).collect()
            cells = {r["q"]: [(c["cell"]["i"], c["cell"]["j"]) for c in r["top"]] for r in true}  # at most TRIALS * k
            budget = max(budget_for(*near, counts, [cells.get(r, []) for r in range(len(trial))], recall), LEAST_BUDGET * k)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            u = _unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32)
            t = np.full(len(u), np.inf)
            if min_similarity is None:
                d1, d2 = _distances(u[:, :half], c1), _distances(u[:, half:], c2)
                # the tasks that hold the index may round otherwise
                t = np.array([visit_order(d1[r], d2[r], counts, budget)[1] for r in range(len(u))]) + 1e-5
            to = np.zeros((len(u), len(parts)), bool)
            for i, may in cell_tests(u, t):
                to[:, group[i]] |= may.any(1)
            r, g = np.nonzero(to)
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[r], "vector": pdf["vector"].to_numpy()[r], "t": t[r], "g": g})

    visits = cut_lineage(asked.mapInPandas(visit, "query_id string, vector array<float>, t double, g int"))
    asked_at = np.zeros(len(parts), np.int64)
    for row in visits.groupBy("g").count().collect():  # at most kc rows
        asked_at[row["g"]] = row["count"]
    shares = np.maximum(1, -(-asked_at // SHARE_ROWS))
    plan = spark.createDataFrame([(i, int(group[i]), int(parts[group[i]]), int(shares[group[i]])) for i in range(kc)], "i int, g int, parts int, shares int")

    b = placed.join(F.broadcast(plan), "i")  # kc rows
    b = b.withColumn("part", F.pmod(F.xxhash64("item_id", "vector"), F.col("parts")).cast("int"))
    b = b.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("g", "part", "share", "item_id", "vector", "i", "j")
    v = visits.join(F.broadcast(plan.select("g", "parts", "shares").distinct()), "g")
    v = v.withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int"))
    v = v.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "part", "share", "query_id", "vector", "t")

    def rerank(qs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype=object), "item_id": pd.Series(dtype=object), "similarity": pd.Series(dtype=float)})
        if qs.empty or items.empty:
            return empty
        items = items.sort_values(["i", "j", "item_id"], kind="stable")
        ids = items["item_id"].to_numpy()
        m = _unit(np.stack(items["vector"].to_numpy()))
        cells, starts = np.unique(items["i"].to_numpy().astype(np.int64) * kc + items["j"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(ids))
        at = {int(c): (int(s), int(e)) for c, s, e in zip(cells, starts, ends)}
        q = _unit(np.stack(qs["vector"].to_numpy()))
        rows, cols, sims = [], [], []
        for i, may in cell_tests(q.astype(np.float32), qs["t"].to_numpy(), np.unique(cells // kc)):
            for j in np.flatnonzero(may.any(0)):
                if (cell := at.get(int(i) * kc + int(j))) is None:
                    continue
                s, e = cell
                rs = np.flatnonzero(may[:, j])
                firsts = np.flatnonzero(np.append(True, ids[s + 1 : e] != ids[s : e - 1]))
                step = max(1, 4_000_000 // (e - s))
                for lo in range(0, len(rs), step):
                    block = rs[lo : lo + step]
                    # an item counts once, by its best vector
                    sim = np.maximum.reduceat(q[block] @ m[s:e].T, firsts, axis=1)
                    x, y = best_columns(sim, k, min_similarity)
                    rows.append(block[x])
                    cols.append(s + firsts[y])
                    sims.append(sim[x, y])
        if not rows:
            return empty
        found = pd.DataFrame({"query_id": qs["query_id"].to_numpy()[np.concatenate(rows)], "item_id": ids[np.concatenate(cols)], "similarity": np.concatenate(sims)})
        found = found.sort_values(["query_id", "similarity", "item_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "item_id"])
        return found.groupby("query_id", sort=False).head(k)

    keys = ["g", "part", "share"]
    found = v.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(rerank, out_schema)
    best = found.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"))
    top = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "item_id")))
    # at most k rows from each visited group and part
    per = best.groupBy("query_id").agg(F.slice(top, 1, k).alias("top"))
    return per.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", F.col("t.item_id").alias("item_id"), (-F.col("t.s")).alias("similarity"), (F.col("pos") + 1).alias("rank")
    )


# --- exemplars and papers ------------------------------------------------------------------

MODEL, DIM = "pebble-embed-v2", 64


def exemplar_neighbors(exemplars: DataFrame, papers: DataFrame, k: int = 10, min_similarity: float | None = None, model: str = MODEL, dim: int = DIM) -> DataFrame:
    """For each example_id the most similar papers of the same embedding model."""
    q = exemplars.select(F.col("example_id").alias("query_id"), F.col("embedding").alias("vector"))
    b = papers.where(F.col("model_name") == model).select(F.col("paper_id").alias("item_id"), F.col("embedding").alias("vector"))
    found = nearest(q, b, dim, k, min_similarity)
    return found.select(F.col("query_id").alias("example_id"), F.col("item_id").alias("paper_id"), "similarity", "rank")
