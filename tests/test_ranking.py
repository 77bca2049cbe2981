from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import evaluation, indexes, ranking

Q_SCHEMA, X_SCHEMA = "query_id long, vector array<float>", "item_id long, vector array<float>"


def vectors(seed, n, dim=8):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def rows(m):
    return [(i, [float(x) for x in v]) for i, v in enumerate(m)]


def test_dense_topk_against_brute_force_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ranking, "ITEM_BLOCK", 40)
    q, x = vectors(1, 10), vectors(2, 200)
    got = ranking.dense_topk(spark.createDataFrame(rows(q), Q_SCHEMA), spark.createDataFrame(rows(x), X_SCHEMA), 7).collect()
    u = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u(q) @ u(x).T
    expected = {(i, int(j), r + 1) for i in range(10) for r, j in enumerate(np.argsort(-s[i])[:7])}
    assert {(r.query_id, r.item_id, r["rank"]) for r in got} == expected


def test_dense_topk_edge_rows(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], Q_SCHEMA)
    x = spark.createDataFrame([(9, [2.0, 0.0]), (4, [1.0, 0.0]), (1, [1.0, 0.0]), (5, None)], X_SCHEMA)
    got = [(r.query_id, r.item_id, r["rank"], r.score) for r in ranking.dense_topk(q, x, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1.0), (1, 4, 2, 1.0), (3, 1, 1, 0.0), (3, 4, 2, 0.0)]  # ties: smaller id
    assert ranking.dense_topk(q, x, 5, exclude_self=True).where("query_id = 1 AND item_id = 1").count() == 0
    assert ranking.dense_topk(q.where("false"), x, 2).count() == 0 and ranking.dense_topk(q, x.where("false"), 2).count() == 0


def test_pooling_fixture(spark):
    hits = spark.createDataFrame([("q", c, p, s) for c, p, s in ((1, "P", 0.9), (2, "P", 0.1), (3, "P", 0.2), (4, "P", 0.8), (5, "Q", 0.7))], "query_id string, chunk_id int, paper_id string, score double")
    order = lambda s: [(r.paper_id, round(r.score, 4)) for r in ranking.pooled_ranking(hits, s, 5).orderBy("rank").collect()]
    assert order("max") == [("P", 0.9), ("Q", 0.7)] and order("avg") == [("Q", 0.7), ("P", 0.6333)]
    few = ranking.pooled_ranking(hits, "avg", 5, overfetch=2).orderBy("rank").collect()
    assert [(r.paper_id, round(r.score, 4)) for r in few] == [("P", 0.85)]


def test_exhaustive_pooling_with_hot_paper(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ITEM_BLOCK", 30)
    x, q = vectors(3, 150), vectors(4, 5)
    paper = [0 if i < 90 else i // 4 for i in range(150)]
    chunks = spark.createDataFrame([(i, p, [float(v) for v in m]) for i, (p, m) in enumerate(zip(paper, x))], "chunk_id long, paper_id long, vector array<float>")
    u = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u(q) @ u(x).T
    for strategy in ("max", "avg"):
        got = ranking.dense_pooled_topk(spark.createDataFrame(rows(q), Q_SCHEMA), chunks, 6, strategy).collect()
        for i in range(5):
            by = {}
            for j, p in enumerate(paper):
                by.setdefault(p, []).append(s[i, j])
            pool = {p: max(v) if strategy == "max" else np.mean(sorted(v)[-3:]) for p, v in by.items()}
            best = sorted(pool, key=lambda p: (-pool[p], p))[:6]
            assert [r.paper_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == best


def test_bm25_hand_made(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "item_id long, text string")
    queries = spark.createDataFrame([("x", "B zzz"), ("y", None)], "query_id string, text string")
    got = {(r.query_id, r.item_id): r.score for r in ranking.bm25_topk(queries, docs, 5).collect()}
    avg, idf = 5 / 4, np.log(1 + (4 - 2 + 0.5) / (2 + 0.5))
    weight = lambda tf, dl: tf / (tf + 0.9 * (0.6 + 0.4 * dl / avg))
    assert set(got) == {("x", 1), ("x", 2)}
    assert abs(got["x", 1] - idf * weight(2, 3)) < 1e-9 and abs(got["x", 2] - idf * weight(1, 2)) < 1e-9
    assert ranking.bm25_topk(queries, docs.where("false"), 5).count() == 0


def test_metrics_fixture(spark):
    rows_ = [("a1", "A", "motivation", 1), ("a2", "A", "method", 7), ("b1", "B", "motivation", 3), ("b2", "B", "experiment/result", None), ("c1", "C", "method", 5)]
    df = spark.createDataFrame(rows_, "query_id string, target_paper_id string, aspect_group string, target_rank int")
    m = {r.metric: round(r.value, 4) for r in evaluation.aspect_metrics(df).collect()}
    assert (m["AnyAspect@5"], m["AllAspect@5"], m["AspectCoverage@5"]) == (1.0, 0.3333, 0.6667)
    assert (m["Motivation R@5"], m["Method R@5"], m["Experiment/Result R@5"], m["query_count"], m["paper_count"]) == (1.0, 0.5, 0.0, 5, 3)
    assert all(m[f"AnyAspect@{k}"] >= m[f"AspectCoverage@{k}"] >= m[f"AllAspect@{k}"] for k in (5, 20))
    assert {r.value for r in evaluation.aspect_metrics(df.where("false")).collect()} == {0.0}


def test_target_rank_takes_the_first_hit(spark):
    q = spark.createDataFrame([("q", "p", "method"), ("r", "p", "method")], "query_id string, target_paper_id string, aspect_group string")
    hits = spark.createDataFrame([("q", "p", 4), ("q", "p", 2), ("z", "p", 1)], "query_id string, paper_id string, rank int")
    assert {r.query_id: r.target_rank for r in evaluation.target_ranks(q, hits).collect()} == {"q": 2, "r": None}


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", None), ("b", None)], "k string, v array<float>")
    assert [(r.k, r.v) for r in ranking.pool_mean_vectors(df, "k", "v").collect()] == [("a", [2.0, 3.0])]


def test_index_search_against_every_pair_in_small_blocks(spark, tmp_path, monkeypatch):
    for name, value in {"POSTINGS": 900, "QUERY_TERMS": 60, "STRIP": 64, "LEVELS": 3}.items():
        monkeypatch.setattr(ranking, name, value)
    random = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(random.choice(words, n, p=np.arange(30, 0, -1) / 465))
    docs = [(f"d{i:03d}", text(random.integers(1, 12))) for i in range(300)]
    again = " ".join(["w29"] * len(docs[0][1].split()))  # an id that comes twice is one item; its length is that of either row
    docs += [("empty", ""), ("null", None), ("d000", again), (None, "w2 w3")]
    queries = [(i, text(random.integers(1, 9))) for i in range(40)] + [(40, "unknown"), (41, None), (None, "w1 w1 w2")]
    indexes.save_bm25_index(spark.createDataFrame(docs, "item_id string, text string"), str(tmp_path))
    tf, length = Counter(), Counter()
    for d, t in docs:
        tf.update((d, w) for w in (t or "").split())
        length[d] = len((t or "").split())
    df = Counter(w for _, w in tf)
    avg, n = sum(tf.values()) / len(docs), len(docs)
    for k in (4, 400):
        found = indexes.bm25_search(spark, str(tmp_path), spark.createDataFrame(queries, "query_id long, text string"), k, decimals=8).collect()
        got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in found}
        expected = {}
        for q, t in queries:
            scores = Counter()
            for w, f in Counter((t or "").split()).items():
                for d in [d for d, x in tf if x == w]:
                    c = tf[d, w]
                    scores[d] += f * np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c / (c + 0.9 * (0.6 + 0.4 * length[d] / avg))
            first = sorted(((-round(float(s), 8), d is not None, d or "") for d, s in scores.items()))[:k]
            expected |= {(q, r): (d if some else None, -s) for r, (s, some, d) in enumerate(first, 1)}
        assert got.keys() == expected.keys()
        assert all(got[x][0] == expected[x][0] and abs(got[x][1] - expected[x][1]) < 2e-8 for x in got)


def test_index_search_keeps_pairs_out_of_rows(spark, tmp_path):
    """Every query matches every document: half a million pairs, of which no stage may write even a tenth."""
    docs = spark.range(2000).select(F.col("id").alias("item_id"), F.concat(F.lit("a b c w"), F.col("id") % 50).alias("text"))
    queries = spark.range(250).select(F.col("id").alias("query_id"), F.concat(F.lit("a b c w"), F.col("id") % 50).alias("text"))
    indexes.save_bm25_index(docs, str(tmp_path))
    found = indexes.bm25_search(spark, str(tmp_path), queries, 5, decimals=8)
    assert found.count() == 1250 and {r.item_id % 50 for r in found.where("query_id = 57").collect()} == {7}
    assert found.where("query_id = 57 AND rank = 1").first().item_id == 7
    found.collect()
    rows, plans = [], [found._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if plan.metrics().contains("numOutputRows"):
            rows.append(plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
    assert rows and max(rows) < 50_000


def test_index_search_without_documents_or_queries(spark, tmp_path):
    docs, queries = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    for d, q, rows in ((docs, queries, 1), (docs.where("false"), queries, 0), (docs.where("text IS NULL"), queries, 0), (docs, queries.where("false"), 0)):
        indexes.save_bm25_index(d, str(tmp_path))
        assert indexes.bm25_search(spark, str(tmp_path), q, 3).count() == rows
