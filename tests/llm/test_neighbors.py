import numpy as np

from folioforge.llm import neighbors as N

SCHEMA_Q, SCHEMA_X = "query_id string, vector array<float>", "item_id string, vector array<float>"


def rows(prefix, m):
    return [(f"{prefix}{i:05d}", [float(x) for x in v]) for i, v in enumerate(m)]


def clustered(seed, n, dim=16, clusters=40):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dim))
    return centers[r.integers(0, clusters, n)] + 0.25 * r.normal(size=(n, dim))


def brute(q, x, k):
    s = N._unit(q) @ N._unit(x).T
    return {(f"q{i:05d}", f"x{j:05d}") for i in range(len(q)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_recall_and_exact_similarity(spark):
    x, q = clustered(1, 4000), clustered(1, 60)
    Q, X = spark.createDataFrame(rows("q", q), SCHEMA_Q), spark.createDataFrame(rows("x", x), SCHEMA_X)
    got = N.nearest(Q, X, 16, 10, candidates=800).collect()
    assert len({(r.query_id, r.item_id) for r in got} & brute(q, x, 10)) >= 0.95 * 600
    s = N._unit(q) @ N._unit(x).T
    assert all(abs(r.similarity - s[int(r.query_id[1:]), int(r.item_id[1:])]) < 1e-6 for r in got)


def test_hot_cell_is_split_and_lossless(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_ROWS", 50)
    monkeypatch.setattr(N, "SHARE_ROWS", 5)
    x = np.vstack([clustered(2, 300), np.tile(clustered(3, 1), (400, 1))])
    q = clustered(3, 20)
    Q, X = spark.createDataFrame(rows("q", q), SCHEMA_Q), spark.createDataFrame(rows("x", x), SCHEMA_X)
    got = N.nearest(Q, X, 16, 5, candidates=10_000).collect()
    assert len(got) == 100 and {(r.query_id, r.rank) for r in got} == {(f"q{i:05d}", k) for i in range(20) for k in range(1, 6)}
    s = N._unit(q) @ N._unit(x).T
    best = -np.sort(-s, axis=1)[:, 4]
    assert all(r.similarity >= best[int(r.query_id[1:])] - 1e-6 for r in got)


def test_unusable_vectors_repeats_and_threshold(spark):
    good = [1.0] + [0.0] * 15
    bad = [None, [], [0.0] * 16, [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    X = spark.createDataFrame([(f"b{i}", v) for i, v in enumerate(bad)] + [("a", [0.5, 0.1] + [0.0] * 14), ("a", [300.0] + [0.0] * 15), ("c", [0.0, 1.0] + [0.0] * 14), (None, good)], SCHEMA_X)
    Q = spark.createDataFrame([("q", good), ("q", good), ("z", [0.0] * 16), ("n", None), (None, good)], SCHEMA_Q)
    got = N.nearest(Q, X, 16, 10, 0.9).collect()
    assert [(r.query_id, r.item_id, round(r.similarity, 9), r.rank) for r in got] == [("q", "a", 1.0, 1)]


def test_empty_sides(spark):
    Q, X = spark.createDataFrame([("q", [1.0] * 16)], SCHEMA_Q), spark.createDataFrame([("x", [1.0] * 16)], SCHEMA_X)
    assert N.nearest(Q, X.where("false"), 16).count() == 0 and N.nearest(Q.where("false"), X, 16).count() == 0


def test_walk_visits_cells_in_order():
    r = np.random.default_rng(0)
    d1, d2 = r.random(12), r.random(12)
    order, last = N.visit_order(d1, d2, np.ones((12, 12), int), 10**9)
    sums = [d1[i] + d2[j] for i, j in order]
    assert len(order) == len(set(order)) == 144 and sums == sorted(sums)
    counts = np.zeros((12, 12), int)
    counts[3, 4] = 2
    assert N.visit_order(d1, d2, counts, 5)[0] == [(3, 4)]


def test_threshold_is_exact_beside_a_cell_of_copies(spark):
    r = np.random.default_rng(4)
    centers = r.normal(size=(30, 16))
    x = centers[r.integers(0, 30, 900)] + 0.3 * r.normal(size=(900, 16))
    q = x[:40] + 0.1 * r.normal(size=(40, 16))
    copies = [("copy", [float(v) for v in q[0]])] * 6000
    Q, X = spark.createDataFrame(rows("q", q), SCHEMA_Q), spark.createDataFrame(rows("x", x) + copies, SCHEMA_X)
    got = {(g.query_id, g.item_id) for g in N.nearest(Q, X, 16, 2000, 0.9, candidates=1).collect() if g.item_id != "copy"}
    s = N._unit(q) @ N._unit(x).T
    assert got == {(f"q{i:05d}", f"x{j:05d}") for i, j in zip(*np.nonzero(s >= 0.9))}


def test_budget_counts_different_items(spark):
    x = clustered(6, 300)
    copies = [("copy", [float(v) for v in x[0]])] * 3000
    Q, X = spark.createDataFrame(rows("q", x[:1]), SCHEMA_Q), spark.createDataFrame(rows("x", x) + copies, SCHEMA_X)
    assert N.nearest(Q, X, 16, 200, candidates=250).count() == 200


def test_item_with_many_vectors_takes_one_place(spark):
    r = np.random.default_rng(8)
    q = r.normal(size=(1, 16))
    many = [("many", [float(v) for v in row]) for row in q + 0.01 * r.normal(size=(60, 16))]
    x = q + 0.2 * r.normal(size=(30, 16))
    Q, X = spark.createDataFrame(rows("q", q), SCHEMA_Q), spark.createDataFrame(many + rows("x", x), SCHEMA_X)
    got = N.nearest(Q, X, 16, 10, centroids=1).orderBy("rank").collect()
    s = (N._unit(q) @ N._unit(x).T)[0]
    assert [g.item_id for g in got] == ["many"] + [f"x{j:05d}" for j in np.argsort(-s)[:9]]


def test_best_columns_ties_and_floor():
    sim = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.3, 0.95, 0.91, 0.1]])
    assert [list(map(int, v)) for v in N.best_columns(sim, 2, None)] == [[0, 0, 1, 1], [0, 1, 2, 3]]
    assert [list(map(int, v)) for v in N.best_columns(sim, 3, 0.9)] == [[0, 1, 1], [1, 2, 3]]
