from folioforge.llm import matching as M

SCHEMA = "sid string, title string, authors array<string>, year int, ids string"
PAPERS = [
    ("p1", "Alphanet: Sparse Kernels for Code Search", ["Ann B. Carver", "Dan Öhm"], 2020, "https://x.example/pdf/2001.12345v2"),
    ("p2", "Alphanet-2: Sparse Kernels for Code Search", ["Ann B. Carver", "Dan Öhm"], 2021, None),
    ("p3", "On the Limits of Dense Retrieval in Practice", ["Eve Fox"], 2019, None),
    ("p4", "On the Limits of Dense Retrieval in Practice", ["Gil Hart", "Ida Jones"], 2023, None),
    ("p5", "Kappa: Robust Planners for Map Matching", ["Kim Lund"], 2022, None),
    ("p5", "Kappa: Robust Planners for Map Matching ", ["Kim Lund"], 2022, None),
]
LISTINGS = [
    ("1", "[PDF] ALPHANET: SPARSE KERNLES FOR CODE SEARCH (preprint)", ["carver a", "ohm d"], 2020, None, "p1"),
    ("2", "Alphanet 2 — Sparse Kernels 4 Code Search", ["A. B. Carver, D. Ohm"], None, None, "p2"),
    ("3", "Sparse Kernels for Code …", ["Carver, Ann B.", "Öhm, Dan"], 2020, "arXiv:2001.12345", "p1"),
    ("4", "on the limits of dense retrieval in practice", ["E. Fox"], 2019, None, "p3"),
    ("5", "On the Limits of Dense Retrieval in Practice", ["G. Hart", "..."], 2023, None, "p4"),
    ("6", "On the Limits of Dense Retrieval in Practice", ["Zed Young"], 2012, None, None),
    ("7", "Kappa: Robust Planners for Map Matching at Scale, Revisited", ["Kim Lund"], 2022, None, None),
    ("8", "Kappa: Robust Planners for Map&nbsp;Matching", None, 2022, None, "p5"),
    ("9", None, None, None, None, None),
    ("10", "", [], 0, "", None),
    (None, "Kappa: Robust Planners for Map Matching", ["Kim Lund"], 2022, None, None),
]


def test_variants_sequels_and_namesakes(spark):
    left = spark.createDataFrame([r[:5] for r in LISTINGS], SCHEMA)
    right = spark.createDataFrame(PAPERS, SCHEMA)
    got = {r.lid: (r.rid, r.confidence) for r in M.match(left, right).collect()}
    assert {k: v[0] for k, v in got.items()} == {r[0]: r[5] for r in LISTINGS if r[5]}
    assert all(0.5 <= c <= 1 for _, c in got.values())


def test_copies_share_the_result_and_empty_sides(spark):
    row = ("p", "Kappa: Robust Planners for Map Matching", ["Kim Lund"], 2022, None)
    left = spark.createDataFrame([("a", *row[1:]), ("b", *row[1:]), ("b", *row[1:])], SCHEMA)
    right = spark.createDataFrame([row], SCHEMA)
    assert sorted((r.lid, r.rid) for r in M.match(left, right).collect()) == [("a", "p"), ("b", "p")]
    assert M.match(left.where("false"), right).count() == 0 and M.match(left, right.where("false")).count() == 0


def test_hot_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_KEY", 3)
    monkeypatch.setattr(M, "SALT_ROWS", 2)
    title = ["Ka", "Robust Planners for Map Matching"]
    left = spark.createDataFrame([(str(i), f"{title[0]}{'p' * (i % 2 + 1)}a: {title[1]}", ["Kim Lund"], 2000 + i, None) for i in range(20)], SCHEMA)
    right = spark.createDataFrame([("r", "Kappa: Robust Planners for Map Matching", ["Kim Lund"], 2022, None)], SCHEMA)
    L, R = M.normalised(left), M.normalised(right)
    assert {(r.lid, r.rid) for r in M.candidate_pairs(L, R).collect()} == {(str(i), "r") for i in range(20)}


PAIRS = "lid string, rid string, entity long, prior double"


def test_one_to_one_messages(spark):
    """A listing is one work; a work is one listed entity, whose listings don't compete."""
    pairs = spark.createDataFrame([("a", "x", 0, 3.0), ("a", "y", 0, 1.0), ("b", "y", 0, 2.0)], PAIRS)
    got = {(r.lid, r.rid): r.confidence for r in M.propagate(pairs).collect()}
    assert got["a", "x"] > 0.8 > 0.2 > got["a", "y"] and abs(got["b", "y"] - 1 / (1 + 2.718281828**-2)) < 0.01
    rivals = spark.createDataFrame([("a", "x", 0, 4.0), ("b", "x", 7, 1.0), ("c", "x", 0, 4.0), ("d", "x", 8, 3.0), ("e", "x", 8, 2.0), ("f", "z", 9, 1.0)], PAIRS)
    rows = M.propagate(rivals).collect()
    got = {r.lid: r.confidence for r in rows}
    assert max(got[k] for k in "bde") < 0.3 < 0.6 < min(got["a"], got["c"]) and all(r.settled for r in rows)
    assert abs(got["f"] - 1 / (1 + 2.718281828**-1)) < 1e-6


def test_a_run_that_is_cut_off_says_so(spark):
    pairs = spark.createDataFrame([("a", "x", 0, 3.0), ("a", "y", 0, 2.5), ("b", "y", 1, 2.0), ("c", "z", 0, 1.0)], PAIRS)
    assert {(r.lid, r.rid): r.settled for r in M.propagate(pairs, rounds=1).collect()} == {("a", "x"): False, ("a", "y"): False, ("b", "y"): False, ("c", "z"): True}
    assert M.propagate(pairs.where("false")).count() == 0


def test_other_scripts_old_ids_and_works_without_names(spark):
    right = spark.createDataFrame([
        ("p1", "稀疏核方法在代码搜索中的应用", ["王小明", "李雷"], 2021, None), ("p2", "稠密检索的极限", ["王小明"], 2020, None), ("p3", "Разреженные ядра для поиска кода", ["Иван Петров", "Анна Смирнова"], 2019, None),
        ("p4", "Sparse Kernels in Practice", [], 2001, None), ("p5", "Planning with Kernels", ["Kim Lund"], 2001, "x/abs/cs/0112017"), ("p6", "Sørensen Bounds for Łukasz Games", ["Ida Sørensen"], 2010, None),
    ], SCHEMA)
    left = spark.createDataFrame([
        ("1", "稀疏核方法在代码搜索中的应用。", ["王小明", "李雷"], 2021, None), ("2", "稠密检索的极限", ["王小明"], None, None), ("3", "РАЗРЕЖЕННЫЕ ЯДРА для поиска кода", ["И. Петров", "А. Смирнова"], 2019, None),
        ("4", "Sparse kernels in practice", ["Kim Lund", "Ann Oz"], 2001, None), ("5", "Planning with Kernels [v2]", None, None, "cs/0112017"), ("6", "Sorensen bounds for Lukasz games", ["I. Sorensen"], 2010, None),
        ("7", "量子网络综述", ["王小明", "李雷"], 2021, None),
    ], SCHEMA)
    assert {(r.lid, r.rid) for r in M.match(left, right).collect()} == {(str(i), f"p{i}") for i in range(1, 7)}


def test_marginals_of_one_factor_are_exact(spark, close):
    import math

    pairs = spark.createDataFrame([("a", "x", 0, 1.0), ("a", "y", 0, 0.5), ("a", "z", 0, -1.0)], PAIRS)
    got = {r.rid: r.confidence for r in M.propagate(pairs, rounds=40, tolerance=1e-9).collect()}
    total = 1 + sum(math.exp(p) for p in (1.0, 0.5, -1.0))
    assert all(abs(got[k] - math.exp(p) / total) < 1e-6 for k, p in (("x", 1.0), ("y", 0.5), ("z", -1.0)))


def test_names_and_titles():
    assert M.surnames(["A. B. Carver", "Öhm, Dan", "lund k", "...", "et al."]) == ["carver", "lund", "ohm"]
    assert M.surnames(["V. Zalus, K. Skar, D. H. Zhal"]) == ["skar", "zalus", "zhal"] and M.surnames(None) == []
    assert M.title_parts("  “Name: A Title II…")[:4] == ("nameatitle2", "atitle2", "name", True) and M.title_parts(None)[0] == ""


def test_cut_titles_with_one_whole_word_or_none(spark):
    names = ["Ann B. Carver", "Dan Öhm", "Eve Fox"]
    right = spark.createDataFrame([
        ("p1", "On the Expressivity of Sparse Kernels", names, 2020, None), ("p2", "Generalization without Labels in Practice", ["Gil Hart"], 2021, None),
        ("p3", "Alphanet: Transferability of Sparse Planners", ["Kim Lund"], 2022, None), ("p4", "Expressivity of Towers", ["Ida Jones"], 2020, None),
    ], SCHEMA)
    left = spark.createDataFrame([
        ("1", "On the Expressivity of Sp…", ["A Carver", "D Öhm", "E Fox"], 2020, None), ("2", "Generaliz…", ["G. Hart"], 2021, None), ("3", "Transferab...", ["K. Lund"], 2022, None),
        ("4", "On the Expressivity of Sparse K…", None, 2020, None), ("5", "On the Expressivity of Sp…", ["Zed Young"], 2020, None),
    ], SCHEMA)
    got = {(r.lid, r.rid) for r in M.match(left, right).collect()}
    assert got == {("1", "p1"), ("2", "p2"), ("3", "p3"), ("4", "p1")}
