import numpy as np

from folioforge.llm import splitting as S

SCHEMA = "item_kind string, item_id string, part string, row_no int, text string"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def pieces(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in S.split_items(df, **kw).orderBy("item_id", "piece_no").collect():
        out.setdefault(r.item_id, []).append(r)
    return out


def test_whole_and_split_items(spark):
    got = pieces(spark, [("p", "short", "a", 0, words(512)), ("p", "long", "a", 0, words(513)), ("p", "none", "a", 0, " \0 "), ("p", "null", "a", 0, None)])
    assert [(r.token_count, r.overlap_tokens) for r in got["short"]] == [(512, 0)]
    assert len(got["long"]) == 2 and got["long"][1].overlap_tokens == 128 and set(got) == {"short", "long"}


def test_round_trip_over_rows_blocks_and_grid(spark, rng):
    rows, texts = [], {}
    for item in range(4):
        parts = []
        for n in range(40):
            sentence = [words(rng.randrange(0, 60), rng.randrange(1000)) + rng.choice([". ", "\n", "\n\n", " ", "。\n"]) for _ in range(rng.randrange(12))]
            parts.append("".join(sentence))
            rows.append(("p", f"i{item}", f"f{n % 3}", n, parts[-1]))
        order = sorted((f"f{n % 3}", n, t) for n, t in enumerate(parts))
        texts[f"i{item}"] = " ".join(t for *_, t in order).split()
    got = pieces(spark, rows + rows[:20], block_tokens=700)
    for item, tokens in texts.items():
        back = []
        for r in got[item]:
            mine = r.text.split()
            assert len(mine) == r.token_count <= 512
            assert r.overlap_tokens == (min(128, len(back)) if r.piece_no else 0)
            assert back[len(back) - r.overlap_tokens :] == mine[: r.overlap_tokens]
            back += mine[r.overlap_tokens :]
        assert back == tokens


def test_cuts_do_not_depend_on_the_block_size(spark, rng):
    rows = [("p", "i", "f", n, "".join(words(rng.randrange(5, 60)) + rng.choice([". ", "\n", "\n\n", " "]) for _ in range(30))) for n in range(12)]
    rows.append(("p", "one", "f", 0, words(9000)))
    whole, cut = pieces(spark, rows), pieces(spark, rows, block_tokens=600)
    assert {k: [(r.piece_no, r.text, r.token_count) for r in v] for k, v in whole.items()} == {k: [(r.piece_no, r.text, r.token_count) for r in v] for k, v in cut.items()}
    assert len(whole["i"]) > 10


def test_prefers_headings_then_paragraphs_then_sentences(spark):
    text = words(250) + ". " + words(30, 300) + "\n\n" + words(20, 400) + "\n## Head\n" + words(300, 500)
    first = pieces(spark, [("p", "x", "a", 0, text)])["x"][1]
    assert first.text.split()[128] == "##"


def test_no_boundary_cuts_at_the_middle(spark):
    got = pieces(spark, [("p", "x", "a", 0, words(700))])["x"]
    assert [r.token_count - r.overlap_tokens for r in got] == [350, 350]


def test_white_space_is_the_unicode_property():
    cp = S.code_points("a​b c　d\u001ce\u0085f\0g")
    starts, ends = S.token_spans(cp)
    assert len(starts) == 4
    assert S.token_spans(S.code_points(""))[0].size == 0


def test_counts_agree_with_the_jvm(spark, rng):
    chars = "ab.​ 　\u001c\u0085\0  \n\t"
    texts = ["".join(rng.choice(chars) for _ in range(60)) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    got = df.select("t", S.n_tokens(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else len(S.token_spans(S.code_points(r.t))[0])) for r in got)


def test_bisection_bounds(rng):
    for _ in range(50):
        n = rng.randrange(1, 5000)
        at = np.unique(np.array([rng.randrange(1, n + 1) for _ in range(rng.randrange(0, 80))], dtype=np.int64))
        cores = sorted(S.bisect(0, n, at, np.ones(len(at), np.int64), 384, 512))
        assert cores[0][0] == 0 and cores[-1][1] == n and all(a[1] == b[0] for a, b in zip(cores, cores[1:]))
        assert all(b - a <= (512 if a == 0 else 384) for a, b in cores)


def test_empty_and_clashing_columns(spark):
    assert pieces(spark, []) == {}
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("p", "x", "a", 0, words(600))], SCHEMA).withColumn("cell", F.lit(7)).withColumn("n_tokens", F.lit(7)).withColumn("start", F.lit(7))
    assert S.split_items(df).count() == 2


def test_chunks_by_their_own_count(spark):
    df = spark.createDataFrame([("c1", words(600), 3), ("c1", words(600), 3), ("c2", words(5), 900), ("c3", None, 900)], "chunk_id string, text string, token_count int")
    plan = S.plan_pieces(S.placed_rows(S.row_profiles(S.chunk_rows(df))))
    assert {(r.item_kind, r.item_id) for r in plan.collect()} == {("chunk", "c1")}
