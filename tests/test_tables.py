import datetime as dt

from pyspark.sql import functions as F

from folioforge.operators import chunking, dedupe, notes, queue, store
from folioforge.sources import readers, writers

Q = "id long, query_key string, retrieval_rank int, review_status string, review_label string, parse_status string, review_payload string, updated_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def q(spark, rows):
    base = dict(id=0, query_key="k", retrieval_rank=1, review_status="pending", review_label=None, parse_status="pending", review_payload=None, updated_at=T0)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], Q)


def test_canonical_rows(spark):
    df = q(spark, [dict(id=1, review_status="pending", updated_at=T0 + dt.timedelta(1)), dict(id=2, review_status="completed"), dict(id=3, retrieval_rank=2), dict(id=4, retrieval_rank=2, review_payload="{}")])
    assert sorted(r.id for r in queue.canonical_rows(df).collect()) == [2, 4]


def test_budgets(spark):
    done = [dict(id=i, review_status="completed", review_label="hard_negative") for i in range(10)]
    df = q(spark, done + [dict(id=50), dict(id=60, query_key="free")])
    assert [r.id for r in queue.claim_within_budget(df, 10).collect()] == [60]
    closed = {r.id: (r.review_status, r.review_label) for r in queue.close_satisfied(df).collect()}
    assert closed[50] == ("completed", "ignored") and closed[60] == ("pending", None) and len(closed) == 12
    assert queue.claim_with_minimum(df, "pending", 99, least=11).count() == 11
    assert queue.claim_within_budget(df.where("false"), 5).count() == 0


def test_lease_is_strict(spark):
    df = q(spark, [dict(id=1, review_status="processing"), dict(id=2, review_status="processing", updated_at=T0 - dt.timedelta(seconds=1)), dict(id=3, review_status="processing", updated_at=None)])
    at = F.lit(T0 + dt.timedelta(seconds=600))
    assert {r.id: r.review_status for r in queue.reset_stale(df, at, 600).collect()} == {1: "processing", 2: "pending", 3: "processing"}


def test_early_stop_and_status_counts(spark):
    df = q(spark, [dict(id=i, retrieval_rank=i, review_label=v) for i, v in enumerate(["x", "hard_negative", "x", "hard_negative", "x"])])
    assert sorted(r.id for r in queue.early_stop(df, "query_key", "retrieval_rank", "review_label", 2).collect()) == [0, 1, 2, 3]
    assert {r.review_status: r.n for r in queue.status_counts(df, "review_status", ("pending", "failed")).collect()} == {"pending": 5, "failed": 0}


def test_upsert_is_idempotent_and_protects(spark):
    base = spark.createDataFrame([(1, "a", "done"), (2, "b", None), (None, "n", "x")], "k int, v string, s string")
    batch = spark.createDataFrame([(2, None, "new"), (3, "c", "new"), (None, "m", "y")], "k int, v string, s string")
    once = store.upsert(base, batch, ["k"], protected=["s"])
    expected = {(1, "a", "done"), (2, None, None), (3, "c", "new"), (None, "m", "x")}
    assert {tuple(r) for r in once.collect()} == expected
    assert {tuple(r) for r in store.upsert(once, batch, ["k"], protected=["s"]).collect()} == expected
    ignored = store.insert_ignore(base, batch.where("k IS NOT NULL"), ["k"])
    assert {tuple(r) for r in ignored.collect()} == {(1, "a", "done"), (2, "b", None), (None, "n", "x"), (3, "c", "new")}
    assert store.delete_keys(base, batch, ["k"]).count() == 2
    back = store.write_back(base, batch.select("k", "v").where("k = 2"), ["k"], ["v"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in base.collect()}


def test_windows(spark):
    df = spark.createDataFrame([(n, [str(i) for i in range(n)], 5) for n in (0, 1, 512, 513, 896, 897)] + [(-1, None, 5)], "n int, t array<string>, start int")
    got = {}
    for r in chunking.token_windows(df.drop("start"), F.col("t")).collect():
        got.setdefault(r.n, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 1)], 512: [(0, 512)], 513: [(0, 512), (384, 513)], 896: [(0, 512), (384, 896)], 897: [(0, 512), (384, 896), (768, 897)]}


def test_note_kinds(spark):
    cases = [("Response_to_Review", [], "rebuttal"), ("Official_Review", [], "review"), ("Meta_Review", [], "meta_review"), ("", ["Decision"], "decision"), (None, ["strengths"], "review"), (None, None, "other"), ("x/Comment", [], "comment")]
    df = spark.createDataFrame(cases, "inv string, ks array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", notes.note_kind(F.col("inv"), F.col("ks")).alias("got")).collect())


def test_feedback_round_trip(spark):
    rows = spark.createDataFrame([(1, "q", "r", "human_like", "no", T0), (2, "q", "r", "human_like", "yes", T0), (3, "q", "r", "cand_01", "correct", T0)], "id long, query_id string, reviewer string, feedback_item_id string, judgement string, updated_at timestamp")
    items = notes.feedback_payload(rows, ["query_id", "reviewer"]).first()["items"]
    assert items == {"human_like": "yes", "cand_01": "correct"}


def test_query_records(spark):
    rows = spark.createDataFrame([(1, "a", None, "t", "p", "bad"), (2, "a", None, "t2", "p.docling", "method"), (3, None, "a", "t3", "p", "method"), (4, None, None, "t4", " p ", "experiment"), (5, "b", None, " ", "p", "method")],
                                 "pos int, query_id string, id string, query_text string, target_paper_id string, aspect_group string")
    got = {(r.query_id, r.query_text, r.target_paper_id, r.aspect_group) for r in readers.query_records(rows, "pos").collect()}
    assert got == {("a", "t2", "p", "method"), ("line-000004", "t4", "p", "experiment/result")}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb, \"c\"", None), ("2", "é", "x")], "id string, t string, u string")
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert {tuple(r) for r in readers.jsonl(spark, str(tmp_path / "j"), "id string, t string, u string").collect()} == {tuple(r) for r in df.collect()}
    (tmp_path / "x.tsv").write_text("id\tt\tu\n1\ta\n2\tb\tc\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "x.tsv"), ["id", "t", "u"]).collect()] == [("1", "a", ""), ("2", "b", "c")]
    writers.write_json({"a": "é"}, str(tmp_path / "m.json"))
    assert "é" in (tmp_path / "m.json").read_text(encoding="utf-8")
    (tmp_path / "full_text").mkdir()
    (tmp_path / "full_text" / "b.jsonl").write_text("")
    assert readers.shards(spark, str(tmp_path), "full_text") == [str(tmp_path / "full_text" / "b.jsonl")]
    assert readers.existing_query_paths(spark, str(tmp_path / "none"), [str(tmp_path / "m.json"), "/nowhere"]) == [str(tmp_path / "m.json")]


def test_corpus_and_sets(spark):
    rows = spark.createDataFrame([("f", "p.docling", "b", "s1", 2), ("f", "p", "a", "s1", 1), ("f", "p", " ", "s1", 3), ("f", "e", None, "s1", 1), ("f", " ", "x", "s1", 1)], "representation_type string, paper_id string, text string, source_path string, row_no int")
    assert [(r.paper_id, r.text) for r in readers.corpus_papers(rows, ["source_path", "row_no"]).collect()] == [("p", "a\n\nb")]
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "g string, m int")
    assert [r.g for r in dedupe.contains_all(a, a.where("NOT (g = 'x' AND m = 2)"), "g", "m").collect()] == ["y"]
    assert sorted(tuple(r) for r in dedupe.first_place_last_value(a.withColumn("v", F.col("m") * 10), ["g"], "m", ["v"]).collect()) == [("x", 1, 20), ("y", 1, 10)]
