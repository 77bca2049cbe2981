import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import dedupe, queue, ranking, records, reports, runs, store
from folioforge.plans.registry import spelled_out
from folioforge.sources import readers, writers


def one(spark, x, **columns):
    row = spark.createDataFrame([tuple(columns.values()) or (1,)], ", ".join(f"{c} string" for c in columns) or "a int")
    return row.select(x.alias("x")).first().x


def test_white_space_of_every_kind(spark):
    t = "\n  a 　 b\t\x1f"
    assert one(spark, tx.stripped(F.col("t")), t=t) == t.strip() == "a 　 b"
    assert one(spark, tx.collapse_spaces(F.col("t")), t=t) == " ".join(t.split())
    assert one(spark, tx.blank_to_null(F.col("t")), t="\n\t") is None
    assert one(spark, tx.aspect_view(F.col("t")), t="Method\n") == "method"
    assert spelled_out("strip(f(a, strip(b)))").count("regexp_replace") == 2


def test_lists_of_references(spark):
    for text, found in (("Figures 1 AND 2", ["Figure 1", "Figure 2"]), ("see Fig. 1and2", ["Figure 1", "Figure 2"]), ("Tables 1, 2 and A3", ["Table 1", "Table 2", "Table A3"]), ("Eq. (3)-(4)", ["Equation 3"])):
        assert one(spark, tx.evidence_refs(F.col("t")), t=text) == found


def test_corpus_parts_are_joined_unless_empty(spark):
    rows = spark.createDataFrame([("p", "r", " a", "f", 0), ("p", "r", " ", "f", 1), ("p", "r", "", "f", 2), ("p", "r", None, "f", 3), ("p", "r", "b\n", "f", 4), ("e", "r", "", "f", 0), ("w", "r", "\n", "f", 0)],
                                 "paper_id string, representation_type string, text string, source_path string, row_no int")
    got = {r.paper_id: r.text for r in readers.corpus_papers(rows, ["source_path", "row_no"]).collect()}
    assert got == {"p": "a\n\n \n\nb", "w": ""}


def test_a_batch_with_a_key_twice(spark):
    base = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    batch = spark.createDataFrame([("a", 7), ("a", 5), ("b", 3), ("b", 4), (None, 9)], "k string, v int")

    def rows(df):
        return sorted(((r.k, r.v) for r in df.collect()), key=str)

    assert rows(store.upsert(base, batch, ["k"])) == rows(spark.createDataFrame([("a", 7), ("b", 4), (None, 9)], "k string, v int"))
    assert rows(store.insert_ignore(base, batch, ["k"])) == rows(spark.createDataFrame([("a", 1), ("b", 3), (None, 2)], "k string, v int"))
    assert rows(store.delete_keys(base, batch.where("k IS NULL OR k = 'a'"), ["k"])) == [(None, 2)]
    assert rows(store.write_back(base, batch, ["k"], ["v"]))[0] == ("a", 7)


def test_repeated_bullets_by_references_or_words(spark):
    words = ["alpha", "beta", "gamma"]
    rows = [("d", 0, words, ["f1"], ["s"]), ("d", 1, ["other"], ["f1"], ["s", "t"]), ("d", 2, words, ["f2"], ["s"]), ("d", 3, words, None, None), ("d", 4, ["other"], ["f1"], ["x"]), ("d", 5, None, None, None)]
    df = spark.createDataFrame(rows, "doc string, n int, tokens array<string>, refs array<string>, sources array<string>")
    got = {r.n: r.duplicate_of for r in dedupe.near_duplicates_of_earlier(df, ["doc"], "n", "tokens", 0.82, "refs", "sources").collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 0, 4: None, 5: None}


def test_bullets_notes_and_titles(spark):
    b = spark.sql("""SELECT array(named_struct('text', ' x ', 'source_refs', array('a', ' '), 'refs', array(' Figure 1 '), 'dependency', ' Necessary', 'rationale', ' why '),
      named_struct('text', '\\n', 'source_refs', null, 'refs', null, 'dependency', null, 'rationale', null), named_struct('text', 'y', 'source_refs', null, 'refs', array(' '), 'dependency', 'necessary', 'rationale', 'z'),
      named_struct('text', 'w', 'source_refs', null, 'refs', array('t'), 'dependency', 'odd', 'rationale', '')) AS b""")
    got = [tuple(x) for x in b.select(records.bullets(F.col("b")).alias("x")).first().x]
    assert got == [(1, "x", ["a"], ["Figure 1"], "necessary", "why"), (2, "y", [], [], "none", None), (3, "w", [], ["t"], "none", None)]
    note = "Alpha et al. Beta is good — Method. It works. Gamma paper - experiment: Fine.  Delta — method"
    got = [tuple(x) for x in one(spark, records.note_sections(F.col("t")), t=note)]
    assert got == [("method", "Alpha et al. Beta is good — Method. It works. Delta — method"), ("experiment/result", "Gamma paper - experiment: Fine.")]
    assert one(spark, records.note_sections(F.col("t")), t="no view here") == [] and one(spark, records.note_sections(F.col("t")), t=None) == []
    assert one(spark, records.quoted_titles(F.col("t")), t='See "A  long title" and “Another title” and "short", \'Single quoted\'.') == ["A long title", "Another title", "Single quoted"]


def test_strict_members_and_stage_one(spark):
    hits = spark.createDataFrame([("a",), ("b",)], "k string")
    parents = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    assert [tuple(r) for r in records.with_parent(hits, parents, "k").collect()] == [("a", 1)]
    with pytest.raises(Exception, match="unknown k: b"):
        records.with_parent(hits, parents, "k", strict=True).collect()
    x = spark.createDataFrame([(True, False, 3), (True, None, 3), (True, True, 3), (True, False, 1)], "a boolean, s boolean, n int")
    got = [tuple(r)[3:] for r in records.stage_one(x, F.col("a"), F.col("s"), F.col("n")).collect()]
    assert got == [(True, False, True, True), (False, False, False, False), (True, True, True, False), (True, False, False, False)]


def test_reports_of_nothing_and_means(spark):
    x = spark.createDataFrame([("h", 1, 3), ("h", 3, 3), ("o", 2, 5), ("o", None, 1)], "side string, c int, s int")
    got = {r.measure: (r.distance, r.closeness) for r in reports.human_closeness(x, "side", "h", "o", "c", ["s"]).collect()}
    assert abs(got["c"][0] - 1) < 1e-9 and abs(got["c"][1] - 2.718281828459045**-1) < 1e-6 and got["s"] == (2.0, 0.5) and abs(got["overall"][1] - (got["c"][1] + 0.5) / 2) < 1e-9
    assert tuple(reports.search_summary(x.where("false"), F.lit(True)).first()) == (0, 0, 100.0)
    pages = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", None), ("b", [])], "k string, v array<float>")
    assert [tuple(r) for r in ranking.pool_mean_vectors(pages, "k", "v").collect()] == [("a", [2.0, 3.0])]


def test_positions_over_ranges(spark):
    x = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10)
    got = readers.with_positions(x, ["k", "id"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_keyed_table_and_limits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    keys = spark.createDataFrame([(2,), (3,), (2,)], "k int")
    assert [tuple(r) for r in readers.keyed_table(spark, path, keys, ["k"]).collect()] == [(2, "b")]
    assert [tuple(r) for r in readers.keyed_table(spark, path, keys, ["k"], missing=True).collect()] == [(3,)]
    monkeypatch.setattr(writers, "MOST_LINES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        writers.markdown_table(spark.read.parquet(path), ["k"])


def test_stages_folders_and_tokenizers():
    order = ["stage0", "stage1", "stage2", "stage3"]
    assert runs.stages("stage1-stage2, s3", order, {"s3": "stage3"}) == ["stage1", "stage2", "stage3"] and runs.stages(["STAGE0"], order) == ["stage0"]
    for wrong in ("stage2-stage1", "stage0,stage2", "x", "", "stage0-x"):
        with pytest.raises(ValueError):
            runs.stages(wrong, order)
    folders = {"b": "BGE M3", "a": None, "c": "other"}
    assert runs.result_folder(folders, ["x", "c"], []) == "c" and runs.result_folder(folders, ["x"], ["bge-m3"]) == "b" and runs.result_folder(folders, [], ["y"]) is None
    assert runs.tokenizer_path(" M ", None, {"m": "p"}, "f") == "p" and runs.tokenizer_path(None, None, {}, "f") == "f" and runs.tokenizer_path("m", "g", {"m": "p"}, "f") == "g"


def test_files_are_whole_and_fetched_once(spark, tmp_path):
    path, calls = str(tmp_path / "s.json"), []
    for n in (1, 2):
        runs.write_atomically(spark, path, {"n": n, "t": "é"})
        assert json.loads((tmp_path / "s.json").read_text()) == {"n": n, "t": "é"}
    for _ in range(2):
        runs.asset(spark, str(tmp_path / "a"), lambda: calls.append(1) or b"data")
    assert calls == [1] and (tmp_path / "a").read_bytes() == b"data"
    assert runs.progress(5, 10, 0.0, 10.0) == {"done": 5, "total": 10, "share": 0.5, "seconds": 10.0, "rate": 0.5, "left": 10.0} and runs.progress(0, 0, 0.0, 1.0)["left"] is None


def test_model_stages_keep_their_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    make = lambda: runs.TableGenerator({"p a": 'Sure: {"v": 3}'})
    got = {r.t: (r.result.v if r.result else None, r.answer) for r in runs.stage_of(df, F.concat(F.lit("p "), "t"), make, "v int").collect()}
    assert got == {"a": (3, 'Sure: {"v": 3}'), "b": (None, "mock response"), None: (None, None)}

    class Improving:
        turn = 0

        def generate(self, prompts):
            self.turn += 1
            if self.turn == 2:
                raise RuntimeError("busy")
            return ["x" * self.turn for _ in prompts]

    got = runs.answered(df.where("t = 'a'"), "t", Improving, attempts=3, score=len).first()
    assert (got.answer, got.answer_error) == ("xxx", None)


def test_passes_of_a_queue(spark):
    q = spark.createDataFrame([(1, "pending", None), (2, "pending", None), (3, "done", "x")], "id long, parse_status string, payload string")
    claim = lambda status: lambda df: df.where(F.col("parse_status") == status)
    out = queue.run_passes(q, [
        (claim("pending"), lambda df: df.withColumn("parse_status", F.when(F.col("id") == 1, "parsed").otherwise("failed")), ["parse_status"]),
        (claim("parsed"), lambda df: df.withColumn("payload", F.lit("text")).withColumn("parse_status", F.lit("done")), ["parse_status", "payload"]),
    ])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "done", "text"), (2, "failed", None), (3, "done", "x")]


def test_final_document_joins_and_titles(spark):
    from folioforge.operators import notes

    rows = spark.createDataFrame([("p", "q1", "method"), ("p", None, "method"), ("r", "q2", None)], "paper string, text string, view string")
    results = spark.createDataFrame([("p", "q1", "method", 1), ("p", "q1", "method", 3), ("p", None, "method", 5), ("r", "q2", "x", 7)], "paper string, text string, view string, hard int")
    joined = notes.with_results(rows, results, ["paper", "text", "view"])
    assert sorted((tuple(r) for r in joined.collect()), key=str) == sorted([("p", "q1", "method", 3), ("p", None, "method", 5), ("r", "q2", None, None)], key=str)
    a = spark.createDataFrame([("p", 4, " "), ("z", 1, "Z")], "paper string, position long, t string")
    b = spark.createDataFrame([("p", 2, "P")], "paper string, position long, u string")
    got = {r.paper: (r.title, r.first_stage, [q.hard for q in r.queries]) for r in notes.final_document([a, b], "paper", ["t", "u"], joined, ["text", "hard"], ["text"]).collect()}
    assert got == {"p": ("P", 0, [5, 3]), "z": ("Z", 0, [])}
