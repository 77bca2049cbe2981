"""Extra columns whose names the operators use inside, and nulls in every column."""

import datetime as dt

from pyspark.sql import functions as F

from folioforge.llm import consensus, matching, mixing, neighbors, packing, residue, splitting


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit(7))
    return df


def test_consensus(spark):
    rows = [(i, "q", "human_like", n, "yes", dt.datetime(2024, 1, 1)) for i, n in enumerate("abc")] + [(None, None, None, None, None, None), (9, "q", "human_like", "a", "no", None)]
    df = spark.createDataFrame(rows, "id long, query_id string, feedback_item_id string, reviewer_username string, judgement string, updated_at timestamp")
    got = consensus.feedback_consensus(clash(df, "rater", "family", "l", "k", "n_votes", "label", "q0", "words")).collect()
    assert [(r.judgement, r.n_votes) for r in got] == [("yes", 3)]


def test_neighbors(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, vector array<float>")
    x = spark.createDataFrame([("a", [1.0, 0.1, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0, 0.1])], "item_id string, vector array<float>")
    got = neighbors.nearest(clash(q, "i", "cells", "part", "item_id"), clash(x, "i", "j", "part", "share", "query_id"), 4, 2).orderBy("rank").collect()
    assert [(r.item_id, r["rank"]) for r in got] == [("a", 1), ("b", 2)]  # a tie goes to the smaller id


def test_matching(spark):
    schema = "sid string, title string, authors array<string>, year int, ids string"
    row = ("Kappa: Robust Planners for Map Matching", ["Kim Lund"], 2022, None)
    nulls = (None, None, None, None)
    left = spark.createDataFrame([("l", *row), ("n", *nulls), (None, *row)], schema)
    right = spark.createDataFrame([("r", *row), ("m", *nulls), (None, *row)], schema)
    got = matching.match(clash(left, "key", "lid", "sig", "code", "x"), clash(right, "key", "rid", "rid_true", "prior")).collect()
    assert [(r.lid, r.rid) for r in got] == [("l", "r")]


def test_packing_and_mixing(spark):
    sizes = spark.createDataFrame([(1, "a", "t1", 5), (2, None, None, None)], "doc_id long, source string, text_key string, n_tokens long")
    assert packing.pack_documents(clash(sizes, "shard", "position", "offset", "sequence_id"), 10).count() == 2
    weights = spark.createDataFrame([("a", 1.0, 1), (None, None, None)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(clash(sizes, "bucket", "turn", "homes", "pattern"), clash(weights, "w", "r", "share"))
    assert [(r.doc_id, r.repeats) for r in selection.collect()] == [(1, 1)] and report.count() == 1


def test_residue_and_splitting(spark):
    docs = spark.createDataFrame([(1, "Access denied.", None), (None, None, None)], "doc_id long, text string, source string")
    assert [r.doc_id for r in residue.residue_documents(clash(docs, "kind", "message", "raw", "piece")).collect()] == [1]
    rows = spark.createDataFrame([("p", "x", None, None, "a b"), ("p", None, None, None, "c"), ("p", "y", None, None, None)], "item_kind string, item_id string, part string, row_no int, text string")
    got = splitting.split_items(clash(rows, "first_token", "cell", "marks", "text_hash")).collect()
    assert sorted((r.item_id or "", r.text) for r in got) == [("", "c"), ("x", "a b")]
