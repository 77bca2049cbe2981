import datetime as dt

from pyspark.sql import functions as F

from folioforge.operators import external as X
from folioforge.streaming import queues

T0 = dt.datetime(2024, 1, 1)
EV = "id string, ts timestamp, status string"


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def write(spark, path, batches, schema=EV):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_interval_rates_close_with_the_watermark(spark, tmp_path):
    write(spark, tmp_path, [[("a", at(5), "1"), ("a", at(30), "3")], [("a", at(7200), "1")], [("a", at(7300), "1")]])
    s = queues.file_stream(spark, str(tmp_path), EV).withColumn("v", F.col("status").cast("double"))
    got = run(queues.interval_rates(s, ["id"], "v"), "rates")
    assert ("a", at(0), at(60), 2, 2.0) in [tuple(r) for r in got]


def test_sessions_and_repeats(spark, tmp_path):
    write(spark, tmp_path, [[("a", at(0), "x"), ("a", at(200), "x"), ("a", at(200), "x")], [("a", at(9000), "x")], [("a", at(20000), "x")]])
    s = queues.file_stream(spark, str(tmp_path), EV)
    assert (at(0), at(500), 3) in [(r.start, r.end, r.n) for r in run(queues.worker_sessions(s, "id"), "spells")]
    assert len(run(queues.distinct_events(s, ["id", "ts"]), "once")) == 4


def test_leases_expire_once_and_end_with_other_events(spark, tmp_path):
    write(spark, tmp_path, [[("a", at(0), "processing"), ("b", at(0), "processing")], [("b", at(50), "completed")], [("c", at(4000), "pending")], [("c", at(4100), "pending")]])
    got = run(queues.expired_leases(queues.file_stream(spark, str(tmp_path), EV), 600), "leases")
    assert [(r.id, r.leased_at) for r in got] == [("a", at(0))]


def test_upsert_batches_are_replayable(spark):
    table = {"t": spark.createDataFrame([("a", at(0), "old")], EV)}
    step = queues.upsert_batches(lambda: table["t"], lambda df, n: table.update(t=df), ["id"])
    batch = spark.createDataFrame([("a", at(1), "x"), ("a", at(2), "y"), ("b", at(1), "z")], EV)
    step(batch, 0)
    step(batch, 0)
    assert {(r.id, r.status) for r in table["t"].collect()} == {("a", "y"), ("b", "z")}


class Fussy:
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return X.HashEmbedder(8).embed(texts)


def test_embedding_isolates_failures_and_fills_the_cache(spark):
    df = spark.createDataFrame([("1", "one"), ("2", "bad"), ("3", "three"), ("4", None), ("5", " ")], "k string, t string")
    got = {r.k: (r.embedding is not None, r.embed_error) for r in X.embedded(df.coalesce(1), "t", Fussy).collect()}
    assert got == {"1": (True, None), "2": (False, "RuntimeError: no"), "3": (True, None), "4": (False, None), "5": (False, None)}
    cache = spark.createDataFrame([("1", [0.5])], "k string, embedding array<double>")
    full = {r.k: r.embedding for r in X.embed_missing(df, cache, "k", "t", lambda: X.HashEmbedder(4)).collect()}
    assert full["1"] == [0.5] and set(full) == {"1", "2", "3", "5"} - {"5"}


def test_search_and_rerank(spark):
    records = [{"title": f"dense search {i}", "year": 2000 + i} for i in range(5)]
    plans = spark.createDataFrame([("q", "dense search"), ("r", "nothing here"), ("s", None)], "query_id string, query string")
    found = X.searched(plans, lambda: X.TableSearch(records), "table", limit=4)
    assert found.count() == 4 and {r.query_id for r in found.collect()} == {"q"}
    scores = spark.createDataFrame([("q", 3, 0.9), ("q", 1, 0.8), ("q", 0, None), ("q", 9, 1.0)], "query_id string, position int, score double")
    order = lambda k: [r.position for r in X.reranked(found, scores, k).orderBy("retrieval_rank").collect()]
    assert order(3) == [3, 1] and order(4) == [0, 1, 2, 3]
    assert [r.position for r in X.reranked(found, scores.where("false"), 2).orderBy("retrieval_rank").collect()] == [0, 1]


def test_retries():
    calls = []

    def sometimes():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert X.retried(sometimes, pause=lambda s: None) == 7 and len(calls) == 3


def test_best_attempt(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 5), ("a", 3, 5), ("a", 4, None)], "k string, n int, c int")
    assert [(r.k, r.n) for r in X.best_attempt(df, ["k"], "c", "n").collect()] == [("a", 2)]
