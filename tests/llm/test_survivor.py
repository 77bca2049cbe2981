import datetime as dt
import json

from pyspark.sql import functions as F

from folioforge.llm import survivor

SCHEMA = (
    "id long, query_key string, paper_id string, query_text string, source_view string, query_type string, retrieval_rank int, "
    "review_status string, parse_status string, review_payload string, review_label string, updated_at timestamp"
)


def queue(spark, rows):
    full = []
    for r in rows:
        base = dict(id=1, query_key="k", paper_id="p", query_text="t", source_view="method", query_type="IR", retrieval_rank=1,
                    review_status=None, parse_status=None, review_payload=None, review_label=None, updated_at=None)
        full.append(tuple((base | r).values()))
    return spark.createDataFrame(full, SCHEMA)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def survivors(df, **kw):
    return {(r.query_key, r.retrieval_rank): r for r in survivor.queue_survivors(df, **kw).collect()}


def test_policy_order_and_spellings(spark):
    df = queue(spark, [
        dict(id=1, review_status="pending", updated_at=day(90)),
        dict(id=2, review_status=" COMPLETED\n", parse_status="No-Pdf", updated_at=day(1)),
        dict(id=3, review_status="completed", parse_status="Metadata_Only ", updated_at=day(0)),
        dict(id=4, query_key=" K ", review_status="completed", parse_status="metadata only", updated_at=day(0), review_payload='{"a": [0]}'),
    ])
    assert survivors(df)["k", 1].survivor_id == 4


def test_ties_nulls_and_repeats(spark):
    same = [dict(id=i, review_status="odd", updated_at=None) for i in (5, 9, 9, 7)]
    got = survivors(queue(spark, same))["k", 1]
    assert got.survivor_id == 9 and got.n_records == 4
    twice = queue(spark, [dict(id=3), dict(id=3)])
    assert survivors(twice, min_ids=2) == {}
    assert survivors(queue(spark, [dict(id=1, retrieval_rank=None), dict(id=None)])) == {}
    assert survivors(queue(spark, [])) == {}


def test_missing_query_key_is_made(spark):
    got = survivors(queue(spark, [dict(id=1, query_key="  "), dict(id=2, query_key=None)]))
    import hashlib

    assert list(got) == [(hashlib.sha1(b"p\nt\nmethod\nIR").hexdigest(), 1)]


def test_payloads(spark):
    cases = {
        None: False, "": False, "null": False, "[]": False, "[1]": False, "{}": False, '{"a": null}': False, '{"a": ""}': False,
        '{"a": {"b": [{}, [], "", null]}}': False, '{"a": {"b": [{"c": 0}]}}': True, '{"a": false}': True, '{"a": "x"': False,
        '{"a": 1} {}': False, '{"a": 1}, {}': False, '{"k:": "null"}': True, '{"k\\"": "", ":": ", : "}': True, '{"": ""}': False, " {\"a\": \"\\\"\"} ": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.x for r in df.select("p", survivor.json_object_has_content(F.col("p")).alias("x")).collect()}
    assert got == cases


def test_fields_come_from_the_earliest_layer(spark):
    df = queue(spark, [
        dict(id=1, review_status="completed", updated_at=day(60), review_label=None),
        dict(id=2, review_status="completed", updated_at=day(20), review_label="second"),
        dict(id=3, review_status="failed", updated_at=day(0), review_label="third"),
    ])
    got = survivors(df, fields=["review_label", "review_payload"])["k", 1]
    assert (got.survivor_id, got.review_label, got.review_label_layer, got.layers) == (1, "second", 2, 3)
    assert got.review_payload is None


def test_survivor_is_undominated_and_first_of_policy(spark, rng):
    status, parse = ["completed", "pending", "failed", "x", None], ["parsed", "no_pdf", None]
    pay = [None, "{}", '{"a": 1}']
    rows = [
        dict(id=i, query_key=f"k{rng.randrange(6)}", retrieval_rank=rng.randrange(3), review_status=rng.choice(status), parse_status=rng.choice(parse),
             review_payload=rng.choice(pay), updated_at=rng.choice([None, day(rng.randrange(300))]))
        for i in range(300)
    ]

    def key(r):
        s = {"completed": 0, "processing": 1, "pending": 2, "failed": 3}.get(r["review_status"], 4)
        p = {"parsed": 0, "metadata_only": 1, "no_pdf": 2, "pending": 3}.get(r["parse_status"], 4)
        full = bool(r["review_payload"]) and bool(json.loads(r["review_payload"]))
        return (-s, -p, full, r["updated_at"] or dt.datetime.min, r["id"])

    best = {}
    for r in rows:
        k = (r["query_key"], r["retrieval_rank"])
        best[k] = max(best.get(k, key(r)), key(r))
    got = survivors(queue(spark, rows))
    assert {k: v.survivor_id for k, v in got.items()} == {k: v[-1] for k, v in best.items()}


def test_extra_columns_with_clashing_names(spark):
    df = queue(spark, [dict(id=1), dict(id=2)]).withColumn("cells", F.lit(1)).withColumn("best", F.lit(2)).withColumn("n", F.lit(3))
    assert survivors(df, fields=["review_label"])["k", 1].survivor_id == 2
