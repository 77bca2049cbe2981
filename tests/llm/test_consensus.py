import datetime as dt

from folioforge.llm import consensus as C

F_SCHEMA = "id long, query_id string, feedback_item_id string, reviewer_username string, judgement string, updated_at timestamp"


def feedback(spark, rows):
    return spark.createDataFrame([(i, *r, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i, r in enumerate(rows)], F_SCHEMA)


def test_votes_fold_names_and_judgements(spark):
    rows = [
        ("q", "human_like", "Ann.Bee_3@x.org", "Yes!"), ("q", "human_like", "annbee3", " NO "), ("q", "human_like", "B", "n/a"), ("q", "human_like", "C", None),
        ("q", "cand_01", "B", "corr."), ("q", "cand_01", "C", "not  correct"), ("q", "query_relevance", "B", "part. relevant"), ("q", "query_relevance", "C", "non-relevant"),
        ("q", "other", "B", "yes"), (None, "human_like", "B", "yes"), ("q", "human_like", "@x", "yes"), ("q", "human_like", None, "yes"),
    ]
    got = {(r.item_b, r.rater, r.label) for r in C.feedback_votes(feedback(spark, rows)).collect()}
    assert got == {
        ("human_like", "annbee3", "no"), ("cand_01", "b", "correct"), ("cand_01", "c", "incorrect"),
        ("query_relevance", "b", "partially relevant"), ("query_relevance", "c", "not relevant"),
    }


def simulated(rng, items=300):
    """Three careful raters, two who turn answers round, in a minority and a majority per item."""
    truth, rows = {}, []
    for i in range(items):
        t = rng.choice(["yes", "no"])
        truth[f"q{i}"] = t
        other = "no" if t == "yes" else "yes"
        for name, right in (("good1", 0.93), ("good2", 0.9), ("good3", 0.9), ("bad1", 0.08), ("bad2", 0.1)):
            if rng.random() < 0.75:
                rows.append((f"q{i}", "human_like", name, t if rng.random() < right else other))
    return truth, rows


def test_reliability_beats_majority(spark, rng):
    truth, rows = simulated(rng)
    df = feedback(spark, rows)
    got = {r.query_id: r.judgement for r in C.feedback_consensus(df, min_raters=1).collect()}
    assert sum(truth[q] == j for q, j in got.items()) / len(got) > 0.93
    _, confusion = C.variational_consensus(C.feedback_votes(df), C.FEEDBACK_CLASSES)
    rel = {r.rater: r for r in C.reliability(confusion).collect()}
    assert rel["good1"].reliability > 0.85 > 0.3 > rel["bad1"].reliability
    assert all(0 <= r.low <= r.reliability <= r.high <= 1 for r in rel.values())


def test_any_number_of_raters_gives_the_same(spark, rng, monkeypatch):
    votes = C.feedback_votes(feedback(spark, simulated(rng, 40)[1] + [("q1", "cand_01", n, j) for n, j in (("good1", "right"), ("bad1", "wrong"), ("z", "ok"))]))

    def run():
        items, confusion = C.variational_consensus(votes, C.FEEDBACK_CLASSES)
        at = {(r.item_a, r.item_b): (r.label, r.n_votes, r.settled, *(round(v, 6) for v in r.q[:2])) for r in items.collect()}
        return at, {tuple(r[:4]): round(r.alpha, 6) for r in confusion.collect()}

    small = run()
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert run() == small and all(v[2] for v in small[0].values())


def test_a_cut_off_run_says_so_and_unreadable_judgements_are_reported(spark, rng):
    rows = simulated(rng, 30)[1]
    items, _ = C.variational_consensus(C.feedback_votes(feedback(spark, rows)), C.FEEDBACK_CLASSES, rounds=1, tolerance=1e-9)
    assert {r.settled for r in items.collect()} == {False}
    odd = [("q", "human_like", "b", "perhaps"), ("q", "human_like", "c", "Perhaps!"), ("q", "human_like", "c", None), ("q", "x", "c", "yes")]
    got = {(r.family, r.words): r.n for r in C.unreadable_judgements(feedback(spark, rows + odd)).collect()}
    assert got == {("human_like", "perhaps"): 2, ("human_like", None): 1, (None, "yes"): 1}


def test_confidence_is_a_probability_and_minimum_holds(spark):
    rows = [("q", "human_like", n, "yes") for n in "abc"] + [("r", "human_like", n, "no") for n in "ab"]
    got = C.feedback_consensus(feedback(spark, rows)).collect()
    assert [(r.query_id, r.judgement, r.n_votes) for r in got] == [("q", "yes", 3)] and 0.5 < got[0].confidence <= 1


def test_empty(spark):
    df = feedback(spark, [])
    assert C.feedback_consensus(df).count() == 0 and C.krippendorff_alpha(C.feedback_votes(df)).count() == 0


def test_alpha_against_brute_force(spark, rng):
    _, rows = simulated(rng, 60)
    got = C.krippendorff_alpha(C.feedback_votes(feedback(spark, rows))).first()
    units = {}
    for q, _, name, j in rows:
        units.setdefault(q, {})[name] = j
    units = [list(u.values()) for u in units.values() if len(u) > 1]
    values = [v for u in units for v in u]
    n = len(values)
    observed = sum(sum(a != b for i, a in enumerate(u) for k, b in enumerate(u) if i != k) / (len(u) - 1) for u in units) / n
    expected = sum(a != b for i, a in enumerate(values) for k, b in enumerate(values) if i != k) / (n * (n - 1))
    assert abs(got.alpha - (1 - observed / expected)) < 1e-9 and got.votes == n


def test_digamma(spark):
    from pyspark.sql import functions as F

    known = {1.0: -0.5772156649015329, 0.5: -1.9635100260214235, 10.0: 2.251752589066721, 0.1: -10.423754940411076}
    got = spark.createDataFrame([(k,) for k in known], "x double").select("x", C.digamma(F.col("x")).alias("y")).collect()
    assert all(abs(known[r.x] - r.y) < 1e-9 for r in got)
