import numpy as np
import pytest

from folioforge.llm import mixing, packing, tokens


def check_pack(lengths, capacity):
    lengths = np.array(lengths)
    seqs = packing.pack(lengths, capacity)
    assert sorted(i for s in seqs for i in s) == list(range(len(lengths)))
    assert all(lengths[s].sum() <= capacity for s in seqs)
    return seqs


def test_pack_is_a_partition_within_capacity(rng):
    for _ in range(60):
        c = rng.randrange(1, 300)
        check_pack([rng.randrange(0, c + 1) for _ in range(rng.randrange(0, 200))], c)


def test_classes_hold_their_fixed_count():
    assert [len(s) for s in check_pack([51] * 4 + [34] * 6 + [25] * 8, 102)] == [2, 2, 3, 3, 4, 4]
    assert len(check_pack([100, 60, 40], 100)) == 2
    assert check_pack([0, 0], 10) == [[0, 1]] and packing.pack(np.array([], int), 10) == []


def test_fill_beats_ninety_eight_percent(rng):
    lengths = [min(2048, int(rng.lognormvariate(4.8, 1))) for _ in range(20_000)]
    seqs = check_pack(lengths, 2048)
    assert sum(lengths) / (2048 * len(seqs)) > 0.98


def test_documents_are_whole_unless_above_capacity(spark, rng):
    sizes = [(i, rng.randrange(0, 400)) for i in range(300)] + [(1000, 250), (1001, 100), (1002, 101), (1003, None), (None, 5), (7, 3)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    rows = packing.pack_documents(df, 100, shard_rows=90).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.position)
        assert [r.position for r in s] == list(range(len(s))) and sum(r.n_tokens for r in s) <= 100
        assert all(a.offset + a.n_tokens == b.offset for a, b in zip(s, s[1:]))
    pieces = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == 1000)
    assert pieces == [(0, 100), (100, 100), (200, 50)]
    assert [(r.n_tokens) for r in rows if r.doc_id == 1001] == [100] and len([r for r in rows if r.doc_id == 1002]) == 2
    assert sum(r.n_tokens for r in rows) == sum(n or 0 for _, n in sizes)
    assert packing.pack_documents(df.where("false"), 100).count() == 0
    assert packing.fill_report(packing.pack_documents(df, 100), 100).first()["tokens"] == sum(n or 0 for _, n in sizes)


def test_flow_prefers_first_uses_and_respects_caps():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    flow = mixing.route(patterns, {"a": 100, "b": 60}, {"a": 1, "b": 3})
    assert sum(v for (p, level, s), v in flow.items() if s == "a") == 100 and sum(v for (p, level, s), v in flow.items() if s == "b") == 60
    assert max(level for _, level, _ in flow) == 1  # the shared texts go to b, so nothing repeats
    flow = mixing.route({("b",): 10}, {"b": 100}, {"b": 3})
    assert flow == {(("b",), k, "b"): 10 for k in (1, 2, 3)}


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text_key string, n_tokens long")


def weights(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_met_and_repeats_capped(spark, rng):
    rows = [(i, rng.choice(["big", "big ", "BIG", "mid", "small"]) if i % 20 else "small", f"t{i}", rng.randrange(5, 40)) for i in range(3000)]
    rows = [(i, "small" if i % 60 == 0 else ("mid" if i % 7 == 0 else s.replace("small", "big")), k, n) for i, s, k, n in rows]
    sel, rep = mixing.mix(sizes(spark, rows), weights(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 2)]))
    got = {r.source: r for r in rep.collect()}
    assert all(abs(got[s].share - t) < 0.01 for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.2))) and got["none"].share == 0
    chosen = sel.collect()
    cap = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r.repeats <= cap[r.source] for r in chosen) and len({r.doc_id for r in chosen}) == len(chosen)
    again, _ = mixing.mix(sizes(spark, rows), weights(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 2)]))
    assert sorted(again.collect()) == sorted(chosen)


def test_given_total_reports_what_was_reached(spark):
    rows = [(i, "a", f"a{i}", 10) for i in range(100)] + [(1000 + i, "b", f"b{i}", 10) for i in range(5)]
    _, rep = mixing.mix(sizes(spark, rows), weights(spark, [("a", 0.5, 1), ("b", 0.5, 2)]), total_tokens=1000)
    got = {r.source: (r.tokens, r.most_repeats) for r in rep.collect()}
    assert got == {"a": (500, 1), "b": (100, 2)}


def test_copies_nulls_and_empty_tables(spark):
    rows = [(1, "a", "t", 10), (2, "a", "t", 10), (3, "b", "t", 10), (4, None, "u", 5), (None, "a", "v", 5), (5, "a", None, 5), (6, "a", "w", 0), (7, "x", "y", 9), (8, "b", "z", None)]
    sel, rep = mixing.mix(sizes(spark, rows), weights(spark, [(" A", 1.0, 1), (None, 1.0, 1), ("b", None, None)]))
    assert [(r.doc_id, r.source, r.repeats) for r in sel.collect()] == [(1, "a", 1)]
    sel, rep = mixing.mix(sizes(spark, []), weights(spark, [("a", 1.0, 1)]))
    assert sel.count() == 0 and [(r.source, r.share) for r in rep.collect()] == [("a", 0.0)]
    sel, rep = mixing.mix(sizes(spark, rows), weights(spark, []))
    assert sel.count() == 0 and rep.count() == 0


def test_token_counts_of_long_texts_equal_whole_encoding(spark, rng):
    pytest.importorskip("tiktoken")
    enc = tokens.encoding(tokens.VOCABULARY)
    text = " ".join("".join(rng.choice("abcé ñ.,\n") for _ in range(rng.randrange(1, 12))) for _ in range(4000))
    assert tokens.count(text) == len(enc.encode_ordinary(text))
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "x" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 0
