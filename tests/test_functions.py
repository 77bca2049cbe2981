import pytest
from pyspark.sql import functions as F

from folioforge.functions import keys, text, vectors
from folioforge.operators import dedupe, style


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, refs", [
    ("See Figure 3 and Table 2.", ["Figure 3", "Table 2"]), ("Figs. 1, 2 and A3 show", ["Figure 1", "Figure 2", "Figure A3"]), ("Eq. (4) and alg. 1", ["Equation 4", "Algorithm 1"]),
    ("Tables 2-4", ["Table 2-4"]), ("Table 2 to 4", ["Table 2to4"]), ("figure  S1.2 (Figure S1.2)", ["Figure S1.2"]), ("equation 5;Fig5", ["Equation 5", "Figure 5"]),
    ("Tab. 3 / no refs here", []), (None, []), ("", []),
])
def test_evidence_refs(spark, raw, refs):
    assert one(spark, text.evidence_refs(F.col("a")), a=raw) == refs


@pytest.mark.parametrize("raw, view", [(" Experiment_Result ", "experiment/result"), ("experiment", "experiment/result"), ("METHOD", "method"), ("result", None), (None, None)])
def test_aspect_view(spark, raw, view):
    assert one(spark, text.aspect_view(F.col("a")), a=raw) == view


@pytest.mark.parametrize("raw, ident", [("x.docling.restored", "x"), ("x.restored.docling", "x.restored"), (" x ", "x"), (None, None)])
def test_canonical_id(spark, raw, ident):
    assert one(spark, text.canonical_id(F.col("a")), a=raw) == ident


def test_scalars(spark):
    assert one(spark, text.slug(F.col("a")), a="  Hello, World!  ") == "hello-world" and one(spark, text.slug(F.col("a")), a="***") == "item"
    assert one(spark, keys.stable_field_id(F.col("a")), a="abc") == 590 and one(spark, keys.stable_field_id(F.col("a")), a="") == 0
    assert one(spark, text.token_jaccard(F.col("a"), F.col("b")), a="a b c", b="model") == 0.0
    assert one(spark, text.word_count(F.col("a")), a=None) == 0 and one(spark, text.word_count(F.col("a")), a=" a  b ") == 2
    assert one(spark, text.delimited_list(F.col("a")), a='["x", " x ", ""]') == ["x"] and one(spark, text.delimited_list(F.col("a")), a="a, b|a") == ["a", "b"]
    assert one(spark, text.json_in(F.col("a")), a='noise {"a": 1} tail') == '{"a": 1}' and one(spark, text.json_in(F.col("a")), a="none") is None
    assert one(spark, text.search_plan(F.split("a", "/")), a="one two three four five/six") == ["one two three four six", "one two three four", "six"]
    assert one(spark, text.pattern_density(F.col("a"), ("et al", "arxiv")), a=None) == 0.0
    assert one(spark, text.cleaned_query(F.col("a")), a="papers (multimodal) like Fig. 3 on x ?") == "papers like on x?"
    assert one(spark, text.render("{{a}}-{{b}}", {"a": F.col("a"), "b": F.col("b")}), a="1", b=None) == "1-"
    assert one(spark, text.strip_tags(F.col("a")), a="<p>a&nbsp;&lt;b</p>") == "a <b"
    assert one(spark, style.centred_fit(F.col("a")), a=5.0) == 0.0 and one(spark, style.centred_fit(F.col("a").cast("double")), a=None) is None
    assert one(spark, style.judged_score(F.col("a")), a="6") is None and one(spark, style.judged_score(F.col("a")), a="4") == 4


def test_jaccard_by_hand(spark):
    # tokens longer than 2: {the, model, fast} and {the, model, was, fast}
    assert one(spark, text.token_jaccard(F.col("a"), F.col("b")), a="The model is fast", b="the MODEL was fast") == 0.75


def test_vectors(spark):
    assert one(spark, vectors.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0] and one(spark, vectors.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.decoded(F.col("a")), a="[1, 2.5]") == [1.0, 2.5] and one(spark, vectors.decoded(F.col("a")), a="1,2.5") == [1.0, 2.5]
    assert one(spark, vectors.decoded(vectors.encoded(F.col("a"))), a=[0.125, -3.0]) == [0.125, -3.0]


def test_ordered_near_duplicates(spark):
    rows = [("d", 0, list("abcd")), ("d", 1, list("abcd")), ("d", 2, list("abce")), ("d", 3, list("xyz")), ("e", 0, list("abcd"))]
    df = spark.createDataFrame(rows, "g string, place int, t array<string>")
    got = {(r.g, r.place): r.duplicate_of for r in dedupe.near_duplicates_of_earlier(df, ["g"], "place", "t", 0.6).collect()}
    assert got == {("d", 0): None, ("d", 1): 0, ("d", 2): 0, ("d", 3): None, ("e", 0): None}


def test_statistics_on_edge_inputs(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", None), ("b", "")], "g string, t string")
    got = {(r.g, r.measure): (r.n, r.mean) for r in style.length_stats(df, ["g"], "t").collect()}
    assert got == {("a", "chars"): (1, 3.0), ("a", "words"): (1, 2.0), ("b", "chars"): (1, 0.0), ("b", "words"): (1, 0.0)}
    assert style.length_stats(df.where("false"), ["g"], "t").count() == 0
    assert style.histogram(df.where("false"), "g", F.length("t")).count() == 0
    two = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 5.0), ("b", 6.0), ("b", None)], "s string, v double")
    assert style.wasserstein(two, "s", "a", "b", "v").first().distance == 5.0
