"""Query-style statistics: lengths, templates, histograms, distribution distances, centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions.text import word_count
from folioforge.session import cut_lineage

#: fixed values: ordered question templates, first match wins on lower-case text
QUESTION_TEMPLATES = (
    (r"^is there (a |any )?(paper|work|method|model|dataset|tool|study|approach|technique|system|decoder-|knowledge graph|vision-language|backdoor|multimodal|audio|video|numerical reasoning)?( that | which | )?", "Is there a paper/method that/which..."),
    (r"^is there any (paper|work|method|model|dataset|tool|study|approach|technique|system) ", "Is there a paper/method that/which..."),
    (r"^is there such a? (paper|work|method|model|dataset|tool|study|approach|technique|system)?( that | which | )?", "Is there a paper/method that/which..."),
    (r"^are there (any |)?(([a-z0-9-]+ )*)benchmark papers? ", "Is there a paper/method that/which..."),
    (r"^are there (any |)?(([a-z0-9-]+ )*)(benchmark|benchmarks|dataset|datasets|study|studies|paper|papers|work|works|method|methods|model|models|approach|approaches) ", "Is there a paper/method that/which..."),
    (r"^are there (any |)?(sequential |papers? |methods? |models? |approaches? )", "Is there a paper/method that/which..."),
    (r"^are there any papers? (that |which |on |about )?", "Is there a paper/method that/which..."),
    (r"^any papers? (on |about |regarding |that |which )?", "Is there a paper/method that/which..."),
    (r"^which (([a-z0-9-]+ )*)(paper|papers|study|studies|benchmark|benchmarks|dataset|datasets|method|methods|model|models|work|works)( first |proposes |introduces |presents |shows |finds |found |uses |is |are |was |were |about |on |)", "What [open-source/latest/first] method..."),
    (r"^which paper(s| research| vision-language| backdoor| numerical| knowledge graph|)?( first |proposes |introduces |presents |is | |about |on |)", "What [open-source/latest/first] method..."),
    (r"^which (is |are |was |were |)?the (first |)?", "What [open-source/latest/first] method..."),
    (r"^which (knowledge graph|vision-language|multimodal|backdoor|audio|video|benchmark|study|method|model|approach|work|dataset|technique|system|decoder|numerical reasoning|numeral|paper|papers|research) (first |proposes |introduces |presents |shows |finds |found |uses |is |was |focuses |developed |can |published |)", "What [open-source/latest/first] method..."),
    (r"^which numerical reasoning paper", "What [open-source/latest/first] method..."),
    (r"^what('s| is| are| was| were|') ", "What [open-source/latest/first] method..."),
    (r"^what (open-source |latest |recent )?(([a-z0-9-]+ )*)(paper|work|method|model|dataset|benchmark|study|papers|studies|benchmarks|datasets) ", "What [open-source/latest/first] method..."),
    (r"^what (limitations|ability|capabilities) (do|does|are|is)? ?", "What [open-source/latest/first] method..."),
    (r"^give me (all |any |some |)?papers? (that |which |on |about |showing |demonstrating |)", "Give me papers [that/on/about]..."),
    (r"^give me all (visual |)?(LLM|model|papers?|multimodal |)", "Give me papers [that/on/about]..."),
    (r"^show me (all |some |cutting edge |)?(research |papers? |studies? |work |)", "Give me papers [that/on/about]..."),
    (r"^show me (research |papers? |studies? |work ) (on |about |regarding )?", "Give me papers [that/on/about]..."),
    (r"^provide (me with |)(all |any )?papers? ", "Give me papers [that/on/about]..."),
    (r"^provide (me with |)(all |any )?(papers?|research|studies) ", "Give me papers [that/on/about]..."),
    (r"^list (all |any )?papers? ", "Give me papers [that/on/about]..."),
    (r"^find (me |all |any )?papers? ", "Give me papers [that/on/about]..."),
    (r"^all papers (on |about |regarding |)", "Give me papers [that/on/about]..."),
    (r"^papers? (that |which |on |about |proposing |presenting |introducing )?", "Give me papers [that/on/about]..."),
    (r"^research (on |about |regarding )?", "Give me papers [that/on/about]..."),
    (r"^search for (papers? |research |)", "Give me papers [that/on/about]..."),
    (r"^how to ", "How to [achieve/do]..."),
    (r"^how does ", "How does [X work]..."),
    (r"^how do ", "How do [X work]..."),
    (r"^how can ", "How can [we/X]..."),
    (r"^why ", "Why [does/is X]..."),
    (r"^can ", "Can [we/X]..."),
    (r"^can i ", "Can I..."),
    (r"^could ", "Could [we/X]..."),
    (r"^help me (search |find |)", "Help me search/find..."),
    (r"^i am looking for ", "I am looking for..."),
    (r"^i need (papers? |research |studies? ) (on |about |regarding )?", "I need papers on/about..."),
    (r"^i would like (to |)", "I would like to..."),
    (r"^using ", "Using [X for Y]..."),
    (r"^does ", "Does [X work/affect]..."),
    (r"^do ", "Do [X/they]..."),
    (r"^if one (would like |wants |)", "If one would like/wants..."),
    (r"^who ", "Who [proposed/first]..."),
    (r"^when ", "When [was X proposed]..."),
    (r"^where ", "Where [is X from]..."),
    (r"^papers?( on| about| regarding| using| with| for)", "Papers [on/about]..."),
    (r"^[A-Z][a-z]+( [A-Z][a-z]+)+", "Paper title/name format"),
)


def question_template(x: Column) -> Column:
    """Name of the first template that matches the trimmed lower-case text; null if none."""
    low = F.lower(tx.stripped(x))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(QUESTION_TEMPLATES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def length_stats(df: DataFrame, group: Sequence[str], text: str) -> DataFrame:
    """Per group and measure (chars, words): n, mean, population std, min, quartiles, max.
    Quartiles are exact with linear interpolation; null texts don't count."""
    x = df.where(F.col(text).isNotNull()).select(*group, F.inline(F.array(
        F.struct(F.lit("chars").alias("measure"), F.length(text).cast("double").alias("v")),
        F.struct(F.lit("words").alias("measure"), word_count(F.col(text)).cast("double").alias("v")),
    )))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        x.groupBy(*group, "measure")
        .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"))
        .select(*group, "measure", "n", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p75"), "max")
    )


def template_distribution(queries: DataFrame, text: str, position: str) -> DataFrame:
    """Count, share of all queries and the first three examples of each template; unmatched
    queries are the row of the null template."""
    x = queries.select(question_template(F.col(text)).alias("template"), F.col(position).alias("pos"), F.col(text).alias("q"))
    w = Window.partitionBy("template").orderBy("pos")
    first = x.withColumn("place", F.row_number().over(w)).where("place <= 3").groupBy("template").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "q"))), lambda s: s["q"]).alias("examples")
    )
    n = x.groupBy("template").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row a template
    return n.withColumn("ratio", share).join(first, n["template"].eqNullSafe(first["template"])).select(n["template"], "n", "ratio", "examples")


def representative_examples(queries: DataFrame, text: str, position: str, n: int) -> DataFrame:
    """max(1, n // templates) earliest queries of each template, templates in first-seen order,
    cut to ``n``."""
    x = queries.withColumn("template", question_template(F.col(text))).where("template IS NOT NULL")
    first = x.groupBy("template").agg(F.min(position).alias("first_seen"))
    per = first.agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.count("*"), F.lit(1)))).alias("per"))
    w = Window.partitionBy("template").orderBy(position)
    y = x.withColumn("place", F.row_number().over(w)).join(first, "template").crossJoin(F.broadcast(per)).where("place <= per")  # one row
    return y.orderBy("first_seen", position).limit(n).select("template", position, text)


def histogram(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Unit bins over the global range, the same for every group, empty bins included."""
    x = df.select(F.col(group), value.cast("long").alias("bin")).where("bin IS NOT NULL")
    n = x.groupBy(group, "bin").agg(F.count("*").alias("n"))
    ends = n.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo IS NOT NULL")
    frame = n.select(group).distinct().crossJoin(F.broadcast(ends)).select(group, F.explode(F.sequence("lo", "hi")).alias("bin"))  # one row
    return frame.join(n, [group, "bin"], "left").select(group, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def wasserstein(df: DataFrame, side: str, a: str, b: str, value: str) -> DataFrame:
    """1-D Wasserstein distance between the values of sides ``a`` and ``b``: the area between
    their distribution functions. Values are counted first, and the distinct ones are laid out by
    ranges: each task sums up its own range on top of the totals of the ranges before it."""
    n = df.where(F.col(value).isNotNull() & F.col(side).isin(a, b)).groupBy(F.col(value).alias("v")).agg(
        F.count(F.when(F.col(side) == a, 1)).alias("na"), F.count(F.when(F.col(side) == b, 1)).alias("nb")
    )
    # written, as a range must be the same whenever it is read
    x = cut_lineage(n.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    per = x.groupBy("part").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.min("v").alias("first"))
    parts, all_parts = Window.orderBy("part"), Window.partitionBy()  # one row a range
    before = [F.coalesce(F.sum(c).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before") for c in ("na", "nb")]
    per = per.select("part", *before, *[F.sum(c).over(all_parts).alias(f"{c}_all") for c in ("na", "nb")], F.lead("first").over(parts).alias("following"))
    run = Window.partitionBy("part").orderBy("v")
    x = x.join(F.broadcast(per), "part").select(  # one row a range
        "v",
        ((F.col("na_before") + F.sum("na").over(run)) / F.col("na_all")).alias("fa"),
        ((F.col("nb_before") + F.sum("nb").over(run)) / F.col("nb_all")).alias("fb"),
        F.coalesce(F.lead("v").over(run), F.col("following")).alias("next"),
    )
    return x.agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("next") - F.col("v"))).alias("distance"))


def centroids(points: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Per label: centroid, mean distance of its points to it, and count."""
    c = points.groupBy(label).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("n"))
    d = F.sqrt(F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2))
    spread = points.join(c, label).groupBy(label).agg(F.avg(d).alias("spread"))
    return c.join(spread, label)


def centroid_separation(points: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Pairs of labels (left < right): centroid distance and its ratio to the mean spread. The
    join runs over one row a label."""
    c = centroids(points, label, x, y)
    a, b = c.alias("a"), c.alias("b")
    d = F.sqrt(F.pow(F.col("a.cx") - F.col("b.cx"), 2) + F.pow(F.col("a.cy") - F.col("b.cy"), 2))
    pairs = a.join(b, F.col(f"a.{label}") < F.col(f"b.{label}"))
    return pairs.select(
        F.col(f"a.{label}").alias("left_label"), F.col(f"b.{label}").alias("right_label"), d.alias("distance"),
        F.try_divide(d, (F.col("a.spread") + F.col("b.spread")) / 2).alias("separation"),
    )


def weighted_merge(summaries: DataFrame, group: Sequence[str], weight: str, measures: Sequence[str]) -> DataFrame:
    """Weighted means of summary measures; rows with a null measure don't weigh in it."""
    return summaries.groupBy(*group).agg(
        *[F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in measures],
        F.sum(weight).alias(weight),
    )


def centred_fit(score: Column) -> Column:
    """max(0, 1 - |score - 3| / 2); null for null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(score - 3) / 2))


def judged_score(x: Column) -> Column:
    """An integer 1..5 from text, else null."""
    v = x.try_cast("int")
    return F.when(v.between(1, 5), v)


def count_of(x: Column) -> Column:
    """A whole number of at least 0 from text, else 0."""
    return F.greatest(F.coalesce(x.try_cast("int"), F.lit(0)), F.lit(0))


def human_closeness(distance: Column, spread: Column) -> Column:
    """exp(-distance / (spread + 1e-8))."""
    return F.exp(-distance / (spread + 1e-8))
