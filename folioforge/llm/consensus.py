"""Consensus labels, annotator reliability and agreement from disagreeing annotators.

Model: an item of family f has a hidden class; annotator r, seeing class k, gives label l
with probability theta[r, f, k, l]. Rows of theta and the class shares have Dirichlet
priors. Mean-field variational inference alternates

* items: log q(class k) = E[log share_k] + sum over votes E[log theta[r, f, k, l]], and
* annotators: Dirichlet counts = prior + sum of q over the annotator's votes,

where E[log .] is a difference of digammas. Both steps are group-bys over the votes: the
first by item, the second map-side combined to a table of annotators x classes x labels.

Votes stay distributed. While the annotator table is small (``BROADCAST_ROWS``, counted
first) every item is one row with its votes in an array, a round is one job of Arrow
batches that sum up within each task, and the table goes to the tasks with the job.
Beyond, the table is joined to the votes and each round is cut off in the shared
checkpoint folder. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut_lineage, drop_table

#: most rounds, and the change of a cell against its annotator's votes at which a run has settled
ROUNDS, TOLERANCE = 60, 1e-3
#: rows up to which the annotator table is held by every task; beyond, a join shuffles it
BROADCAST_ROWS = 200_000
#: prior pseudo-counts of a confusion row: on the diagonal, and spread over the rest
DIAGONAL, OFF_DIAGONAL = 2.0, 0.7
CLASS_PRIOR = 2.0


def digamma(x: Column) -> Column:
    """Digamma of a positive column: six recurrence steps, then the asymptotic series."""
    shift = sum((1 / (x + i) for i in range(6)), F.lit(0.0))
    y = x + 6
    y2 = 1 / (y * y)
    return F.log(y) - 0.5 / y - y2 * (F.lit(1 / 12) - y2 * (F.lit(1 / 120) - y2 * (F.lit(1 / 252) - y2 / 240))) - shift


def variational_consensus(
    votes: DataFrame, classes: Mapping[str, Sequence[str]], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """(items, confusion) for votes (item_a, item_b, rater, family, label), one row per item and rater.

    ``classes`` gives each family its labels; other labels must have been left out. items has
    item_a, item_b, family, n_votes, label, confidence, ``q``, the probabilities in the
    order of ``classes``, and ``settled``, whether the run ended before ``rounds``; confusion has
    rater, family, truth, label and ``alpha``, the posterior Dirichlet count. Equal
    probabilities go to the class named first.
    """
    index = F.lit(None).cast("int")
    size = F.lit(None).cast("int")
    for family, labels in classes.items():
        size = F.when(F.col("family") == family, len(labels)).otherwise(size)
        for i, label in enumerate(labels):
            index = F.when((F.col("family") == family) & (F.col("label") == label), i).otherwise(index)
    x = votes.select("item_a", "item_b", "rater", "family", index.alias("l"), size.alias("k")).where("l IS NOT NULL AND rater IS NOT NULL")
    x = cut_lineage(x)  # counted here, read again below
    cells = x.select("rater", "family", "l").distinct().limit(BROADCAST_ROWS + 1).collect()
    if len(cells) > BROADCAST_ROWS:
        return _by_joins(x, classes, rounds, tolerance)
    return _by_batches(x, classes, sorted({c["rater"] for c in cells}), rounds, tolerance)


def _log_means(alpha: np.ndarray, axis: int) -> np.ndarray:
    """E[log] of Dirichlet rows."""
    return _digamma(alpha) - _digamma(alpha.sum(axis=axis, keepdims=True))


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = sum(1 / (x + i) for i in range(6))
    y = x + 6
    y2 = 1 / (y * y)
    return np.log(y) - 0.5 / y - y2 * (1 / 12 - y2 * (1 / 120 - y2 * (1 / 252 - y2 / 240))) - shift


def _by_batches(x: DataFrame, classes: Mapping[str, Sequence[str]], raters: list[str], rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The rounds while the annotator table fits every task: counts[family, rater, label, class]."""
    spark = x.sparkSession
    families = list(classes)
    sizes = np.array([len(classes[f]) for f in families])
    most = int(sizes.max())
    open_class = np.arange(most)[None, :] < sizes[:, None]
    number = spark.createDataFrame([(r, i) for i, r in enumerate(raters)], "rater string, r int")
    place = F.lit(None).cast("int")
    for i, family in enumerate(families):
        place = F.when(F.col("family") == family, i).otherwise(place)
    x = x.join(F.broadcast(number), "rater")  # at most BROADCAST_ROWS rows
    # at most one vote a rater, so no item has more than there are raters
    items = cut_lineage(
        x.groupBy("item_a", "item_b", "family", place.alias("f"))
        .agg(F.sort_array(F.collect_list(F.struct("r", "l"))).alias("v"))
        .select("item_a", "item_b", "family", "f", F.col("v.r").alias("r"), F.col("v.l").alias("l"))
    )

    def posterior(pdf: pd.DataFrame, logs: np.ndarray | None, shares: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(q, family, rater, label of every vote, item of every vote)."""
        n = pdf["r"].map(len).to_numpy()
        of = np.repeat(np.arange(len(pdf)), n)
        r, lab = np.concatenate(pdf["r"].to_numpy()), np.concatenate(pdf["l"].to_numpy())
        f = pdf["f"].to_numpy()
        z = np.zeros((len(pdf), most))
        if logs is None:  # first round: shares of the votes, softened
            np.add.at(z, (of, lab), 1.0)
            z = np.log((z + 0.5) / (n + 0.5 * sizes[f])[:, None])
        else:
            np.add.at(z, of, logs[f[of], r, lab])
            z += shares[f]
        z = np.where(open_class[f], z, -np.inf)
        w = np.exp(z - z.max(axis=1, keepdims=True))
        return w / w.sum(axis=1, keepdims=True), f, r, lab, of

    shape = (len(families), len(raters), most, most)

    def round_of(logs: np.ndarray | None, shares: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts and class sizes, summed up within each task first."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, members = np.zeros(shape), np.zeros((len(families), most))
            for pdf in batches:
                if len(pdf):
                    q, f, r, lab, of = posterior(pdf, logs, shares)
                    np.add.at(counts, (f[of], r, lab), q[of])
                    np.add.at(members, f, q)
            at = np.argwhere(counts > 0)
            seen = np.argwhere(members > 0)
            yield pd.DataFrame({
                "f": np.concatenate([at[:, 0], seen[:, 0]]), "r": np.concatenate([at[:, 1], np.full(len(seen), -1)]), "l": np.concatenate([at[:, 2], seen[:, 1]]),
                "c": np.concatenate([at[:, 3], seen[:, 1]]), "n": np.concatenate([counts[tuple(at.T)], members[tuple(seen.T)]]),
            })

        parts = items.select("f", "r", "l").mapInPandas(run, "f int, r int, l int, c int, n double").groupBy("f", "r", "l", "c").agg(F.sum("n").alias("n"))
        counts, members = np.zeros(shape), np.zeros((len(families), most))
        for row in parts.collect():  # at most most * BROADCAST_ROWS rows, as counted before
            if row["r"] < 0:
                members[row["f"], row["c"]] = row["n"]
            else:
                counts[row["f"], row["r"], row["l"], row["c"]] = row["n"]
        return counts, members

    prior = np.full((len(families), 1, most, most), OFF_DIAGONAL) / np.maximum(sizes - 1, 1)[:, None, None, None]
    prior[..., np.arange(most), np.arange(most)] = DIAGONAL
    real = (open_class[:, None, :, None] & open_class[:, None, None, :]).astype(float)
    prior = prior * real
    hidden = np.where(real > 0, 0.0, 1.0)

    def expected(counts: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha = counts + prior
        total = alpha.sum(axis=2, keepdims=True)  # over the labels of a class
        logs = np.where(hidden > 0, 0.0, _digamma(alpha + hidden) - _digamma(total + (total == 0)))
        return logs, _digamma(members + CLASS_PRIOR)

    counts, members = round_of(None, None)
    logs, shares, settled = None, None, False
    for _ in range(rounds):
        logs, shares = expected(counts, members)
        new, members = round_of(logs, shares)
        moved = (np.abs(new - counts) / (1 + new.sum(axis=3, keepdims=True))).max(initial=0.0)
        counts = new
        if moved < tolerance:
            settled = True
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q, f, *_ = posterior(pdf, logs, shares)
                best = q.argmax(axis=1)
                yield pd.DataFrame({
                    "item_a": pdf["item_a"], "item_b": pdf["item_b"], "family": pdf["family"], "n_votes": pdf["r"].map(len), "label": [classes[families[i]][c] for i, c in zip(f, best)],
                    "confidence": q[np.arange(len(q)), best], "q": list(q), "settled": settled,
                })

    found = items.mapInPandas(label, "item_a string, item_b string, family string, n_votes long, label string, confidence double, q array<double>, settled boolean")
    alpha = counts + prior
    judged = counts.sum(axis=(2, 3)) > 0
    rows = [
        (raters[r], families[f], classes[families[f]][c], classes[families[f]][lab], float(alpha[f, r, lab, c]))
        for f, r in np.argwhere(judged)
        for c in range(sizes[f])
        for lab in range(sizes[f])
    ]
    return found, spark.createDataFrame(rows, "rater string, family string, truth string, label string, alpha double")


def _by_joins(x: DataFrame, classes: Mapping[str, Sequence[str]], rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The rounds for an annotator table of any size: votes (item_a, item_b, rater, family, l, k)."""
    spark, most = x.sparkSession, max(len(v) for v in classes.values())
    item = Window.partitionBy("item_a", "item_b")
    # Partitioned by item once; every round then works inside these partitions.
    x = x.withColumn("n_votes", F.count("*").over(item)).persist(StorageLevel.MEMORY_AND_DISK)

    def posterior(logs: DataFrame | None, shares: DataFrame | None) -> DataFrame:
        if logs is None:  # first round: shares of the votes, softened
            same = [F.sum(F.when(F.col("l") == c, 1.0).otherwise(0.0)).over(item) for c in range(most)]
            score = [F.when(F.lit(c) < F.col("k"), F.log((same[c] + 0.5) / (F.col("n_votes") + 0.5 * F.col("k")))) for c in range(most)]
            y = x
        else:
            y = x.join(logs, ["rater", "family", "l"]).join(F.broadcast(shares), "family")
            score = [F.when(F.lit(c) < F.col("k"), F.sum(f"e{c}").over(item) + F.col(f"s{c}")) for c in range(most)]
        y = y.select(*x.columns, *[s.alias(f"z{c}") for c, s in enumerate(score)])
        top = F.greatest(*[f"z{c}" for c in range(most)])
        y = y.select(*x.columns, *[F.coalesce(F.exp(F.col(f"z{c}") - top), F.lit(0.0)).alias(f"w{c}") for c in range(most)])
        total = sum(F.col(f"w{c}") for c in range(most))
        return y.select(*x.columns, *[(F.col(f"w{c}") / total).alias(f"q{c}") for c in range(most)])

    def counts(q: DataFrame) -> DataFrame:
        own = [F.sum(f"q{c}").alias(f"n{c}") for c in range(most)]
        # votes of an item share its class: weighted by 1/n they count the item once for the shares
        share = [F.sum(F.col(f"q{c}") / F.col("n_votes")).alias(f"m{c}") for c in range(most)]
        return q.groupBy("rater", "family", "l", "k").agg(*own, *share)

    labels = spark.createDataFrame([(f, i) for f, v in classes.items() for i in range(len(v))], "family string, l int")
    n = cut_lineage(counts(posterior(None, None)))
    settled, older = False, None
    for _ in range(rounds):
        grid = n.select("rater", "family", "k").distinct().join(F.broadcast(labels), "family")
        full = grid.join(n.drop("k"), ["rater", "family", "l"], "left")
        alpha = [
            F.coalesce(F.col(f"n{c}"), F.lit(0.0)) + F.when(F.col("l") == c, F.lit(DIAGONAL)).otherwise(F.lit(OFF_DIAGONAL) / (F.col("k") - 1))
            for c in range(most)
        ]
        per = full.select("rater", "family", "l", *[a.alias(f"a{c}") for c, a in enumerate(alpha)])
        row = Window.partitionBy("rater", "family")
        logs = per.select("rater", "family", "l", *[(digamma(F.col(f"a{c}")) - digamma(F.sum(f"a{c}").over(row))).alias(f"e{c}") for c in range(most)])
        share = n.groupBy("family", "k").agg(*[F.sum(f"m{c}").alias(f"m{c}") for c in range(most)])
        shares = share.select("family", *[digamma(F.col(f"m{c}") + CLASS_PRIOR).alias(f"s{c}") for c in range(most)])
        new = cut_lineage(counts(posterior(logs, shares)))
        moved = (
            n.alias("a").join(new.alias("b"), ["rater", "family", "l"], "full")
            .select(
                F.greatest(*[F.abs(F.coalesce(F.col(f"a.n{c}"), F.lit(0.0)) - F.coalesce(F.col(f"b.n{c}"), F.lit(0.0))) for c in range(most)]).alias("d"),
                sum(F.coalesce(F.col(f"b.n{c}"), F.lit(0.0)) for c in range(most)).alias("total"),
            )
            .agg(F.max(F.col("d") / (1 + F.col("total")))).first()[0]
        )
        if older is not None:  # the last but one; the last is still read by the final posterior
            drop_table(older)
        older, n = n, new
        settled = moved is None or moved < tolerance
        if moved is None or moved < tolerance:
            break
    q = posterior(logs, shares) if rounds else posterior(None, None)
    names = F.lit(None)
    best = F.greatest(*[f"q{c}" for c in range(most)])
    pick = F.lit(None).cast("int")
    for c in reversed(range(most)):
        pick = F.when(F.col(f"q{c}") == F.col("confidence"), c).otherwise(pick)
    for family, values in classes.items():
        names = F.when(F.col("family") == family, F.array(*[F.lit(v) for v in values])).otherwise(names)
    items = (
        q.groupBy("item_a", "item_b", "family")
        .agg(F.max("n_votes").alias("n_votes"), *[F.max(f"q{c}").alias(f"q{c}") for c in range(most)])
        .withColumn("confidence", best).withColumn("pick", pick).withColumn("names", names)
        .select("item_a", "item_b", "family", "n_votes", F.get("names", F.col("pick")).alias("label"), "confidence",
                F.array(*[f"q{c}" for c in range(most)]).alias("q"), F.lit(settled).alias("settled"))
    )
    at = F.when(F.col("c") == F.col("l"), F.lit(DIAGONAL)).otherwise(F.lit(OFF_DIAGONAL) / (F.col("k") - 1))
    grid = n.select("rater", "family", "k").distinct().join(F.broadcast(labels), "family")
    full = grid.join(n.drop("k"), ["rater", "family", "l"], "left")
    cells = full.select("rater", "family", "l", "k", F.posexplode(F.array(*[F.coalesce(F.col(f"n{c}"), F.lit(0.0)) for c in range(most)])).alias("c", "seen"))
    confusion = (
        cells.where("c < k").withColumn("names", names)
        .select("rater", "family", F.get("names", F.col("c")).alias("truth"), F.get("names", F.col("l")).alias("label"), (F.col("seen") + at).alias("alpha"))
    )
    return items, confusion


def reliability(confusion: DataFrame) -> DataFrame:
    """Per rater and family: expected share of right labels, balanced over the classes, with a
    95 % posterior interval (normal approximation of the sum of Beta variables)."""
    row = Window.partitionBy("rater", "family", "truth")
    x = confusion.withColumn("total", F.sum("alpha").over(row)).where("truth = label")
    mean = F.col("alpha") / F.col("total")
    x = x.withColumn("mean", mean).withColumn("var", mean * (1 - mean) / (F.col("total") + 1))
    out = x.groupBy("rater", "family").agg(F.avg("mean").alias("reliability"), (F.sqrt(F.sum("var")) / F.count("*")).alias("sd"))
    return out.select(
        "rater",
        "family",
        "reliability",
        F.greatest(F.col("reliability") - 1.96 * F.col("sd"), F.lit(0.0)).alias("low"),
        F.least(F.col("reliability") + 1.96 * F.col("sd"), F.lit(1.0)).alias("high"),
    )


def krippendorff_alpha(votes: DataFrame) -> DataFrame:
    """Nominal Krippendorff alpha per family, from (item, label) counts; items with one vote
    don't take part; null where all votes are alike or no item has two."""
    per = votes.groupBy("family", "item_a", "item_b", "label").agg(F.count("*").alias("n"))
    units = per.groupBy("family", "item_a", "item_b").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same"))
    pairs = units.where("m > 1")
    observed = pairs.groupBy("family").agg(
        F.sum("m").alias("n"), F.count("*").alias("items"), F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("disagree")
    )
    by_label = per.join(pairs.select("family", "item_a", "item_b"), ["family", "item_a", "item_b"]).groupBy("family", "label").agg(F.sum("n").alias("n"))
    chance = by_label.groupBy("family").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("same"))
    both = observed.join(chance, "family")
    expected = (F.col("n") * F.col("n").cast("double") - F.col("same")) / (F.col("n") - 1)
    return both.select("family", "items", F.col("n").alias("votes"), F.when(expected > 0, 1 - F.col("disagree") / expected).alias("alpha"))


# --- human feedback ------------------------------------------------------------------------

#: fixed values: labels of each kind of feedback item
FEEDBACK_CLASSES = {
    "query_relevance": ("relevant", "partially relevant", "not relevant"),
    "human_like": ("yes", "no"),
    "candidate": ("correct", "incorrect"),
}
#: plain synonyms and short forms, after folding to lower-case words
SYNONYMS = {
    "query_relevance": {
        "relevant": ("relevant", "rel", "is relevant", "highly relevant", "fully relevant", "very relevant"),
        "partially relevant": (
            "partially relevant", "partial", "partially", "part relevant", "partly relevant", "partly", "part", "part rel", "partially rel", "partial rel",
            "somewhat relevant", "partial relevance", "partial relevant",
        ),
        "not relevant": ("not relevant", "irrelevant", "non relevant", "nonrelevant", "not rel", "not", "no relevance", "irrel", "non rel", "is not relevant", "unrelated", "nr"),
    },
    "human_like": {
        "yes": ("yes", "y", "yep", "yeah", "true", "human like", "is human like", "ja", "ok"),
        "no": ("no", "n", "nope", "nah", "false", "not human like", "non", "not"),
    },
    "candidate": {
        "correct": ("correct", "corr", "is correct", "right", "true", "ok", "yes", "y"),
        "incorrect": ("incorrect", "not correct", "wrong", "false", "incorr", "is incorrect", "is not correct", "non correct", "not right", "is wrong", "no", "n"),
    },
}


def read_judgements(feedback: DataFrame) -> DataFrame:
    """Feedback rows as item_a, item_b, rater, family, words, label, updated_at, id: names folded to
    lower-case letters and digits before any "@", judgements to lower-case words. label is
    null where the judgement can't be read, rater where the name has no letter or digit."""
    item = F.col("feedback_item_id")
    family = (
        F.when(item == "query_relevance", F.lit("query_relevance"))
        .when(item == "human_like", F.lit("human_like"))
        .when(item.rlike(r"^cand_\d+$"), F.lit("candidate"))
    )
    words = F.trim(F.regexp_replace(F.lower("judgement"), r"(?U)[^\p{L}\p{N}]+", " "))
    x = feedback.select(
        F.col("query_id").alias("item_a"),
        item.alias("item_b"),
        F.nullif(F.regexp_replace(F.lower(F.split("reviewer_username", "@")[0]), r"(?U)[^\p{L}\p{N}]+", ""), F.lit("")).alias("rater"),
        family.alias("family"),
        words.alias("words"),
        "updated_at",
        "id",
    )
    label = F.lit(None).cast("string")
    for name, labels in SYNONYMS.items():
        for value, forms in labels.items():
            label = F.when((F.col("family") == name) & F.col("words").isin(*forms), F.lit(value)).otherwise(label)
    return x.withColumn("label", label)


def unreadable_judgements(feedback: DataFrame) -> DataFrame:
    """family, words and number of rows of every judgement that isn't read as a label; words is
    null for a null judgement, family for an item of no known kind."""
    x = read_judgements(feedback.dropDuplicates(["id"])).where("label IS NULL")
    return x.groupBy("family", "words").agg(F.count("*").alias("n"))


def feedback_votes(feedback: DataFrame) -> DataFrame:
    """Readable judgements as votes: one per item and person, the one of latest ``updated_at``
    (ties: larger id). Rows without item, name or readable judgement are left out."""
    x = read_judgements(feedback).where("label IS NOT NULL AND rater IS NOT NULL AND item_a IS NOT NULL")
    latest = x.groupBy("item_a", "item_b", "rater", "family").agg(F.max(F.struct("updated_at", "id", "label")).alias("last"))
    return latest.select("item_a", "item_b", "rater", "family", F.col("last.label").alias("label"))


def feedback_consensus(feedback: DataFrame, min_raters: int = 3) -> DataFrame:
    """Consensus per (query_id, feedback_item_id) that at least ``min_raters`` people judged
    readably; the model is fitted on all readable votes, items with fewer included."""
    items, _ = variational_consensus(feedback_votes(feedback), FEEDBACK_CLASSES)
    return items.where(F.col("n_votes") >= min_raters).select(
        F.col("item_a").alias("query_id"), F.col("item_b").alias("feedback_item_id"), F.col("label").alias("judgement"), "confidence", "n_votes", "settled"
    )
