"""Mixing sources to target weights, by min-cost flow over membership patterns.

Exact copies of a text may lie in several sources. Texts are grouped by the set of sources
they occur in; a pattern offers its tokens once for every level of use (first use, second
use, ...). Flow runs from (pattern, level) to sources, a level being open to a source up to
the source's cap, and from sources to their quotas. Later levels cost more (convex), so
repetition is used only where first uses don't suffice. The network has patterns x levels x
sources arcs and is solved on the driver; the texts themselves are then selected by their
place in a seeded order, found from a histogram and running sums inside its buckets.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import tokens
from folioforge.session import cut_lineage


class Flow:
    """Maximum flow by shortest augmenting paths; sources of flow can be added in rounds."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.arcs: list[list[int]] = []

    def node(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            via: dict[int, int] = {s: -1}
            todo = deque([s])
            while todo and t not in via:
                x = todo.popleft()
                for a in self.arcs[x]:
                    if self.room[a] > 0 and self.to[a] not in via:
                        via[self.to[a]] = a
                        todo.append(self.to[a])
            if t not in via:
                return total
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[a] for a in path)
            for a in path:
                self.room[a] -= push
                self.room[a ^ 1] += push
            total += push


def route(patterns: Mapping[tuple[str, ...], int], quotas: Mapping[str, int], caps: Mapping[str, int]) -> dict[tuple[tuple[str, ...], int, str], int]:
    """Tokens by (pattern, level, source). All arcs of a level cost the same and later levels cost
    more, so adding the levels one after the other and augmenting after each is a successive
    shortest path solution, hence of least cost."""
    g = Flow()
    s, t = g.node(), g.node()
    at = {name: g.node() for name in quotas}
    for name, quota in quotas.items():
        g.arc(at[name], t, quota)
    arcs = {}
    for level in range(1, max(caps.values(), default=0) + 1):
        for pattern, size in patterns.items():
            open_to = [x for x in pattern if x in at and caps[x] >= level]
            if open_to and size > 0:
                n = g.node()
                g.arc(s, n, size)
                for x in open_to:
                    arcs[pattern, level, x] = g.arc(n, at[x], size)
        g.run(s, t)
    return {k: g.room[a ^ 1] for k, a in arcs.items() if g.room[a ^ 1] > 0}


def largest_total(patterns: Mapping[tuple[str, ...], int], shares: Mapping[str, float], caps: Mapping[str, int]) -> int:
    """The largest total at which every source's quota can be met, by bisection."""
    high = min((sum(n for p, n in patterns.items() if x in p) * caps[x] / share for x, share in shares.items()), default=0)
    low, high = 0, int(high)

    def met(total: int) -> bool:
        quotas = {x: int(total * share) for x, share in shares.items()}
        return sum(route(patterns, quotas, caps).values()) >= sum(quotas.values())

    if met(high):
        return high
    while high - low > max(1, high // 10_000):
        mid = (low + high) // 2
        low, high = (mid, high) if met(mid) else (low, mid)
    return low


def source_key(source: Column) -> Column:
    """Sources are the same up to case, white space around and separators."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-./]+", "_"), F.lit(""))


def mix(sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for sizes (doc_id, source, text_key, n_tokens) and weights (source,
    target_share, max_repeats).

    selection: doc_id, source, repeats, n_tokens; report: source, target_share (normalised over
    the named sources), available_tokens, tokens, share, documents, most_repeats. Exact copies
    of a text within a source are one document (the smallest id). Documents without tokens or
    of a source without weight aren't used. Null or negative shares and caps count as 0.
    Without ``total_tokens`` the total is the largest at which every source that has text
    meets its share; a source without text is reported with share 0.
    """
    spark = sizes.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for row in weights.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect():
        if row["source"] is not None:
            wanted[row["source"]] = (max(0.0, row["w"] or 0.0), max(0, row["r"] or 0))
    all_shares = sum(w for w, _ in wanted.values()) or 1.0

    x = sizes.select(F.col("doc_id"), source_key(F.col("source")).alias("source"), "text_key", F.col("n_tokens").cast("long").alias("n_tokens"))
    x = x.where((F.col("n_tokens") > 0) & F.col("source").isin(*wanted) & F.col("doc_id").isNotNull() & F.col("text_key").isNotNull())
    # one row per text and source: copies collapse map-side, however many there are
    by_source = x.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = by_source.groupBy("text_key").agg(
        F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("homes")
    )  # at most one entry a source
    texts = texts.withColumn("pattern", F.transform("homes", lambda h: h["source"]))
    order = F.xxhash64(F.lit(seed), "text_key")
    texts = cut_lineage(texts.withColumn("turn", order))
    buckets = isqrt(texts.count()) + 1  # so neither a bucket nor the list of a pattern's buckets grows like the texts
    texts = texts.withColumn("bucket", F.pmod(F.shiftright("turn", 20), F.lit(buckets)))

    patterns = {tuple(r["pattern"]): int(r["n"]) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    caps = {s: r for s, (_, r) in wanted.items()}
    usable = {s: w for s, (w, r) in wanted.items() if w > 0 and r > 0 and any(s in p for p in patterns)}
    whole = sum(usable.values()) or 1.0
    shares = {s: w / whole for s, w in usable.items()}
    total = largest_total(patterns, shares, caps) if total_tokens is None else total_tokens
    flow = route(patterns, {s: int(total * share) for s, share in shares.items()}, caps)

    # Along a pattern's seeded order each level gives consecutive stretches of tokens to sources.
    stretches, ends = [], {}
    for (pattern, level, source), n in sorted(flow.items()):
        start = ends.get((pattern, level), 0)
        stretches.append((list(pattern), level, source, start, start + n))
        ends[pattern, level] = start + n
    plan = spark.createDataFrame(stretches, "pattern array<string>, level int, credit string, lo long, hi long")
    plan = plan.groupBy("pattern").agg(F.collect_list(F.struct("level", "credit", "lo", "hi")).alias("stretches"))

    heights = texts.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    heights = heights.select("pattern", "bucket", F.coalesce(before, F.lit(0)).alias("base"))  # patterns x buckets rows
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("turn", "text_key").rowsBetween(Window.unboundedPreceding, -1))
    placed = texts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(heights, ["pattern", "bucket"])
    # A text is used where its middle lies, so that stretches err by half a text at either end.
    placed = placed.withColumn("place", F.col("base") + F.col("inside") + F.col("n_tokens") / 2).join(F.broadcast(plan), "pattern")
    uses = placed.withColumn("use", F.explode(F.filter("stretches", lambda s: (s["lo"] <= F.col("place")) & (F.col("place") < s["hi"]))))
    home = F.element_at(F.map_from_entries("homes"), F.col("use.credit"))
    selection = uses.groupBy("text_key", home.alias("doc_id"), F.col("use.credit").alias("source")).agg(
        F.count("*").cast("int").alias("repeats"), F.max("n_tokens").alias("n_tokens")
    ).select("doc_id", "source", "repeats", "n_tokens")
    selection = cut_lineage(selection)

    got = selection.groupBy("source").agg(
        F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats")
    )
    target = spark.createDataFrame(
        [(s, w / all_shares, r, sum(n for p, n in patterns.items() if s in p)) for s, (w, r) in wanted.items()],
        "source string, target_share double, max_repeats int, available_tokens long",
    )
    report = target.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    everything = F.sum("tokens").over(Window.partitionBy())  # one row a source
    return selection, report.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), everything), F.lit(0.0)))


def document_mix(documents: DataFrame, weights: DataFrame, total_tokens: int | None = None, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Documents drawn by source to the weights, in tokens of a public tokenizer."""
    keyed = documents.select("doc_id", "source", F.md5(F.trim("text").cast("binary")).alias("text_key"), "text")
    return mix(tokens.with_token_counts(keyed, path=vocabulary), weights, total_tokens)
