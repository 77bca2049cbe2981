"""Splitting oversized items at natural boundaries, by recursive bisection.

A token is a maximal run of characters without the Unicode property White_Space, after
NUL characters are removed. Three stages:

1. *Row profile* (map side): token count of every row and its boundaries, packed as
   (token index, strength) pairs; the text itself stays where it is.
2. *Plan*: a running token count gives each row its place in its item. Rows are ordered by
   ranges, so the rows of one item may lie in many tasks, each of which adds the tokens of
   the tasks before it. Items of at most ``block_tokens`` tokens are bisected in one step
   from their row profiles, numbers of about a twentieth of the text. Longer ones are
   first bisected level by level through joins, each cut the same as in one step, until
   the spans are as short; so the result doesn't depend on how an item was cut up.
3. *Materialise*: rows are cut into fragments on a fixed token grid and joined with the
   pieces on (item, grid cell); one long item spreads over as many keys as it has cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.staging import spread
from folioforge.session import cut_lineage

LIMIT, OVERLAP = 512, 128
BLOCK_TOKENS = 1 << 18
GRID = 1024

#: Unicode White_Space, fixed values
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_CLASS = "".join(f"\\u{c:04x}" for c in WHITE)
TOKEN_RE = f"[^{WHITE_CLASS}]+"

#: boundary strengths
SENTENCE, LINE, PARAGRAPH, HEADING = 1, 2, 3, 4

_IS_WHITE = np.zeros(0x110000, dtype=bool)
_IS_WHITE[WHITE] = True
_IS_END = np.zeros(0x110000, dtype=bool)
_IS_END[[ord(c) for c in ".!?…。！？"]] = True
_IS_CLOSE = np.zeros(0x110000, dtype=bool)
_IS_CLOSE[[ord(c) for c in "\"')]}’”»"]] = True
_IS_BREAK = np.zeros(0x110000, dtype=bool)
_IS_BREAK[[0x0A, 0x0B, 0x0C, 0x85, 0x2028, 0x2029]] = True
_NOT_HEADING_END = np.zeros(0x110000, dtype=bool)
_NOT_HEADING_END[[ord(c) for c in ".!?;:,…"]] = True
_BULLET = np.zeros(0x110000, dtype=bool)
_BULLET[[ord(c) for c in "-*•(–—"]] = True
HEADING_WORDS = 10


def n_tokens(text: Column) -> Column:
    """Token count as a JVM expression; null for null."""
    return F.regexp_count(F.translate(text, "\0", ""), F.lit(TOKEN_RE))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.replace("\0", "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def token_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the tokens in code points."""
    ink = np.concatenate(([False], ~_IS_WHITE[cp], [False]))
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[0::2], edge[1::2]


def boundaries(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes before which a natural boundary lies, and the strengths. Index 0 stands
    for the row's own start and is always a paragraph, or a heading."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    strength = np.zeros(n, np.uint8)
    last = cp[ends - 1]
    for _ in range(2):  # look behind closing quotes and brackets
        step = _IS_CLOSE[last] & (ends - 2 >= starts)
        if not step.any():
            break
        last = np.where(step, cp[np.maximum(ends - 2, 0)], last)
    strength[1:][_IS_END[last[:-1]]] = SENTENCE
    # CR LF counts as one break, so only LF and the other single breaks are counted
    breaks = np.concatenate(([0], np.cumsum(_IS_BREAK[cp])))
    gaps = breaks[starts[1:]] - breaks[ends[:-1]]
    strength[1:][gaps == 1] = LINE
    strength[1:][gaps >= 2] = PARAGRAPH
    strength[0] = PARAGRAPH
    line = np.flatnonzero(strength >= LINE)
    words = np.diff(np.append(line, n))
    stop = np.append(line[1:], n) - 1  # last token of each line
    hashes = cp[starts[line]] == ord("#")
    short = (words <= HEADING_WORDS) & ~_NOT_HEADING_END[cp[ends[stop] - 1]] & ~_BULLET[cp[starts[line]]] & (strength[line] == PARAGRAPH)
    short &= np.append(strength[line[1:]] >= LINE, False) if len(line) else False
    strength[line[hashes | short]] = HEADING
    at = np.flatnonzero(strength)
    return at.astype(np.uint32), strength[at]


def pack(at: np.ndarray, strength: np.ndarray) -> bytes:
    return ((at.astype(np.uint32) << 3) | strength).astype("<u4").tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, dtype="<u4")
    return (both >> 3).astype(np.int64), (both & 7).astype(np.int64)


def bisect(lo: int, hi: int, at: np.ndarray, strength: np.ndarray, most: int, first_most: int) -> list[tuple[int, int]]:
    """Cut [lo, hi) into cores of at most ``most`` tokens (the one at the item's start:
    ``first_most``). Each cut takes the strongest boundary in the middle half of the span,
    among equals the nearest to the midpoint, then the earlier; with none, the midpoint."""
    done: list[tuple[int, int]] = []
    stack = [(lo, hi)]
    while stack:
        a, b = stack.pop()
        if b - a <= (first_most if a == 0 else most):
            done.append((a, b))
            continue
        mid, quarter = (a + b) / 2, (b - a) / 4
        i, j = np.searchsorted(at, [int(np.ceil(mid - quarter)), int(mid + quarter) + 1])
        if i < j:
            near = np.abs(at[i:j] - mid)
            best = i + int(np.lexsort((near, -strength[i:j]))[0])
            cut = int(at[best])
        else:
            cut = int(mid)
        cut = min(max(cut, a + 1), b - 1)
        stack.append((cut, b))
        stack.append((a, cut))
    return done


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts, blobs = [], []
        for text in pdf["text"]:
            cp = code_points(text or "")
            starts, ends = token_spans(cp)
            counts.append(len(starts))
            blobs.append(pack(*boundaries(cp, starts, ends)))
        yield pdf.drop(columns="text").assign(n_tokens=np.array(counts, np.int64), marks=blobs)


def row_profiles(rows: DataFrame) -> DataFrame:
    """(item_kind, item_id, part, row_no, text) -> the same with ``n_tokens``, ``marks`` and a
    64-bit ``text_hash`` in place of the text. Null texts count as empty."""
    x = rows.select("item_kind", "item_id", "part", "row_no", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    schema = "item_kind string, item_id string, part string, row_no int, text_hash long, n_tokens long, marks binary"
    return spread(x).mapInPandas(_profile, schema)


ITEM = ["item_kind", "item_id"]


def placed_rows(profiles: DataFrame) -> DataFrame:
    """Profiles with ``first_token`` (tokens of the item before the row) and ``item_tokens``;
    rows delivered twice are dropped. Nothing but numbers crosses the shuffle, and a task sorts
    a range of rows, not an item."""
    order = [*ITEM, "part", "row_no", "text_hash"]
    x = cut_lineage(profiles)  # ranges are found from a sample of it
    x = cut_lineage(x.repartitionByRange(*order).dropDuplicates(order).withColumn("range", F.spark_partition_id()))
    own = x.groupBy(*ITEM, "range").agg(F.sum("n_tokens").alias("n"))
    over = Window.partitionBy(*ITEM)
    before = F.coalesce(F.sum("n").over(over.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select(*ITEM, "range", before.alias("base"), F.sum("n").over(over).alias("item_tokens"))  # a row an item and range
    inside = F.sum("n_tokens").over(Window.partitionBy(*ITEM, "range").orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("x")
    o = own.alias("o")
    same = (F.col("x.item_kind") == F.col("o.item_kind")) & F.col("x.item_id").eqNullSafe(F.col("o.item_id")) & (F.col("x.range") == F.col("o.range"))
    return x.join(o, same).select("x.*", (F.col("base") + F.col("inside")).alias("first_token"), "item_tokens").drop("range", "inside")


def _middle(a: Column, b: Column) -> tuple[Column, Column]:
    """First and last token of the middle half of a span."""
    mid, quarter = (a + b) / 2, (b - a) / 4
    return F.ceil(mid - quarter), F.floor(mid + quarter)


def long_spans(placed: DataFrame, block_tokens: int) -> tuple[DataFrame, DataFrame] | None:
    """(spans, marks) of the items above ``block_tokens``, if any: spans item_kind, item_id, a, b of at
    most that size, cut level by level like ``bisect``; marks item_kind, item_id, at, strength.

    Spans and marks meet on a grid of block_tokens, so the marks of one item spread over tasks."""
    giant = placed.where((F.col("item_tokens") > block_tokens) & (F.col("n_tokens") > 0))
    if giant.limit(1).count() == 0:
        return None

    @F.pandas_udf("array<struct<at:long,strength:int>>")
    def unpacked(marks: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([[{"at": int(a + f), "strength": int(s)} for a, s in zip(*unpack(m))] for m, f in zip(marks, first)])

    marks = cut_lineage(giant.select(*ITEM, F.explode(unpacked("marks", "first_token")).alias("m")).select(*ITEM, "m.at", "m.strength", F.floor(F.col("m.at") / block_tokens).alias("cell")))
    spans = giant.select(*ITEM, F.lit(0).cast("long").alias("a"), F.col("item_tokens").alias("b")).distinct()
    while True:
        spans = cut_lineage(spans)
        wide = spans.where(F.col("b") - F.col("a") > block_tokens)
        if wide.limit(1).count() == 0:
            return spans, marks
        lo, hi = _middle(F.col("a"), F.col("b"))
        grid = wide.withColumn("cell", F.explode(F.sequence(F.floor(lo / block_tokens), F.floor(hi / block_tokens)))).alias("s")
        m = marks.alias("m")
        meet = (F.col("s.cell") == F.col("m.cell")) & (F.col("s.item_kind") == F.col("m.item_kind")) & F.col("s.item_id").eqNullSafe(F.col("m.item_id"))
        near = -F.abs(F.col("m.at") - (F.col("s.a") + F.col("s.b")) / 2)
        best = grid.join(m, meet, "left").select(
            "s.item_kind", "s.item_id", "s.a", "s.b",
            F.when(F.col("m.at").between(*_middle(F.col("s.a"), F.col("s.b"))), F.struct("m.strength", near.alias("near"), (-F.col("m.at")).alias("at"))).alias("mark"),
        )
        cuts = best.groupBy(*ITEM, "a", "b").agg(F.max("mark").alias("mark"))
        cut = F.coalesce(-F.col("mark.at"), F.floor((F.col("a") + F.col("b")) / 2))
        cut = F.least(F.greatest(cut, F.col("a") + 1), F.col("b") - 1)
        halves = F.array(F.struct(F.col("a").alias("a"), cut.alias("b")), F.struct(cut.alias("a"), F.col("b").alias("b")))
        cut_up = cuts.select(*ITEM, F.explode(halves).alias("h")).select(*ITEM, "h.a", "h.b")
        spans = spans.where(F.col("b") - F.col("a") <= block_tokens).unionByName(cut_up)


def plan_pieces(placed: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The pieces of every item above ``limit``: item_kind, item_id, piece_no, core start and end,
    and the start with overlap, in tokens of the item. Items within the limit give no rows."""
    most = limit - overlap
    core = "array<struct<core_start:long,core_end:long>>"

    @F.pandas_udf(core)
    def cut_rows(rows: pd.Series) -> pd.Series:
        out = []
        for group in rows:
            group = sorted(group, key=lambda r: r["first_token"])
            ats, strengths = [], []
            for r in group:
                at, strength = unpack(r["marks"])
                ats.append(at + r["first_token"])
                strengths.append(strength)
            cores = bisect(0, group[-1]["first_token"] + group[-1]["n_tokens"], np.concatenate(ats), np.concatenate(strengths), most, limit)
            out.append([{"core_start": a, "core_end": b} for a, b in cores])
        return pd.Series(out)

    @F.pandas_udf(core)
    def cut_span(lo: pd.Series, hi: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for a, b, m in zip(lo, hi, marks):
            m = sorted((r["at"], r["strength"]) for r in m)
            at, strength = (np.array(v, np.int64) for v in zip(*m)) if m else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            out.append([{"core_start": x, "core_end": y} for x, y in bisect(int(a), int(b), at, strength, most, limit)])
        return pd.Series(out)

    short = placed.where((F.col("item_tokens") > limit) & (F.col("item_tokens") <= block_tokens) & (F.col("n_tokens") > 0))
    rows = short.groupBy(*ITEM).agg(F.collect_list(F.struct("first_token", "n_tokens", "marks")).alias("rows"))
    cores = rows.select(*ITEM, F.posexplode(cut_rows("rows")).alias("piece_no", "c")).withColumn("piece_no", F.col("piece_no").cast("long"))
    if (long := long_spans(placed, block_tokens)) is not None:
        spans, marks = long
        s = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / block_tokens), F.floor((F.col("b") - 1) / block_tokens)))).alias("s")
        m = marks.alias("m")
        meet = (F.col("s.cell") == F.col("m.cell")) & (F.col("s.item_kind") == F.col("m.item_kind")) & F.col("s.item_id").eqNullSafe(F.col("m.item_id"))
        inside = F.when((F.col("m.at") >= F.col("s.a")) & (F.col("m.at") < F.col("s.b")), F.struct("m.at", "m.strength"))
        own = s.join(m, meet, "left").groupBy("s.item_kind", "s.item_id", "s.a", "s.b").agg(F.collect_list(inside).alias("marks"))
        own = own.withColumn("cores", cut_span("a", "b", "marks"))
        order = Window.partitionBy(*ITEM).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
        own = own.withColumn("base", F.coalesce(F.sum(F.size("cores")).over(order), F.lit(0)))
        own = own.select(*ITEM, "base", F.posexplode("cores").alias("place", "c")).select(*ITEM, (F.col("base") + F.col("place")).alias("piece_no"), "c")
        cores = cores.unionByName(own)
    return cores.select(*ITEM, "piece_no", "c.core_start", "c.core_end", F.greatest(F.col("c.core_start") - overlap, F.lit(0)).alias("start"))


def paper_rows(records: DataFrame) -> DataFrame:
    """Corpus shard rows as rows of items; a paper's rows are ordered by (source_path, row_no)."""
    return records.select(
        F.lit("paper").alias("item_kind"),
        F.concat_ws("::", "representation_type", "paper_id").alias("item_id"),
        F.col("source_path").alias("part"),
        F.col("row_no").cast("int").alias("row_no"),
        "text",
    )


def chunk_rows(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Existing chunks of more than ``limit`` tokens, by the text's own count, as one-row items."""
    return chunks.where(n_tokens(F.col("text")) > limit).select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.lit("").alias("part"), F.lit(0).alias("row_no"), "text"
    )


def _grid_fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for kind, item, first, text in zip(pdf["item_kind"], pdf["item_id"], pdf["first_token"], pdf["text"]):
            text = (text or "").replace("\0", "")
            starts, ends = token_spans(code_points(text))
            n = len(starts)
            a = 0
            while a < n:
                b = min(n, (first + a) // GRID * GRID + GRID - first)
                out.append((kind, item, (first + a) // GRID, first + a, first + b, a == 0, text[starts[a] : (starts[b] if b < n else ends[-1])]))
                a = b
        yield pd.DataFrame(out, columns=["item_kind", "item_id", "cell", "frag_start", "frag_end", "row_start", "frag"])


def split_items(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all items: item_kind, item_id, piece_no (0-based), text, token_count, overlap_tokens.

    ``rows`` has item_kind, item_id, part, row_no, text. Items of at most ``limit`` tokens
    come out whole, items without a token not at all. White space inside a piece is kept;
    rows are joined by a blank line. Null text counts as empty, identical rows count once,
    null ids are items of their own. Extra columns are ignored.
    """
    rows = rows.select("item_kind", "item_id", "part", "row_no", "text")
    placed = placed_rows(row_profiles(rows))
    long = plan_pieces(placed, limit, overlap, block_tokens)
    nought = F.lit(0).cast("long")
    whole = placed.where(F.col("item_tokens").between(1, limit)).select(
        *ITEM, nought.alias("piece_no"), nought.alias("core_start"), F.col("item_tokens").alias("core_end"), nought.alias("start")
    )
    pieces = long.unionByName(whole.distinct())
    cells = pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / GRID), F.floor((F.col("core_end") - 1) / GRID))))

    key = ["item_kind", "item_id", "part", "row_no", "text_hash"]
    texts = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    at = placed.where("n_tokens > 0").select(*key, "first_token")
    # one row per place: the copies of a row that came twice are dropped beside its key
    joined = texts.alias("t").join(
        at.alias("p"),
        (F.col("t.text_hash") == F.col("p.text_hash")) & F.col("t.item_id").eqNullSafe(F.col("p.item_id")) & (F.col("t.item_kind") == F.col("p.item_kind"))
        & F.col("t.part").eqNullSafe(F.col("p.part")) & F.col("t.row_no").eqNullSafe(F.col("p.row_no")),
    ).select("p.*", "t.text").dropDuplicates(key)
    frags = joined.select("item_kind", "item_id", "first_token", "text").mapInPandas(
        _grid_fragments, "item_kind string, item_id string, cell long, frag_start long, frag_end long, row_start boolean, frag string"
    )

    @F.pandas_udf("string")
    def cut_out(frag: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for text, i, j in zip(frag, a, b):
            starts, ends = token_spans(code_points(text))
            # a fragment keeps the white space after its last token where the row goes on
            out.append(text[starts[i] : (len(text) if j >= len(starts) else starts[j])])
        return pd.Series(out)

    f, c = frags.alias("f"), cells.alias("c")
    hits = c.join(
        f, (F.col("c.cell") == F.col("f.cell")) & F.col("c.item_id").eqNullSafe(F.col("f.item_id")) & (F.col("c.item_kind") == F.col("f.item_kind"))
    ).where((F.col("f.frag_start") < F.col("c.core_end")) & (F.col("f.frag_end") > F.col("c.start")))
    a = F.greatest(F.col("f.frag_start"), F.col("c.start"))
    b = F.least(F.col("f.frag_end"), F.col("c.core_end"))
    cut = hits.select(
        "c.item_kind", "c.item_id", "c.piece_no", "c.core_start", "c.core_end", "c.start", a.alias("a"),
        F.when(F.col("f.row_start") & (a == F.col("f.frag_start")) & (a > F.col("c.start")), F.lit("\n\n")).otherwise(F.lit("")).alias("glue"),
        cut_out("f.frag", a - F.col("f.frag_start"), b - F.col("f.frag_start")).alias("part_text"),
    )
    built = cut.groupBy("item_kind", "item_id", "piece_no", "core_start", "core_end", "start").agg(
        F.array_sort(F.collect_list(F.struct("a", "glue", "part_text"))).alias("parts")
    )
    text = F.regexp_replace(
        F.array_join(F.transform("parts", lambda p: F.concat(p["glue"], p["part_text"])), ""),
        f"[{WHITE_CLASS}]+$", "",
    )
    return built.select(
        "item_kind",
        "item_id",
        F.col("piece_no").cast("int").alias("piece_no"),
        text.alias("text"),
        (F.col("core_end") - F.col("start")).cast("int").alias("token_count"),
        (F.col("core_start") - F.col("start")).cast("int").alias("overlap_tokens"),
    )


def corpus_rows(records: DataFrame, chunks: DataFrame, limit: int = 0) -> DataFrame:
    """Assembled papers and existing chunks of more than ``limit`` tokens together."""
    return paper_rows(records).unionByName(chunk_rows(chunks, limit))
