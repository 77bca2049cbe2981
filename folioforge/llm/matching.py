"""Matching entities across two sources without a common key, by loopy belief propagation.

1. *Normalise* both sides (Arrow batches): folded titles without decorations, the part
   after a "Name:", number signature, surnames, catalogue id. Letters of every script are
   kept; Latin accents come off. Listings alike in all of it are one listing.
2. *Block* by equi-joins. Listings of two and more surnames meet works on a pair of
   surnames, those of one on surname and title words, those without on the title; ids and,
   for works without names, titles join all. Hot keys are split by a salt on the side that
   has many rows while the other side is replicated to the salts.
3. *Score* each candidate pair: log odds from title alignment, authors, year and id.
4. *Propagate*: each pair is a binary variable with two at-most-one factors. A listing
   stands for at most one work. A work is at most one listed entity: listings without a
   contradiction to the work describe the same entity, every other listing is one of
   its own (those with the same id together), and of the entities of a work at most one
   is the work. Pairs without a rival are settled at once; for the others messages are
   exchanged by group-bys until no marginal moves.

Blocking by two surnames loses nothing that scoring could accept: with one common name of
two or more, a pair of different ids stays under even odds (see ``pair_evidence``).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.staging import staged
from folioforge.session import cut_lineage

#: rounds that end a run which doesn't settle; pairs that still move are reported as such
ROUNDS, TOLERANCE = 60, 1e-3
THRESHOLD = 0.5
HOT_KEY, SALT_ROWS = 2_000, 1_000
#: first letters that are a key beside a surname, the fewest of a cut title that scoring reads; and
#: without names, where fewer are never enough evidence
START, LONG_START = 5, 20

_DECORATION = re.compile(
    r"^\s*(?:\[(?:pdf|html|book|doc|ps|citation|b|c)\]\s*)+|[(\[](?:preprint|pre-print|extended abstract|short paper|poster|workshop(?: version| paper)?|technical report|draft|v\d+|"
    r"(?:arxiv|conference|journal|extended|full)(?: version| preprint)?|demo|abstract|supplementary|accepted)[)\]]\s*$",
    re.I,
)
_CUT = re.compile(r"(?:…|\.{2,})[\"'”) ]*$")
_TAG = re.compile(r"<[^<>]{1,40}>")
_ID = re.compile(r"(?<!\d)(\d{4}\.\d{4,5})(?!\d)|(?<![a-z-])([a-z]+(?:-[a-z]+)?(?:\.[A-Z]{2})?/\d{7})(?!\d)")
#: letters that have no decomposition, and marks of other scripts
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "、": ",", "。": "."})
_NO_SPACES = re.compile("[\u2e80-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
_STOP = frozenset("a an the of for in on with to and or by from at as via under through into its is are using towards toward".split())
_ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5"}


def fold(text: str) -> str:
    """Entities resolved, tags and accents off, lower case; of other scripts the letters and digits."""
    text = unicodedata.normalize("NFKD", _TAG.sub(" ", html.unescape(html.unescape(text)))).lower().translate(_PLAIN)
    return text if text.isascii() else "".join(c for c in text if c.isascii() or c.isalnum() and not unicodedata.combining(c))


def word_parts(word: str) -> list[str]:
    """The word; for scripts without spaces its pairs of neighbouring signs."""
    return [word[i : i + 2] for i in range(len(word) - 1)] or [word] if _NO_SPACES.search(word) else [word]


def title_parts(raw: str | None) -> tuple[str, str, str, bool, list[str], list[str]]:
    """(whole, rest after the first colon, name before it, cut short?, words, words with hyphenated
    compounds as one)."""
    text = html.unescape(html.unescape(raw or "")).replace("‐", "-").replace("–", "-").replace("—", "-").replace("：", ":")
    quotes = " \t\r\n\"'“”‘’​ "
    text, before, cut = text.strip(quotes), None, False
    while before != text:
        before = text
        if _CUT.search(text):
            cut, text = True, _CUT.sub("", text)
        text = _DECORATION.sub("", text).strip(quotes)
    text = fold(text)
    text = re.sub(r"(?<=[a-z]) +4 +(?=[a-z])", " for ", text)
    text = re.sub(r"\bw/ *", "with ", text).replace(" & ", " and ")
    name, colon, rest = text.partition(":")

    def words(s: str) -> list[str]:
        found = re.findall(r"(?:[^\W_]|\+)+", s)
        return [_ROMAN.get(w, w) if i else w for i, w in enumerate(found)]

    def keywords(found: list[str]) -> list[str]:
        return [part for w in found if (len(w) > 2 or not w.isascii()) and w not in _STOP for part in word_parts(w)]

    whole = words(text)
    joined = words(re.sub(r"(?<=\w)-(?=\w)", "", text))
    return "".join(whole), "".join(words(rest)) if colon else "", "".join(words(name)) if colon else "", cut, keywords(whole), keywords(joined)


def single_names(authors: object) -> list[str]:
    """Names one by one: an element may hold a whole list ("A. Bee, C. Dee"), which shows in a
    first part of several words, a semicolon or more than one comma."""
    out: list[str] = []
    for raw in authors if authors is not None else []:
        for piece in re.split(r";| and | & ", fold(raw or "")):
            parts = [p.strip() for p in piece.split(",")]
            several = len(parts) > 2 or (len(parts) == 2 and len(parts[0].split()) > 1 and len(parts[1].split()) > 1)
            out += parts if several else [piece]
    return out


def surnames(authors: object) -> list[str]:
    """One folded surname per name: before a comma, else beside initials, else the last word."""
    out = []
    for text in single_names(authors):
        if "," in text:
            head = re.findall(r"[^\W\d_]+", text.split(",")[0])
            if head:
                out.append("".join(head))
                continue
        words = re.findall(r"[^\W\d_]+", text)
        if words in (["et", "al"], ["others"], ["al"]):
            continue
        long = [w for w in words if len(w) > 1]
        if long:
            out.append(long[0] if len(words[-1]) == 1 else long[-1])
    return sorted(set(out))


def name_words(authors: object) -> list[str]:
    """All folded words of the names that aren't initials."""
    return sorted({w for raw in (authors if authors is not None else []) for w in re.findall(r"[^\W\d_]+", fold(raw or "")) if len(w) > 1})


_SIDE = "sid string, whole string, rest string, name string, cut boolean, words array<string>, joined array<string>, surnames array<string>, people array<string>, code string, year int"


def normalised(df: DataFrame) -> DataFrame:
    """(sid, title, authors, year, ids) to the fields that blocking and scoring read; ``ids`` is a
    string that may hold a catalogue id anywhere. Null titles, authors and years are allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, title, authors, year, ids in zip(pdf["sid"], pdf["title"], pdf["authors"], pdf["year"], pdf["ids"]):
                whole, rest, name, cut, words, joined = title_parts(title)
                code = _ID.search(ids or "")
                year = int(year) if year == year and year is not None and 1900 < year < 2100 else None
                out.append((sid, whole, rest, name, cut, words, joined, surnames(authors), name_words(authors), code.group(0) if code else None, year))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _SIDE.split(", ")])
            yield frame.astype({"year": "Int32"})

    return df.select(F.col("sid").cast("string").alias("sid"), "title", "authors", F.col("year").cast("double").alias("year"), "ids").mapInPandas(run, _SIDE)


def block_keys(side: DataFrame, listings: bool = False) -> DataFrame:
    """(sid, kind, key): the keys by which a row meets the other side.

    ======  ====================================================  =========================
    kind    key                                                   emitted by
    ======  ====================================================  =========================
    pair    two surnames                                          rows of two and more
    word    surname and title word                                listings of one; works
    title   surname and whole title, name or rest                 listings of one; works
    start   surname and first letters of title or rest            listings of one, cut or of
                                                                  under two words; works
    alone   title, rest, first letters of a long title            listings of none; works
    unnamed title, rest                                           listings; works of none
    id      catalogue id                                          all
    ======  ====================================================  =========================

    One common key makes a pair a candidate, but of kind *word* it takes two, or one if the
    listing is cut short or has under two words.
    """
    none = F.array().cast("array<string>")
    named = F.array_sort("surnames")
    n = F.size("surnames")
    spans = F.array_distinct(F.filter(F.array("whole", "name", "rest"), lambda t: F.length(t) > 0))
    titles = F.array_distinct(F.filter(F.array("whole", "rest"), lambda t: F.length(t) > 0))
    starts = F.transform(F.filter(titles, lambda t: F.length(t) >= START), lambda t: F.substring(t, 1, START))
    begun = F.when(F.length("whole") >= LONG_START, F.array(F.substring("whole", 1, LONG_START))).otherwise(none)
    short = F.col("cut") | (F.size("words") < 2)
    one, few = (n == 1, (n == 1) & short) if listings else (n >= 1, n >= 1)
    without = n == 0 if listings else F.lit(True)

    def each(parts: Column) -> Column:
        return F.flatten(F.transform("surnames", lambda s: F.transform(parts, lambda t: F.concat(s, F.lit("|"), t))))

    kinds = {
        "pair": (n >= 2, F.flatten(F.transform(named, lambda a, i: F.transform(F.slice(named, i + 2, F.greatest(n, F.lit(1))), lambda b: F.concat(a, F.lit("&"), b))))),
        "word": (one, each(F.array_union("words", "joined"))),
        "title": (one, each(spans)),
        "start": (few, each(F.transform(starts, lambda t: F.concat(F.lit("^"), t)))),
        "alone": (without, F.concat(titles, F.transform(begun, lambda t: F.concat(F.lit("^"), t)))),
        "unnamed": (F.lit(True) if listings else n == 0, titles),
        "id": (F.col("code").isNotNull(), F.array("code")),
    }

    def tag(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    tagged = [F.when(when, tag(kind, keys)) for kind, (when, keys) in kinds.items()]
    blank = F.array().cast("array<struct<kind:string,key:string>>")
    x = side.select("sid", short.alias("short"), F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(t, blank) for t in tagged])))).alias("k"))
    enough = (F.col("k.kind") != "word") | F.col("short")
    return x.select("sid", enough.alias("enough"), F.xxhash64("k.kind", "k.key").alias("key"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (lid, rid) with the common keys that ``block_keys`` asks for. Keys with more than ``HOT_KEY`` rows on
    the left are salted there by id hash and the right side is replicated, so a hot key spreads over tasks."""
    lk, rk = block_keys(left, listings=True).withColumnRenamed("sid", "lid"), block_keys(right).select(F.col("sid").alias("rid"), "key")
    hot = lk.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    lk = lk.join(hot, "key", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("lid"), F.col("salts")).cast("int")))
    rk = rk.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    hits = lk.select("key", "salt", "lid", "enough").join(rk.select("key", "salt", "rid"), ["key", "salt"])
    both = hits.groupBy("lid", "rid").agg(F.count("*").alias("n"), F.max("enough").alias("enough"))
    return both.where("enough OR n >= 2").select("lid", "rid")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9+]", "")


MOST_EDITS = 5


def title_edits(x: DataFrame) -> DataFrame:
    """Adds d_whole, d_rest, d_name, d_begun, d_begun_rest: edits between the listing's title and
    the work's whole title, its part after the colon, its name before it, or their beginnings
    if the listing is cut short. 99 where they are far or their numbers (parts of a series)
    differ."""

    def edits(a: Column, b: Column) -> Column:
        d = F.levenshtein(a, b, MOST_EDITS)
        return F.when((F.length(b) > 0) & (_digits(a) == _digits(b)) & (d >= 0), d).otherwise(99)

    mine, n = F.col("l_whole"), F.length("l_whole")

    def begun(other: str) -> Column:
        near = [edits(mine, F.substring(other, F.lit(1), n + k)) for k in (0, 1, -1)]
        return F.when(F.col("l_cut") & (n >= 5) & (F.length(other) >= 12), F.least(*near)).otherwise(99)

    x = staged(x, d_whole=F.when(n > 0, edits(mine, F.col("r_whole"))).otherwise(99))
    # a reading that costs at most one edit can't be beaten by the weaker ones
    x = x.withColumn("l_cut", F.col("l_cut") & (F.col("d_whole") > 1))
    return staged(
        x,
        d_rest=F.when(F.length("r_rest") >= 12, edits(mine, F.col("r_rest"))).otherwise(99),
        d_name=F.when(F.length("r_name") >= 5, edits(mine, F.col("r_name"))).otherwise(99),
        d_begun=begun("r_whole"),
        d_begun_rest=begun("r_rest"),
    )


def title_evidence() -> Column:
    """Log odds of the titles from their edits; -12 if no reading fits."""
    n = F.length("l_whole")
    allowed = F.when(n < 12, 1).when(n < 25, 2).otherwise(4)

    def graded(d: str, best: Column) -> Column:
        return F.when(F.col(d) > allowed, F.lit(-12.0)).otherwise(best - 0.8 * F.col(d))

    short = F.when(n < 20, 2.0).otherwise(0.0)
    return F.greatest(
        graded("d_whole", F.lit(7.0)), graded("d_rest", F.lit(6.0)), graded("d_name", F.lit(3.0)),
        graded("d_begun", 5.5 - short), graded("d_begun_rest", 4.5 - short),
    )


def pair_evidence(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid, entity, prior): prior log odds of each pair; hopeless pairs (under -4) are left out,
    as messages only lower them. ``entity`` is 0 for a listing without a contradiction to the work
    (a reading of the title fits, all names, year within two; what is unknown contradicts nothing), else a
    key of its id or its own."""
    own = ("sid", "whole", "cut", "surnames", "code", "year")
    theirs = ("sid", "whole", "rest", "name", "people", "code", "year")
    x = pairs.join(left.select(*[F.col(c).alias(f"l_{c}") for c in own]), F.col("lid") == F.col("l_sid"))
    x = x.join(right.select(*[F.col(c).alias(f"r_{c}") for c in theirs]), F.col("rid") == F.col("r_sid"))
    # most pairs share one of several names and end here, before any title is compared
    named = F.size("l_surnames")
    x = staged(x, hits=F.size(F.array_intersect("l_surnames", "r_people")))
    unknown = (named == 0) | (F.size("r_people") == 0)
    x = x.where(unknown | (F.col("hits") >= 0.34 * named) | (F.col("l_code") == F.col("r_code")))
    x = title_edits(x)
    x = staged(x, title=title_evidence()).where("title > -12")
    hits = F.col("hits")
    share = hits / named
    people = (
        F.when(unknown, -0.3)
        .when(share >= 0.99, 3.0 + 0.5 * F.least(hits, F.lit(3)))
        .when(share >= 0.6, 1.0)
        .when(share >= 0.34, -3.0)
        .otherwise(-9.0)
    )
    apart = F.abs(F.col("l_year") - F.col("r_year"))
    year = F.coalesce(F.when(apart == 0, 1.0).when(apart == 1, 0.5).when(apart == 2, -1.0).otherwise(-2.5), F.lit(0.0))
    year = F.when(apart.isNull(), 0.0).otherwise(year)
    code = F.when(F.col("l_code") == F.col("r_code"), 6.0).when(F.col("l_code") != F.col("r_code"), -2.0).otherwise(0.0)
    prior = F.lit(-6.0) + F.col("title") + people + year + F.coalesce(code, F.lit(0.0))
    agrees = (unknown | (share >= 0.99)) & (apart.isNull() | (apart <= 2))
    own = F.coalesce(F.xxhash64("l_code"), F.xxhash64("lid"))
    return staged(x, prior=prior).where("prior > -4").select("lid", "rid", F.when(agrees, F.lit(0).cast("long")).otherwise(own).alias("entity"), "prior")


def _sigma(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def propagate(pairs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(lid, rid, confidence, settled) from (lid, rid, entity, prior): marginals of the pair variables,
    and whether the last round moved them by less than ``tolerance``.

    A pair hears from its listing -log(1 + sum of the odds of the listing's other pairs), and
    from its work the same over the strongest listings of the other entities. Messages are
    damped by half and stop when no marginal moves by ``tolerance``. A round is one job: the
    greatest move comes out of the table that the round writes.
    """
    at_l, at_r = Window.partitionBy("lid"), Window.partitionBy("rid")
    x = pairs.withColumn("rivals_l", F.count("*").over(at_l) - 1)
    x = x.withColumn("rivals_r", F.when(F.min("entity").over(at_r) != F.max("entity").over(at_r), 1).otherwise(0))
    x = cut_lineage(x.select("lid", "rid", "entity", "prior", ((F.col("rivals_l") > 0) | (F.col("rivals_r") > 0)).alias("rivals")))
    alone = x.where("NOT rivals").select("lid", "rid", _sigma(F.col("prior")).alias("confidence"), F.lit(True).alias("settled"))
    zero, gone = F.lit(0.0), F.lit(1.0)
    start = x.where("rivals").select("lid", "rid", "entity", "prior", zero.alias("from_l"), zero.alias("from_r"), gone.alias("moved"))
    state = start

    def odds(x: Column) -> Column:
        return F.exp(F.least(x, F.lit(30.0)))

    for turn in range(rounds):
        to_l = odds(F.col("prior") + F.col("from_r"))
        to_r = odds(F.col("prior") + F.col("from_l"))
        y = state.withColumn("to_l", to_l).withColumn("to_r", to_r)
        y = y.withColumn("others_l", F.greatest(F.sum("to_l").over(at_l) - F.col("to_l"), zero))
        # the strongest listing of each entity speaks for it; sums over entities from one window a work
        same = Window.partitionBy("rid", "entity")
        y = y.withColumn("best", F.max("to_r").over(same))
        y = y.withColumn("first", F.row_number().over(same.orderBy("lid")))
        y = y.withColumn("others_r", F.greatest(F.sum(F.when(F.col("first") == 1, F.col("best"))).over(at_r) - F.col("best"), zero))
        new_l = 0.5 * F.col("from_l") - 0.5 * F.log1p("others_l")
        new_r = 0.5 * F.col("from_r") - 0.5 * F.log1p("others_r")
        moved = F.abs(_sigma(F.col("prior") + new_l + new_r) - _sigma(F.col("prior") + F.col("from_l") + F.col("from_r")))
        y = y.select("lid", "rid", "entity", "prior", new_l.alias("from_l"), new_r.alias("from_r"), moved.alias("moved"))
        state = cut_lineage(y, replaces=None if state is start else state)
        most = state.agg(F.max("moved")).first()[0]
        if most is None or most < tolerance:
            break
    settled = F.col("moved") < tolerance
    return state.select("lid", "rid", _sigma(F.col("prior") + F.col("from_l") + F.col("from_r")).alias("confidence"), settled.alias("settled")).unionByName(alone)


def match(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(lid, rid, confidence, settled) of pairs at or above ``threshold``.

    Both sides have sid, title, authors (array), year, ids. Rows with a null sid take no part.
    Listings alike in all normalised fields are matched once and share the result; a right
    id that came several times takes part with each distinct version, and a pair keeps the
    best. Null titles match by nothing; null authors, years and ids count neither way.
    """
    l_all = normalised(left.where("sid IS NOT NULL"))
    fields = [c for c in l_all.columns if c != "sid"]
    lsig = F.xxhash64(*fields)
    l_all = cut_lineage(l_all.withColumn("sig", lsig))
    one = l_all.groupBy("sig").agg(F.min(F.struct("sid", *fields)).alias("x")).select(F.col("sig").alias("sid"), *[F.col(f"x.{c}").alias(c) for c in fields])
    r_all = normalised(right.where("sid IS NOT NULL")).dropDuplicates()
    r_all = cut_lineage(r_all.withColumn("key", F.xxhash64(*r_all.columns)))
    r_one = r_all.withColumnRenamed("sid", "rid_true").withColumnRenamed("key", "sid")
    scored = pair_evidence(candidate_pairs(one, r_one), one, r_one.drop("rid_true"))
    scored = scored.join(r_one.select(F.col("sid").alias("rid"), "rid_true"), "rid").groupBy("lid", F.col("rid_true").alias("rid")).agg(
        F.max_by("entity", F.struct("prior", F.col("entity") == 0, "entity")).alias("entity"), F.max("prior").alias("prior")
    )
    found = propagate(scored).where(F.col("confidence") >= threshold)
    back = l_all.select(F.col("sig").alias("lid"), F.col("sid").alias("listing")).distinct()
    return found.join(back, "lid").select(F.col("listing").alias("lid"), "rid", "confidence", "settled")


def listings_to_papers(listings: DataFrame, papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """hn_id, paper_id, confidence and settled of search listings and downloaded papers."""
    left = listings.select(F.col("hn_id").alias("sid"), F.col("paper_title").alias("title"), "authors", "year", F.concat_ws(" ", "arxiv_id", "pdf_url").alias("ids"))
    right = papers.select(F.col("id").alias("sid"), "title", "authors", "year", F.col("pdf_url").alias("ids"))
    found = match(left, right, threshold)
    return found.select(F.col("lid").cast("long").alias("hn_id"), F.col("rid").alias("paper_id"), "confidence", "settled")
