"""Text functions over columns. All are JVM expressions; null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: aspect views in order
VIEWS = ("motivation", "method", "experiment/result")

#: fixed values: evidence reference kinds
EVIDENCE_KINDS = {
    "fig": "Figure", "figs": "Figure", "figure": "Figure", "figures": "Figure", "table": "Table", "tables": "Table",
    "eq": "Equation", "eqs": "Equation", "equation": "Equation", "equations": "Equation",
    "alg": "Algorithm", "algs": "Algorithm", "algorithm": "Algorithm", "algorithms": "Algorithm",
}
#: fixed value: how discussions name figures, tables, equations and algorithms
EVIDENCE_REF = (
    r"(?i)\b(fig(?:ure)?s?|tables?|eq(?:uation)?s?|alg(?:orithm)?s?)\.?\s*(?:\(?\s*)"
    "([A-Za-z]?\\d+(?:\\.\\d+)?(?:\\s*(?:-|–|—|to|and|,)\\s*[A-Za-z]?\\d+(?:\\.\\d+)?)*)\\s*\\)?"
)
#: fixed values: label and appendix mentions that don't belong in a query
LABEL_MENTION = r"(?i)\b(?:fig(?:ure)?|table|eq(?:uation)?|alg(?:orithm)?)\.?\s*\(?\s*[A-Za-z]?\d+(?:\.\d+)?\s*\)?"
APPENDIX_MENTION = r"(?i)\bappendix\b\s*[A-Za-z0-9. -]*"
#: fixed values: words that make an evidence mention a discussion
DISCUSSION_TERMS = (
    "ablation", "analysis", "analyze", "baseline", "comparison", "compare", "concern", "contradict", "evidence", "experiment", "fail",
    "improve", "limitation", "missing", "performance", "result", "show", "support", "trend", "unclear", "weak", "worse",
)


#: fixed values: Unicode white space and the separators of records, as a character class
WHITE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, f"^[{WHITE}]+|[{WHITE}]+$", "")


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"[{WHITE}]+", " "))


def remove_nul(x: Column) -> Column:
    return F.translate(x, "\0", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(stripped(x), F.lit(""))


def first_nonblank(columns: Sequence[Column]) -> Column:
    """The first of the columns that isn't null or blank, trimmed."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in columns])


def slug(x: Column, longest: int | None = None) -> Column:
    """Lower case, runs of other characters to "-", none at the ends; "item" if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if longest:
        s = F.regexp_replace(F.substring(s, 1, longest), "-+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit("item"))


def dataset_slug(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_")


def canonical_id(x: Column) -> Column:
    """Trimmed; one ".restored" and then one ".docling" suffix come off."""
    return F.regexp_replace(F.regexp_replace(stripped(x), r"\.restored$", ""), r"\.docling$", "")


def aspect_view(x: Column, reject: bool = True) -> Column:
    """Trimmed, lower case, "_" to "/", "experiment" to "experiment/result"; unknown views to null."""
    v = F.translate(F.lower(stripped(x)), "_", "/")
    v = F.when(v == "experiment", F.lit("experiment/result")).otherwise(v)
    return F.when(v.isin(*VIEWS), v) if reject else v


def view_label(x: Column) -> Column:
    """View label with plural and single-word synonyms folded."""
    v = collapse_spaces(F.lower(x))
    return F.when(v.isin("experiment", "experiments", "result", "results", "experiment/result", "experiments/results"), F.lit("experiment/result")).otherwise(v)


def truthy(x: Column) -> Column:
    """Flags written as text; anything unknown, and null, is false."""
    return F.coalesce(F.lower(stripped(x.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def word_list(x: Column) -> Column:
    """Whitespace words; an empty array for null."""
    return F.coalesce(F.filter(F.split(x, f"[{WHITE}]+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(x: Column) -> Column:
    return F.size(word_list(x))


def alnum_tokens(x: Column) -> Column:
    """Runs of [a-z0-9] of the lower-case text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct tokens longer than 2; 0 if either side has none."""
    x = F.array_distinct(F.filter(alnum_tokens(a), lambda t: F.length(t) > 2))
    y = F.array_distinct(F.filter(alnum_tokens(b), lambda t: F.length(t) > 2))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x, y)))


def evidence_refs(x: Column) -> Column:
    """Distinct "Kind label" references in order; lists are split, ranges are kept whole."""
    kinds = F.regexp_extract_all(x, F.lit(EVIDENCE_REF), 1)
    labels = F.regexp_extract_all(x, F.lit(EVIDENCE_REF), 2)
    alias = F.create_map(*[F.lit(v) for kv in EVIDENCE_KINDS.items() for v in kv])

    def expand(kind: Column, label: Column) -> Column:
        parts = F.filter(F.transform(F.split(label, r"(?i)\s*(?:,|and)\s*"), lambda p: F.regexp_replace(p, r"\s+", "")), lambda p: p != "")
        return F.transform(parts, lambda p: F.concat_ws(" ", alias[F.lower(kind)], p))

    refs = F.array_distinct(F.flatten(F.zip_with(kinds, labels, expand)))
    return F.coalesce(refs, F.array().cast("array<string>"))


def discusses_evidence(x: Column) -> Column:
    """One of the discussion terms occurs as a whole word."""
    return F.coalesce(F.lower(x).rlike(r"\b(" + "|".join(DISCUSSION_TERMS) + r")\b"), F.lit(False))


def pattern_density(x: Column, patterns: Sequence[str]) -> Column:
    """Non-overlapping occurrences of literal patterns per whitespace word; 0 without words."""
    low = F.coalesce(F.lower(x), F.lit(""))
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in patterns), F.lit(0.0))
    n = F.size(word_list(low))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def cleaned_query(x: Column) -> Column:
    """Query text without the modality mark, evidence labels and appendix references; spaces
    collapsed and none before punctuation."""
    t = stripped(F.replace(x, F.lit("(multimodal)"), F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, LABEL_MENTION, ""), APPENDIX_MENTION, "")
    t = F.regexp_replace(F.regexp_replace(t, f"[{WHITE}]+", " "), r" +([?.!,])", "$1")
    return stripped(t)


def strip_tags(x: Column) -> Column:
    """Tags to spaces, the five basic entities resolved, spaces collapsed."""
    t = F.regexp_replace(x, "<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return collapse_spaces(t)


def year_in(x: Column) -> Column:
    """The first year 1900-2099 in a text, or null."""
    return F.nullif(F.regexp_extract(x, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def arxiv_id_in(x: Column) -> Column:
    """Catalogue id without its version: new style, else old style, else null."""
    new = F.nullif(F.regexp_extract(x, r"(\d{4}\.\d{4,5})", 1), F.lit(""))
    old = F.nullif(F.regexp_extract(x, r"([a-z-]+/\d{7})", 1), F.lit(""))
    return F.coalesce(new, old)


def doi_in(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit(""))


def pdf_url(arxiv_id: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id, F.lit(".pdf"))


def delimited_list(x: Column) -> Column:
    """A JSON array of strings, or text divided by commas or bars: trimmed, non-blank, distinct."""
    parsed = F.from_json(x, "array<string>")
    items = F.coalesce(F.when(stripped(x).startswith("["), parsed), F.split(x, r"[,|]"))
    return F.array_distinct(F.filter(F.transform(items, lambda v: stripped(v)), lambda v: F.length(v) > 0))


def search_plan(keywords: Column, words: int = 4) -> Column:
    """Search strings from keywords: the first two, each cut to ``words`` words, joined; then
    each alone; distinct in order."""
    short = F.filter(F.transform(keywords, lambda k: F.array_join(F.slice(word_list(k), 1, words), " ")), lambda k: k != "")
    head = F.slice(short, 1, 2)
    return F.array_distinct(F.concat(F.when(F.size(head) > 1, F.array(F.array_join(head, " "))).otherwise(F.array().cast("array<string>")), short))


def unwrapped(json: Column) -> Column:
    """The "value" of a JSON object that has one, else the text itself."""
    return F.coalesce(F.get_json_object(json, "$.value"), json)


def json_in(reply: Column) -> Column:
    """JSON in a model's reply: fences off, the whole text, then the outermost braces, then the
    outermost brackets; null if none parses. Control characters are dropped first."""
    # fixed value: control characters that JSON texts must not hold
    x = F.regexp_replace(reply, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    x = stripped(F.regexp_replace(x, r"(?s)```[a-zA-Z]*\s*|```", ""))
    tries = [x, F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"(?s)(\[.*\])", 1), F.lit(""))]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in tries])


def title_key(x: Column) -> Column:
    return collapse_spaces(F.lower(x))


def render(template: str, values: dict[str, Column]) -> Column:
    """A template's {{name}} slots filled from columns; null fills as the empty string."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
