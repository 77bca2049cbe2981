"""The SQL that checks residue detection: the same rules without the hints that spare work."""

from __future__ import annotations

import re

from folioforge.llm import residue as R


def text(s: str) -> str:
    """SQL literal; control characters by number."""
    s = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m.group(1), 16)), s)
    out, run = [], ""
    for c in s:
        if ord(c) < 32:
            if run:
                out.append(f"'{run}'")
            out.append(f"chr({ord(c)})")
            run = ""
        else:
            run += c.replace("'", "''")
    if run or not out:
        out.append(f"'{run}'")
    return "(" + " || ".join(out) + ")"


def swap(x: str, pattern: str, put: str) -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(put)}, 'g')"


def has(pattern: str, x: str = "mask") -> str:
    return f"regexp_matches({x}, {text(pattern)})"


def clean(x: str) -> str:
    x = swap(x, R._TAGS, "\n")
    for entity, plain in R.ENTITIES:
        x = f"replace({x}, {text(entity)}, {text(plain)})"
    return f"translate({x}, {text(R.ODD)}, {text(R.PLAIN)})"


def mark_slots(x: str) -> str:
    x = swap(x, R._any(R.STRONG_SLOT), R.SLOT)
    for hedged, sign in ((R.HEDGED_SLOT, R.SLOT), (R.BARE_SLOT, R.BARE)):
        for before, slot, after in hedged:
            x = swap(x, before + slot + after, rf"\1{sign}\2")
    return x


def folded(x: str) -> str:
    return f"trim(translate({swap(swap(x, r'[^\x00-\x7f]+', '_'), ' {2,}', ' ')}, '123456789', '000000000'))"


def masked(x: str) -> str:
    x = f"lower({swap(f'replace({x}, {text("JavaScript")}, {text("javascript")})', R.ID_RE, '0')})"
    for pattern, put in R.MASKS:
        x = swap(x, pattern, put)
    return f"trim({x})"


def classes() -> str:
    """kind:grade of a masked message, null where no rule holds."""
    words = "len(string_split(mask, ' '))"
    latin = f"len(regexp_extract_all(mask, {text(R.LATIN_RE)}))"
    bare = swap("mask", R.QUOTED, " ")
    about, quotes = has(R.ABOUT_RE), "contains(mask, '\"')"
    short = f"{words} <= {R.NOTICE_WORDS}"
    first = "array_to_string(string_split(mask, ' ')[1:{k}], ' ')"
    again = " OR ".join(f"(regexp_matches({first.format(k=k)}, '^[a-z]+( [a-z]+)*$') AND starts_with(mask, repeat({first.format(k=k)} || ' ', 3)))" for k in (1, 2, 3))
    script = f"{short} AND {has(R.SCRIPT_RE)} AND {has(R.STATE_RE)} AND NOT {quotes}"
    return f"""CASE
      WHEN ({has(R.LATIN_START)} AND {latin} >= 4 AND {latin} >= 0.6 * {words}) OR ({words} >= 9 AND ({again})) THEN 'filler:3'
      WHEN (contains({bare}, {text(R.SLOT)}) OR contains({bare}, {text(R.BARE)})) AND NOT {has(R.SUBJECT)} THEN 'slot:3'
      WHEN {has(R.FIELD_RE, bare)} AND NOT {about} THEN 'field:3'
      WHEN {has(R.THIN_RE)} THEN 'field:2'
      WHEN {about} THEN NULL
      WHEN {script} AND {has(R.ADDRESS_RE)} THEN 'script:2'
      WHEN {has(R.ERROR_RE)} THEN 'error:2'
      WHEN {has(R.FILLER_RE)} AND {short} THEN 'filler:2'
      WHEN {script} THEN 'script:1'
      WHEN {short} AND {has(R.FRAME_RE)} THEN 'frame:0'
      WHEN {words} <= {R.TOPIC_WORDS} AND NOT {quotes} AND {has(R.THING_RE)} AND {has(R.FAILURE_RE)} THEN 'error:1'
    END"""


def _steps() -> str:
    source = "coalesce(regexp_replace(lower(trim(source)), '[-_ ]+', '_', 'g'), '')"
    return f"""
WITH texts AS (SELECT doc_id, {source} AS source, {clean('text')} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pieces AS (SELECT doc_id, source, length(trim(t)) AS size, unnest(string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10))) AS m FROM texts),
plain AS (SELECT doc_id, source, size, {folded(mark_slots('m'))} AS m FROM pieces WHERE trim(m) <> ''),
messages AS (SELECT doc_id, source, size, length(m) AS chars, {masked('m')} AS mask FROM plain),
own AS (SELECT doc_id, mask, min(source) AS source, count(*) AS times, sum(chars) AS chars, max(size) AS size FROM messages WHERE mask <> '' GROUP BY doc_id, mask),
found AS (SELECT mask, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM own GROUP BY mask),
classed AS (SELECT mask, n_docs, n_sources, n_docs >= {R.MIN_DOCS} AND n_sources >= {R.MIN_SOURCES} AS recurs, string_split({classes()}, ':') AS c FROM found),
graded AS (SELECT mask, n_docs, n_sources, recurs, c[1] AS kind, c[2]::INT AS grade FROM classed WHERE c IS NOT NULL)"""


def messages_sql() -> str:
    return _steps() + " SELECT mask, kind, grade, n_docs, n_sources FROM graded WHERE grade > 0 AND (recurs OR grade = 3)"


def found_sql() -> str:
    return _steps() + """
SELECT doc_id FROM own JOIN graded USING (mask) GROUP BY doc_id
HAVING max(grade) = 3 OR bool_or(recurs AND grade > 0)
  OR (bool_or(grade = 2) AND (count(*) >= 2 OR max(times) FILTER (WHERE grade = 2) >= 2 OR coalesce(sum(chars) FILTER (WHERE kind <> 'field'), 0) >= max(size) / 2))"""
