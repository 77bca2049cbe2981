"""Identity keys: hashes of joined fields and other stable ids. Null fields count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import stripped


def joined_sha1(*fields: Column) -> Column:
    return F.sha1(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]).cast("binary"))


def query_key(paper_id: Column, query_text: Column, source_view: Column, query_type: Column) -> Column:
    return joined_sha1(paper_id, query_text, source_view, query_type)


def candidate_key(query: Column, title: Column, arxiv_id: Column, url: Column) -> Column:
    return joined_sha1(query, title, arxiv_id, url)


def stable_field_id(x: Column) -> Column:
    """Sum of (position x code point) modulo 1,000,000,007; 0 for the empty text."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c, i: (i + 1).cast("long") * F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, v: (a + v) % 1_000_000_007)


def listing_paper_id(arxiv_id: Column, title: Column) -> Column:
    """Catalogue id with "/" as "_", else the first 12 digits of the title's sha1."""
    given = F.translate(stripped(arxiv_id), "/", "_")
    return F.coalesce(F.nullif(given, F.lit("")), F.substring(F.sha1(F.coalesce(title, F.lit("")).cast("binary")), 1, 12))


def line_id(position: Column) -> Column:
    """Fallback id of the n-th row (1-based): line-000001."""
    return F.concat(F.lit("line-"), F.lpad(position.cast("string"), 6, "0"))
