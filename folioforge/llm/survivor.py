"""Best representative of each duplicate group, by skyline selection.

Every record of a group is a point on three axes: *trust* (a class, 0 is best),
*completeness* (a class, higher is better) and *recency* (a calendar class of the
time stamp, higher is better). All axes are discrete, so a group, however large, has
a bounded number of occupied cells; one map-side aggregation reduces the records to
cells, and the skyline, its successive layers and the field-wise fill are computed on
cells. No group is ever gathered record by record, so hot groups need no salting.

Within a cell, and between undominated cells, the lexicographic policy decides: trust,
completeness, exact time stamp (null last), larger id. The policy's first record is
always undominated, so the survivor of the skyline is the policy's first record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUST_LEVELS = 5


def status_level(status: Column, order: Sequence[str]) -> Column:
    """Position of a status in ``order``; case, white space around and separators do not
    matter. Anything else, and null, gets ``len(order)``."""
    key = F.regexp_replace(F.lower(status), r"(?U)[\s\p{Z}_\-./]+", "")
    level = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        level = F.when(key == name.replace("_", ""), F.lit(i)).otherwise(level)
    return level


def json_object_has_content(payload: Column) -> Column:
    """True for a valid JSON object that holds, at any depth, a value other than null and
    the empty string, array and object; false for everything else, null included."""
    wrapped = F.concat(F.lit("["), payload, F.lit("]"))
    valid = (
        payload.rlike(r"^\s*\{")
        & F.try_parse_json(wrapped).isNotNull()
        & F.try_variant_get(F.try_parse_json(wrapped), "$[1]", "string").isNull()
    )
    # strings become atoms one step at a time: escapes, empty strings, the rest, then keys go
    flat = F.regexp_replace(payload, r"\\.", "e")
    flat = F.regexp_replace(flat, '""', "null")
    flat = F.regexp_replace(flat, '"[^"]*"', "s")
    flat = F.regexp_replace(flat, r"(s|null)\s*:", "")
    flat = F.regexp_replace(flat, "null", "")
    return F.coalesce(valid & flat.rlike(r"[^\s{}\[\],]"), F.lit(False))


def recency_class(ts: Column, unit: str = "month") -> Column:
    """Calendar class of a time stamp, growing with time; null for null."""
    if unit == "day":
        return F.unix_date(F.to_date(ts))
    months = F.year(ts) * 12 + F.month(ts)
    return {"month": months, "quarter": F.floor(months / 3).cast("int"), "year": F.year(ts)}[unit]


def dominance_cells(
    df: DataFrame, keys: Sequence[str], trust: Column, completeness: Column, ts: Column, id_col: str, fields: Sequence[str] = (), unit: str = "month"
) -> DataFrame:
    """One row per occupied cell of every group: its policy-first record (``best``: time
    stamp and id), the smallest and largest id, and for each of ``fields`` the
    policy-first non-null value. Rows whose id or any key is null are left out."""
    x = df.select(
        *keys,
        trust.cast("int").alias("_trust"),
        completeness.cast("int").alias("_complete"),
        recency_class(ts, unit).alias("_recency"),
        ts.alias("_ts"),
        F.col(id_col).alias("_id"),
        *[F.col(f).alias(f"_f_{f}") for f in fields],
    )
    x = x.where(F.col("_id").isNotNull())
    for k in keys:
        x = x.where(F.col(k).isNotNull())
    order = F.struct("_ts", "_id")
    return x.groupBy(*keys, "_trust", "_complete", "_recency").agg(
        F.max(order).alias("best"),
        F.min("_id").alias("min_id"),
        F.max("_id").alias("max_id"),
        F.count("*").alias("n"),
        *[F.max(F.when(F.col(f"_f_{f}").isNotNull(), F.struct("_ts", "_id", f"_f_{f}"))).alias(f"_f_{f}") for f in fields],
    )


def _dominates(a: Column, b: Column) -> Column:
    """Cell ``a`` is at least as good as ``b`` on every axis and better on one."""
    ar, br = F.coalesce(a["recency"], F.lit(-1)), F.coalesce(b["recency"], F.lit(-1))
    no_worse = (a["trust"] <= b["trust"]) & (a["complete"] >= b["complete"]) & (ar >= br)
    better = (a["trust"] < b["trust"]) | (a["complete"] > b["complete"]) | (ar > br)
    return no_worse & better


def _earliest_value(both: Column, field: str) -> Column:
    """The non-null value of the earliest layer, ties by policy, with its layer."""

    def row(z: Column) -> Column:
        found = z["ordered"]["cell"][field]
        return F.struct(
            z["placed"]["layer"].alias("layer"),
            z["placed"]["trust"].alias("t"),
            (-z["placed"]["complete"]).alias("c"),
            (-F.coalesce(F.unix_micros(found["_ts"]), F.lit(-(2**62)))).alias("ts"),
            (-found["_id"]).alias("id"),
            found[field].alias("value"),
        )

    return F.array_min(F.transform(F.filter(both, lambda z: z["ordered"]["cell"][field].isNotNull()), row))


def skyline_survivors(
    df: DataFrame,
    keys: Sequence[str],
    trust: Column,
    completeness: Column,
    ts: Column,
    id_col: str,
    fields: Sequence[str] = (),
    unit: str = "month",
    min_ids: int = 1,
) -> DataFrame:
    """One row per group: ``survivor_id``, ``n_records``, ``skyline_cells``, ``layers`` and,
    for each of ``fields``, the value from the earliest dominance layer that has one.

    Groups with fewer than ``min_ids`` (1 or 2) different ids are left out. Null time
    stamps count as oldest. A field null in all records stays null. Repeated rows change
    only ``n_records``. Empty input gives no rows; further columns are ignored.
    """
    fields = list(fields)
    cells = dominance_cells(df, keys, trust, completeness, ts, id_col, fields, unit)
    cell = F.struct(
        F.col("_trust").alias("trust"),
        F.col("_complete").alias("complete"),
        F.col("_recency").alias("recency"),
        "best",
        *[F.col(f"_f_{f}") for f in fields],
    )
    groups = cells.groupBy(*keys).agg(
        F.collect_list(cell).alias("cells"),
        F.min("min_id").alias("min_id"),
        F.max("max_id").alias("max_id"),
        F.sum("n").alias("n_records"),
    )
    if min_ids > 1:
        groups = groups.where("min_id <> max_id")

    def first_by_policy(cs: Column) -> Column:
        ranked = F.transform(
            cs, lambda c: F.struct((-c["trust"]).alias("t"), c["complete"].alias("c"), c["best"].alias("b"), c.alias("cell"))
        )
        return F.array_max(F.transform(ranked, lambda r: F.struct(r["t"], r["c"], r["b"])))

    skyline = F.filter("cells", lambda c: ~F.exists("cells", lambda o: _dominates(o, c)))
    out = groups.withColumn("skyline", skyline)
    out = out.withColumn("survivor_id", first_by_policy(F.col("skyline"))["b"]["_id"])
    # Layer of a cell: one more than the longest chain of cells above it. Walking the cells in
    # policy order (best first) meets every dominator before what it dominates.
    if fields:
        ordered = F.reverse(
            F.array_sort(
                F.transform(
                    "cells",
                    lambda c: F.struct(
                        (-c["trust"]).alias("t"), c["complete"].alias("c"), F.coalesce(c["recency"], F.lit(-1)).alias("r"), c["best"].alias("b"), c.alias("cell")
                    ),
                )
            )
        )
        spot = "array<struct<layer:int,trust:int,complete:int,recency:int,b:struct<_ts:timestamp,_id:bigint>>>"

        def place(done: Column, r: Column) -> Column:
            c = r["cell"]
            above = F.transform(F.filter(done, lambda d: _dominates(d, c)), lambda d: d["layer"])
            layer = F.coalesce(F.array_max(above), F.lit(0)) + 1
            b = F.struct(c["best"]["_ts"].alias("_ts"), c["best"]["_id"].cast("bigint").alias("_id"))
            row = F.struct(layer.alias("layer"), c["trust"].alias("trust"), c["complete"].alias("complete"), c["recency"].alias("recency"), b.alias("b"))
            return F.concat(done, F.array(row).cast(spot))

        out = out.withColumn("ordered", ordered).withColumn("placed", F.aggregate("ordered", F.array().cast(spot), place))
        out = out.withColumn("layers", F.array_max(F.transform("placed", lambda p: p["layer"])))
        both = F.arrays_zip(F.col("placed"), F.col("ordered"))
        out = out.withColumn("both", both)
        for f in fields:
            pick = _earliest_value(F.col("both"), f"_f_{f}")
            out = out.withColumn(f"_pick_{f}", pick["value"]).withColumn(f"_layer_{f}", pick["layer"])
        return out.select(
            *keys, "survivor_id", "n_records", F.size("skyline").alias("skyline_cells"), "layers",
            *[F.col(f"_pick_{f}").alias(f) for f in fields],
            *[F.col(f"_layer_{f}").alias(f"{f}_layer") for f in fields],
        )
    return out.select(*keys, "survivor_id", "n_records", F.size("skyline").alias("skyline_cells"))


# --- the candidate queue -------------------------------------------------------------------

#: fixed values: status orders, best first
REVIEW_ORDER = ("completed", "processing", "pending", "failed")
PARSE_ORDER = ("parsed", "metadata_only", "no_pdf", "pending")


def queue_places(queue: DataFrame) -> DataFrame:
    """The queue with a clean ``query_key``: lower case without white space around it; where
    it is missing or blank, sha1 of paper_id, query_text, source_view and query_type joined
    by line feeds (null counts as empty)."""
    given = F.lower(F.regexp_replace("query_key", r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    made = F.sha1(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("paper_id", "query_text", "source_view", "query_type")]).cast("binary"))
    return queue.withColumn("query_key", F.coalesce(F.nullif(given, F.lit("")), made))


def queue_survivors(queue: DataFrame, fields: Sequence[str] = (), min_ids: int = 1) -> DataFrame:
    """Skyline survivors of each (query_key, retrieval_rank) place of a candidate queue."""
    trust = status_level(F.col("review_status"), REVIEW_ORDER) * TRUST_LEVELS + status_level(F.col("parse_status"), PARSE_ORDER)
    return skyline_survivors(
        queue_places(queue),
        ["query_key", "retrieval_rank"],
        trust=trust,
        completeness=json_object_has_content(F.col("review_payload")),
        ts=F.col("updated_at"),
        id_col="id",
        fields=fields,
        min_ids=min_ids,
    )
