"""Keyed tables on plain files: upsert, insert-ignore, delete, partial update.

Each returns the new table; write it to a new place and swap. Of several rows of a batch for
one key the last in ``order`` counts, or the first where known rows win; rows alike in it are
told apart by their values. A null key is a key of inserts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_a_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = (), last: bool = True) -> DataFrame:
    """The last (or first) row of each key; aggregated map-side."""
    rest = [*order, *[c for c in batch.columns if c not in keys and c not in order]]
    if not rest:
        return batch.select(*keys).distinct()
    row = (F.max if last else F.min)(F.struct(*rest)).alias("_row")
    return batch.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in batch.columns])


def _unknown(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't in ``known``, nulls alike."""
    k = known.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(k, cond, "left_anti")


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], protected: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Insert new keys; for known keys replace all columns but the protected ones, null included."""
    b = base.withColumn("_b", F.lit(True)).alias("b")
    n = one_a_key(batch, keys, order).select(*base.columns).withColumn("_n", F.lit(True)).alias("n")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    x = b.join(n, cond, "full")
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.when(F.col("b._b"), F.col(f"b.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in protected:
            out.append(F.when(F.col("b._b"), F.col(f"b.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return x.select(*out)


def insert_ignore(base: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Append rows of the batch whose key isn't known; known rows stay as they are."""
    return base.unionByName(_unknown(one_a_key(batch, keys, order, last=False), base, keys).select(*base.columns))


def delete_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't listed; a null key is never deleted."""
    return base.join(gone.select(*keys), list(keys), "left_anti")


def write_back(base: DataFrame, results: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Partial update: a null in the results keeps the old value."""
    results = one_a_key(results.select(*dict.fromkeys([*keys, *order, *columns])), keys, order)
    r = results.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    x = base.join(r, list(keys), "left")
    return x.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
