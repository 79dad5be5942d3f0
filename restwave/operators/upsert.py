"""Keyed last-write-wins upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NEW = "_new_"
# Order of loaded writes to one key: kind of result, ingest ordinal, requested date, place in the body.
VERSION = ("_rank", "_batch", "_asked", "_entry", "_item")
CHANGED = "_changed"


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               keep: Sequence[str] = ()) -> DataFrame:
    """The row of each key with the greatest `order`; of the order columns only `keep` stay.

    An aggregate rather than a ranking window: it combines on the map side, so a key repeated
    very often in one batch does not gather in one task.
    """
    payload = [c for c in df.columns if c not in keys and (c not in order or c in keep)]
    kept = F.max_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_row")).select(*keys, "_row.*")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str],
           surrogate: str = "id", order: Sequence[str] = (), changed: bool = False) -> DataFrame:
    """`target` after inserting `batch`, or overwriting its columns where the key exists.

    Incoming nulls overwrite. Columns the batch does not have, and the surrogate id, keep their
    stored values. The batch holds each key once (see `last_write`). With `order` columns, a row
    that is stored with the same or a greater order stays as it is, so the outcome does not depend on which
    write comes first. `changed` adds a column that tells inserted and overwritten rows.
    """
    unknown = [c for c in batch.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"columns not in target: {unknown}")
    absent = [k for k in keys if k not in batch.columns]
    if absent:
        raise ValueError(f"batch lacks key columns: {absent}")
    types = dict(target.dtypes)
    incoming = batch.select(*[F.col(k).cast(types[k]).alias(k) for k in keys],
                            *[F.col(c).cast(types[c]).alias(_NEW + c)
                              for c in batch.columns if c not in keys and c != surrogate],
                            F.lit(True).alias(_NEW))
    merged = target.join(incoming, list(keys), "full_outer")
    wins = F.coalesce(F.col(_NEW), F.lit(False))
    if order:
        old = F.struct(*[F.col(c) for c in order])
        new = F.struct(*[F.col(_NEW + c) for c in order])
        stored = F.col(order[0]).isNotNull()  # a row written without a version gives way
        wins = wins & (~stored | (new > old))

    def value(c: str):
        if c in keys:
            return F.col(c)
        if c == surrogate:
            return F.coalesce(F.col(c), F.xxhash64(*keys)).alias(c)
        if _NEW + c in incoming.columns:
            return F.when(wins, F.col(_NEW + c)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    extra = [wins.alias(CHANGED)] if changed else []
    return merged.select(*[value(c) for c in target.columns], *extra)
