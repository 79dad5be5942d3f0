"""Activity lists, strength sets and the split by activity type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.operators.upsert import last_write
from restwave.schemas import ACTIVITY_TYPES, table

# Fixed value.
LIST_LIMIT = 50


def most_recent(df: DataFrame, order: Sequence[Column], limit: int = LIST_LIMIT) -> DataFrame:
    """Global top-n: each task keeps n rows before the final merge."""
    return df.orderBy(*order).limit(limit)


def most_recent_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    limit: int = LIST_LIMIT) -> DataFrame:
    """Top-n of every key; Spark prunes each key to n rows per task before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def _body_schema(name: str, skip: Sequence[str]) -> T.StructType:
    return T.StructType([f for f in table(name).schema if f.name not in skip])


def _batch(landed: DataFrame) -> list[Column]:
    return [F.col("batch") if "batch" in landed.columns else F.lit(0).cast("bigint").alias("batch")]


def activity_list(landed: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Each user's newest `limit` distinct activities from landed list responses; a null list is empty.

    An activity that several responses list counts once, as the newest batch has it; one without
    an id is no activity.
    """
    schema = T.ArrayType(_body_schema("activities", ("id", "user_id")))
    rows = landed.select("user_id", *_batch(landed), F.posexplode(F.from_json("body", schema)).alias("item", "a"))
    flat = rows.select("user_id", "batch", "item", "a.*").where(F.col("activityId").isNotNull())
    newest = last_write(flat, ("user_id", "activityId"), ("batch", "item")).withColumn(
        "detailsPulled", F.coalesce("detailsPulled", F.lit(False)))
    return most_recent_per(newest, ["user_id"],
                           [F.col("startTime").desc(), F.col("activityId").desc()], limit)


def strength_sets(landed: DataFrame) -> DataFrame:
    """Exercise sets of each workout's newest response; a missing or empty list gives no rows.

    Workouts are told apart by the columns user_id and activityId, as far as `landed` has them.
    """
    item = _body_schema("strength", ("id", "user_id", "activityId"))
    schema = T.StructType([T.StructField("exerciseSets", T.ArrayType(item))])
    keys = [c for c in ("user_id", "activityId") if c in landed.columns]
    if "batch" in landed.columns and keys:
        landed = last_write(landed.select(*keys, "batch", "body"), keys, ("batch", "body"), keep=("body",))
    sets = F.from_json("body", schema)["exerciseSets"]
    return landed.select(*keys, F.explode(sets).alias("s")).select(*keys, "s.*")


def of_type(activities: DataFrame, kind: str, column: str = "activityType",
            kinds: Sequence[str] = ACTIVITY_TYPES) -> DataFrame:
    """The activities of one type."""
    if kind not in kinds:
        raise ValueError(f"unknown activity type {kind!r}")
    return activities.where(F.col(column) == F.lit(kind))
