"""Strength workout figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restwave.functions import corrected_weight, nan_to_null, one_rep_max


def set_figures(df: DataFrame) -> DataFrame:
    """Per set: corrected weight, one-rep maximum and volume."""
    weight = nan_to_null(F.col("Weight").cast("double"))
    return (df.withColumn("CorrectedWeight", corrected_weight("Exercise", weight))
            .withColumns({"OneRepMax": one_rep_max("CorrectedWeight", "Reps"),
                          "WeightReps": F.col("CorrectedWeight") * F.col("Reps")}))


def workout_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per exercise (and `by`): maxima, totals and averages.

    All five aggregates combine on the map side, so one very common exercise is no bottleneck.
    Sets without an exercise are left out; sums over no values are 0.
    """
    exact = F.coalesce(F.sum("Reps").cast("bigint"), F.lit(0).cast("bigint"))
    return (set_figures(df).where(F.col("Exercise").isNotNull())
            .groupBy(*by, "Exercise")
            .agg(F.max("CorrectedWeight").alias("MaxWeight"),
                 exact.alias("TotalReps"),
                 F.avg("Reps").alias("AvgReps"),
                 F.coalesce(F.sum("WeightReps"), F.lit(0.0)).alias("TotalWeightReps"),
                 F.max("OneRepMax").alias("Max1RM"))
            .withColumn("AvgWeightPerRep", F.try_divide("TotalWeightReps", "TotalReps"))
            .withColumn("Avg1RM", one_rep_max("AvgWeightPerRep", "AvgReps")))
