"""Exact quantiles per group, also where one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from answerlab.plans.ranks import values_at_ranks


def exact_quantiles(rows: DataFrame, key: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """``(key, quantiles ARRAY<DOUBLE>)`` with linear interpolation between ranks; null values do not count."""
    values = rows.select(key, F.col(value).cast("double").alias("_x")).where("_x is not null")
    places = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    ranks = F.array(*[end for place in places for end in (F.floor(place), F.ceil(place))])
    found = values_at_ranks(values, key, "_x", ranks)
    # Two values for each probability at most.
    at = found.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("_at"), F.first("total").alias("total")
    )
    quantiles = []
    for place in places:
        low, high = F.col("_at")[F.floor(place)], F.col("_at")[F.ceil(place)]
        quantiles.append(low + (high - low) * (place - F.floor(place)))
    return at.select(key, F.array(*quantiles).alias("quantiles"))
