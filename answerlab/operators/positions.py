"""Mean metrics per answer position: clean, each perturbed variant, and the centre answer.

The centre answer has position null. Blank answers stay as rows without a score: they do
not count in a mean, but their position appears in the summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import text
from answerlab.operators import exact
from answerlab.session import materialise

CLEAN, CENTER = "C", "Center"


def position_name(position: Column) -> Column:
    """``C`` for 0, ``P<n>`` for others, ``Center`` for null."""
    name = F.when(position == 0, F.lit(CLEAN)).otherwise(F.concat(F.lit("P"), position.cast("string")))
    return F.coalesce(name, F.lit(CENTER))


def listed_answers(responses: Column, center: Column) -> Column:
    """``ARRAY<STRUCT<position, candidate>>`` of a list and its centre; an empty list has a blank position 0."""
    some = F.when(F.size(responses) > 0, responses).otherwise(F.array(F.lit(None).cast("string")))
    listed = F.transform(some, lambda x, i: _answer(i, x))
    return F.concat(listed, F.array(_answer(F.lit(None).cast("int"), center)))


def _answer(position: Column, response: Column) -> Column:
    return F.struct(position.alias("position"), text.blank_to_null(response).alias("candidate"))


def with_center_position(answers: DataFrame, center: DataFrame, key: str = "question_id") -> DataFrame:
    """Long answers of all positions plus the centre answers, blanks as null."""
    listed = answers.select(key, F.col("position").cast("int").alias("position"), F.col("response").alias("candidate"))
    centres = center.select(
        key, F.lit(None).cast("int").alias("position"), F.col("center_response").alias("candidate")
    )
    return listed.unionByName(centres).withColumn("candidate", text.blank_to_null(F.col("candidate")))


def position_means(scored: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One row per position from the first to the last in order, and the centre; ``metrics`` maps column to mean name.

    Positions without a row have null means. Sums are exact: the same on any partitioning.
    """
    values = {f"_{i}": F.col(column) for i, column in enumerate(metrics)}
    means = exact.statistics(scored, ["position"], values).select(
        "position", *[F.col(place)["mean"].alias(name) for place, name in zip(values, metrics.values(), strict=True)]
    )
    # One row per position; written, so that the scores are not made twice.
    means = materialise(means).withColumnRenamed("position", "_position")
    last = means.agg(F.coalesce(F.max("_position"), F.lit(0)).alias("last"))
    places = F.concat(F.sequence(F.lit(0), F.col("last")), F.array(F.lit(None).cast("int")))
    grid = last.select(F.explode(places).alias("position"))
    return grid.join(means, grid["position"].eqNullSafe(means["_position"]), "left").select(
        "position", position_name(F.col("position")).alias("response_position"), *metrics.values()
    ).orderBy(F.col("position").asc_nulls_last())
