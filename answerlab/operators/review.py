"""Review decisions about sampled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The states of a review decision.
KEEP, REMOVE, PENDING = "keep", "remove", "pending"


def with_decisions(sample: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """The whole sample, with ``pending`` where nothing was decided yet."""
    decided = decisions.select(key, F.col("decision").alias("_decision"))
    return (
        sample.join(decided, key, "left")
        .withColumn("decision", F.coalesce("_decision", F.lit(PENDING)))
        .drop("_decision")
    )


def keep_unremoved(questions: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Every question not marked for removal, with its own columns only."""
    removed = decisions.where(F.col("decision") == REMOVE).select(key)
    return questions.join(removed, key, "left_anti")


def review_summary(reviewed: DataFrame, filtered: DataFrame) -> DataFrame:
    """Sampled, removed and still pending of the sample, and what remains of all questions in the filtered copy."""
    total = filtered.agg(F.count(F.lit(1))).scalar()
    return reviewed.agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(F.col("decision") == REMOVE).alias("removed"),
        F.count_if(F.col("decision") == PENDING).alias("pending"),
    ).withColumn("remaining", total)
