"""Seeded, repeatable sampling of questions per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import text
from answerlab.plans.ranks import first_of_groups, values_at_ranks
from answerlab.plans.skew import attach, measure_groups, salt

# Upper bound for a key that is a number or a date.
_CUT_BYTES = 32


def draw_order(seed: int, key: Column) -> Column:
    """A pseudo-random order that depends on seed and key only, not on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def category_counts(questions: DataFrame, category: str = "category") -> DataFrame:
    """Number of questions of every category that is not blank."""
    return (
        questions.where(~text.is_blank(F.col(category)))
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("questions"))
    )


def sample_shortfall(
    questions: DataFrame, sample_size: int, skip: int, category: str = "category"
) -> DataFrame:
    """What is left per category after skipping, and by how much that falls short."""
    left = F.greatest(F.col("questions") - skip, F.lit(0))
    return category_counts(questions, category).select(
        category, left.alias("eligible"), F.greatest(sample_size - left, F.lit(0)).alias("shortfall")
    )


def check_sample(
    questions: DataFrame, sample_size: int, skip: int, category: str = "category", only: str | None = None
) -> None:
    """Raise unless every category (or the one named) can give a full sample."""
    if sample_size < 1 or skip < 0:
        raise ValueError("sample size must be positive and skip must not be negative")
    rows = sample_shortfall(questions, sample_size, skip, category)
    if only is not None:
        rows = rows.where(F.col(category) == only)
        if rows.isEmpty():
            raise ValueError(f"unknown category: {only!r}")
    short = rows.where("shortfall > 0").orderBy(category).limit(10).collect()
    if short:
        listed = ", ".join(f"{row[category]!r} has {row['eligible']}" for row in short)
        raise ValueError(f"cannot sample {sample_size} after skipping {skip}: {listed}")


def stratified_sample(
    questions: DataFrame,
    sample_size: int,
    skip: int = 0,
    seed: int = 0,
    category: str = "category",
    key: str = "id",
    only: str | None = None,
) -> DataFrame:
    """Leave out the first ``skip`` rows of each category by key, then draw ``sample_size``.

    Neither ranking puts a whole category in order: the last key to leave out is found by ranges of keys, and the
    draw by counts of the leading digits, so categories, samples and skips may be of any size.
    """
    if only is not None:
        questions = questions.where(F.col(category) == only)
    rows = questions
    if skip > 0:
        # A category with fewer rows is left out whole: its cut is its last key.
        last = F.array(F.least(F.lit(skip), F.col("total")) - 1)
        cuts = values_at_ranks(questions, category, key, last).select(category, F.col(key).alias("_cut"))
        sizes = measure_groups(questions, category)
        width = None if dict(questions.dtypes)[key] in ("string", "binary") else _CUT_BYTES
        rows = salt(questions, sizes, F.col(key), width)
        rows = attach(rows, cuts, sizes, bytes_per_group=width)
        rows = rows.where(F.col(key) > F.col("_cut")).drop("_cut", "_salt")
    return first_of_groups(rows, category, draw_order(seed, F.col(key)), [F.col(key)], sample_size)
