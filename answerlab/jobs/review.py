"""Reviewing a sample of questions: draw it, record decisions, write the filtered copy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from answerlab.operators import sampling, validate
from answerlab.operators.review import keep_unremoved, review_summary, with_decisions
from answerlab.session import materialise
from answerlab.sources.sinks import write_table


def draw(
    questions: DataFrame,
    sample_size: int = 20,
    skip: int = 10,
    seed: int = 0,
    category: str | None = None,
    key: str = "id",
) -> DataFrame:
    """A checked sample per category, or of one category, drawn once: all that follows reads what was written."""
    validate.require_columns(questions, {"question", "category", key}, "question table")
    validate.require_rows(questions, "question table")
    validate.require_values(questions, "category", key)
    validate.require_values(questions, "question", key)
    sampling.check_sample(questions, sample_size, skip, only=category)
    return materialise(sampling.stratified_sample(questions, sample_size, skip, seed, key=key, only=category))


def finish(
    questions: DataFrame,
    sample: DataFrame,
    decisions: DataFrame,
    output: str,
    sources: list[str],
    key: str = "id",
) -> DataFrame:
    """Write ``decisions`` and ``filtered`` under the output folder; returns the summary."""
    reviewed = with_decisions(sample, decisions, key)
    write_table(reviewed, f"{output}/decisions", sources)
    filtered = write_table(keep_unremoved(questions, decisions, key), f"{output}/filtered", sources)
    return review_summary(reviewed, questions.sparkSession.read.parquet(filtered))
