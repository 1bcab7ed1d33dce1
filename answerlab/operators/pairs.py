"""Directional answer comparisons.

Long answers are ``(question_id, position, response)``; a question row carries its label,
its clean answer (position 0) and its centre answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import text

# The three comparisons, in report order, as (name, reference, candidate).
COMPARISONS = (
    ("clean_vs_label", "label_gt", "clean_response"),
    ("center_vs_label", "label_gt", "center_response"),
    ("center_vs_clean", "clean_response", "center_response"),
)


def first_response(responses: Column) -> Column:
    """The clean answer of a list: its first element, null when blank or absent."""
    return text.blank_to_null(F.try_element_at(responses, F.lit(1)))


def blanks_to_null(responses: Column) -> Column:
    """A list with every blank answer replaced by null; positions stay."""
    return F.transform(responses, text.blank_to_null)


def with_clean_and_center(responses: DataFrame) -> DataFrame:
    """Add ``clean_response`` from the answer list and blank out an empty centre."""
    return responses.withColumns(
        {
            "clean_response": first_response(F.col("responses")),
            "center_response": text.blank_to_null(F.col("center_response")),
        }
    )


def comparison_pairs(
    questions: DataFrame, key: str = "question_id", blank_counts: bool = False
) -> DataFrame:
    """``(key, comparison, reference, candidate)`` for every comparison whose two sides exist.

    A blank side counts as missing unless ``blank_counts``; a null side always does.
    """
    missing = F.isnull if blank_counts else text.is_blank
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("comparison"),
                F.col(reference).alias("reference"),
                F.col(candidate).alias("candidate"),
            )
            for name, reference, candidate in COMPARISONS
        ]
    )
    existing = F.filter(pairs, lambda pair: ~missing(pair["reference"]) & ~missing(pair["candidate"]))
    return questions.select(key, F.inline(existing))


def scatter_scores(
    questions: DataFrame, scores: DataFrame, metrics: list[str], key: str = "question_id"
) -> DataFrame:
    """Put scores of comparisons back as ``<metric>_<comparison>`` columns; missing ones are null."""
    names = [name for name, _, _ in COMPARISONS]
    wide = scores.groupBy(key).agg(
        *[
            F.max(F.when(F.col("comparison") == name, F.col(metric))).alias(f"{metric}_{name}")
            for metric in metrics
            for name in names
        ]
    )
    return questions.join(wide, key, "left")


def unavailable(questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows that miss an answer, with the names of the empty columns."""
    empty = F.array_compact(
        F.array(
            F.when(text.is_blank(F.col("clean_response")), F.lit("LLM_response")),
            F.when(text.is_blank(F.col("center_response")), F.lit("center_response")),
        )
    )
    return questions.select(key, empty.alias("empty_columns")).where(F.size("empty_columns") > 0)


def unavailable_report(questions: DataFrame, key: str = "question_id") -> DataFrame:
    """The rows of :func:`unavailable`, each with their total number."""
    missing = unavailable(questions, key)
    return missing.withColumn("total_rows", missing.agg(F.count(F.lit(1))).scalar())


def explode_positions(responses: DataFrame, key: str = "question_id") -> DataFrame:
    """Answer lists as rows ``(key, position, response)``; blank answers are left out."""
    return responses.select(key, F.posexplode(F.col("responses")).alias("position", "response")).where(
        ~text.is_blank(F.col("response"))
    )
