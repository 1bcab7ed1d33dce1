"""The representative answer of a question: the one nearest a robust embedding centre.

Input rows are ``(question_id, position, v)`` plus an optional answer column. A question may
have any number of answers. Position 0 (the lowest position) is the clean answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import vectors as vec
from answerlab.operators import exact
from answerlab.plans.quantiles import exact_quantiles
from answerlab.plans.skew import GroupSizes, attach, measure_groups, salt
from answerlab.session import materialise

# Results for a question without any answer.
NO_ANSWER_SIMILARITY = 0.0
NO_ANSWER_SCORE = 1.0


def with_centre(
    answers: DataFrame, key: str = "question_id", sizes: GroupSizes | None = None
) -> DataFrame:
    """Add ``dist`` (to the mean of all), ``kept``, ``centre`` and ``cos`` (to the centre of the kept).

    Rows without a vector stay, with null measures, and do not count; vectors of another dimension than the
    rest of their question fail the job (``validate.vector_faults`` names both before). Means and limits are
    aggregates put back by key: broadcast when they are few, else by joins with salts for very large questions.
    The answers are read twice, for the means and to measure distances; what is measured is written once.

    An answer is kept when its distance is not above the exact mean plus the exact deviation of the distances.
    All sums are exact (``exact``), so results are the same on any partitioning to the last bit. Two answers are
    equally far from their mean up to rounding, and the farther one is then just the limit: both are kept.
    """
    sizes = sizes or measure_groups(answers, key)
    sums = exact.VectorSums.measure(answers)
    width = sums.bytes
    rows = salt(answers, sizes, F.struct("position"), width)
    with_vector = answers.where("v is not null")
    means = with_vector.groupBy(key).agg(sums.mean(F.col("v")).alias("mean"))
    rows = attach(rows, means, sizes, how="left", bytes_per_group=width)
    rows = materialise(rows.withColumn("dist", vec.distance(F.col("v"), F.col("mean"))))
    limits = exact.statistics(rows, [key], {"dists": F.col("dist")}).select(key, F.col("dists.limit").alias("limit"))
    rows = attach(rows, limits, sizes, how="left", bytes_per_group=8)
    # Without a limit no distance of the question is a number.
    kept = F.when(F.col("dist").isNotNull(), F.coalesce(F.col("dist") <= F.col("limit"), F.lit(True)))
    rows = rows.withColumn("kept", kept).drop("limit")
    centres = rows.where("kept").groupBy(key).agg(sums.mean(F.col("v")).alias("centre"))
    rows = attach(rows, centres, sizes, how="left", bytes_per_group=width)
    rows = rows.withColumn("centre", F.coalesce("centre", "mean")).drop("mean")
    return rows.withColumn("cos", vec.cosine(F.col("v"), F.col("centre"))).drop("_salt")


def centre_metrics(measured: DataFrame, answer: str = "position", key: str = "question_id") -> DataFrame:
    """One row per question from :func:`with_centre`: centre answer and consistency.

    The centre answer has the highest cosine over all answers, outliers included; the
    lowest position wins a tie. Dispersion is the mean distance of the kept answers to
    the mean of all answers. Only answers with a vector count.
    """
    best = F.max_by(
        F.struct(F.col("position").alias("position"), F.col(answer).alias("answer")),
        F.when(F.col("cos").isNotNull(), F.struct("cos", -F.col("position"))),
    )
    chosen = measured.groupBy(key).agg(
        best.alias("best"),
        F.min_by("cos", "position").alias("clean_to_center_similarity"),
        F.count("cos").alias("answers"),
    )
    kept = F.when(F.col("kept"), F.col("dist"))
    means = exact.statistics(measured, [key], {"_cos": F.col("cos"), "_kept": kept, "_all": F.col("dist")})
    return chosen.join(means, key).select(
        key,
        F.col("best.position").alias("center_position"),
        F.col("best.answer").alias("center_response"),
        F.col("_cos.mean").alias("center_similarity_mean"),
        "clean_to_center_similarity",
        F.coalesce("_kept.mean", "_all.mean").alias("cluster_dispersion"),
        "answers",
    )


def with_defaults(
    questions: DataFrame, metrics: DataFrame, score_columns: list[str], key: str = "question_id"
) -> DataFrame:
    """All questions; those without an answer get similarity 0.0 and hallucination score 1.0.

    Scores of answered questions pass through, null included (a missing label).
    """
    return fill_defaults(questions.join(metrics, key, "left"), score_columns)


def fill_defaults(joined: DataFrame, score_columns: list[str]) -> DataFrame:
    """The same where the metrics are already in the row, null for questions without an answer."""
    none = F.coalesce(F.col("answers"), F.lit(0)) == 0
    similarities = ["center_similarity_mean", "clean_to_center_similarity", "cluster_dispersion"]
    return joined.withColumns(
        {
            **{c: F.when(none, F.lit(NO_ANSWER_SIMILARITY)).otherwise(F.col(c)) for c in similarities},
            **{c: F.when(none, F.lit(NO_ANSWER_SCORE)).otherwise(F.col(c)) for c in score_columns},
            "answers": F.coalesce(F.col("answers"), F.lit(0)),
        }
    )


def median_similarity(similarities: DataFrame, key: str = "question_id", value: str = "cos") -> DataFrame:
    """Exact median per question."""
    medians = exact_quantiles(similarities, key, value, [0.5])
    return medians.select(key, F.col("quantiles")[0].alias("median_cosine"))


def ground_truth(label: Column, legacy: Column) -> Column:
    """The label, or the older reference answer where there is none."""
    return F.coalesce(label, legacy)
