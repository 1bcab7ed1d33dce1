"""Scoring an answer table: per row with three comparisons, and per answer position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import text
from answerlab.operators import inference, positions, stats, validate
from answerlab.operators.bleu import with_bleu
from answerlab.operators.hallucination import NAME as HALLUCINATION, HallucinationModels, hallucination_scores
from answerlab.operators.pairs import COMPARISONS, comparison_pairs, scatter_scores, with_clean_and_center
from answerlab.plans.skew import attach, measure_groups, salt
from answerlab.session import arrow_batches, materialise, passing_shuffles

CLEAN_ACCURACY, CENTER_ACCURACY, MEAN_ACCURACY = (
    "accuracy_clean_vs_label",
    "accuracy_center_vs_label",
    "mean_accuracy",
)


@dataclass(frozen=True)
class Scorers:
    """Pair metrics besides BLEU.

    ``models`` maps a metric name to a factory over (references, candidates);
    ``columns`` maps one to a function of the reference and candidate columns. ``hallucination`` holds
    the two models of that score.
    """

    models: dict[str, Callable]
    columns: dict[str, Callable[[Column, Column], Column]]
    hallucination: HallucinationModels | None = None

    def of_models(self) -> list[str]:
        return [HALLUCINATION] * (self.hallucination is not None) + list(self.models)

    def names(self) -> list[str]:
        return ["bleu", *self.columns, *self.of_models()]


NO_SCORERS = Scorers({}, {})
#: Bytes of a batch of pairs and their tokens that goes to Python.
BATCH_BYTES = 4 << 20
_TOKENS = "_reference_tokens"


def with_row_scores(
    frame: DataFrame,
    scorers: Scorers,
    reference: str,
    candidate: str,
    suffix: str = "",
    tokens: dict[str, str] | None = None,
) -> DataFrame:
    """Add every metric that needs only the two texts of the row; null where one is missing."""
    frame = with_bleu(frame, f"bleu{suffix}", reference, candidate, tokens)
    both = F.col(reference).isNotNull() & F.col(candidate).isNotNull()
    return frame.withColumns(
        {f"{m}{suffix}": F.when(both, score(F.col(reference), F.col(candidate))) for m, score in scorers.columns.items()}
    )


def with_model_scores(pairs: DataFrame, scorers: Scorers, keys: list[str]) -> DataFrame:
    """Add the model metrics one after the other, so that one model is loaded at a time.

    Every pair must come back exactly once. The two texts do not: what else is made of them is made before.
    """
    if not scorers.of_models():
        return pairs
    spark = pairs.sparkSession
    with passing_shuffles(spark):
        with arrow_batches(spark, BATCH_BYTES):
            pairs = scored = materialise(pairs, "zstd")
        if scorers.hallucination:
            scored = hallucination_scores(scored, scorers.hallucination)
        for name, make in scorers.models.items():
            scored = inference.score_pairs(scored, make, name).drop(f"{name}_error")
        scored = materialise(scored.drop("reference", "candidate"))
        validate.require_one_score_per_pair(scored, pairs, keys)
    return scored


def _category(responses: DataFrame, true_false: bool) -> Column:
    label = F.col(validate.category_column(responses))
    return text.expected_boolean(label) if true_false else text.normalize_category(label)


def _checked(
    responses: DataFrame, key: str, dataset_name: str | None, true_false: bool, lists: set[str] = frozenset({"responses"})
) -> Callable | None:
    """How an answer is judged against ``_category``, or None when accuracy does not apply; raises on bad input."""
    validate.require_columns(responses, {key, "center_response", "label_gt", *lists}, "answer table")
    by_category = validate.check_answers(responses, key, dataset_name, judge_categories=not true_false)
    if true_false:
        return text.says_boolean
    return text.category_accuracy if by_category else None


def analyze_rows(
    responses: DataFrame,
    scorers: Scorers = NO_SCORERS,
    dataset_name: str | None = None,
    true_false: bool = False,
    key: str = "question_id",
) -> tuple[DataFrame, list[str]]:
    """The answer table with its metric columns, and their names.

    :func:`summarise` gives the statistics of the result once it is written.
    """
    accuracy = _checked(responses, key, dataset_name, true_false)
    # All texts of a comparison are in the row: these scores need no shuffle. Each text is in two
    # comparisons and cut into tokens once.
    tokens = {c: f"_tokens_{c}" for c in ("label_gt", "clean_response", "center_response")}
    scored = with_clean_and_center(responses)
    scored = scored.withColumns({name: text.tokens(F.col(c)) for c, name in tokens.items()})
    for name, reference, candidate in COMPARISONS:
        scored = with_row_scores(scored, scorers, reference, candidate, f"_{name}", tokens)
    scored = scored.drop(*tokens.values())
    if scorers.of_models():
        validate.require_unique(responses, key)
        pairs = comparison_pairs(with_clean_and_center(responses), key)
        pairs = with_model_scores(pairs, scorers, [key, "comparison"])
        scored = scatter_scores(scored, pairs, scorers.of_models(), key)
    names = [f"{m}_{c}" for m in scorers.names() for c, _, _ in COMPARISONS]
    if accuracy:
        category = _category(responses, true_false)
        scored = scored.withColumns(
            {
                CLEAN_ACCURACY: accuracy(category, F.col("clean_response")),
                CENTER_ACCURACY: accuracy(category, F.col("center_response")),
            }
        )
        names += [CLEAN_ACCURACY, CENTER_ACCURACY]
    return scored.drop("clean_response"), names


def summarise(scored: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(mean and std, box plot statistics)`` of a written scored table."""
    boxes = stats.box_plot_statistics(stats.metric_values(scored, names), names)
    return stats.metric_statistics(scored, names), boxes


def analyze_positions(
    responses: DataFrame,
    scorers: Scorers = NO_SCORERS,
    dataset_name: str | None = None,
    true_false: bool = False,
    key: str = "question_id",
) -> DataFrame:
    """Mean of every metric per answer position and for the centre answer.

    Answer and label are in the same row, so pairs are made without a join.
    """
    with passing_shuffles(responses.sparkSession):
        accuracy = _checked(responses, key, dataset_name, true_false)
        if scorers.of_models():
            validate.require_unique(responses, key)
    columns = [key, F.col("label_gt").alias("reference"), text.tokens(F.col("label_gt")).alias(_TOKENS)]
    if accuracy:
        columns.append(_category(responses, true_false).alias("_category"))
    listed = positions.listed_answers(F.col("responses"), F.col("center_response"))
    # The label is cut into tokens before it is repeated for every answer. No list is empty: "outer" only spares a filter
    # that would make all lists once more to see that.
    rows = responses.select(*columns, listed.alias("_listed"))
    rows = rows.select(*[c for c in rows.columns if c != "_listed"], F.inline_outer("_listed"))
    return mean_by_position(rows, scorers, accuracy, key)


def analyze_long_positions(
    answers: DataFrame,
    questions: DataFrame,
    scorers: Scorers = NO_SCORERS,
    dataset_name: str | None = None,
    true_false: bool = False,
    key: str = "question_id",
) -> DataFrame:
    """The same from long answers ``(key, position, response)`` and questions with label and centre.

    The checks are those of answer lists, and every answer must have a question. Positions that nobody
    answered appear without means. The label is joined to every answer; a question with very many answers is salted.
    """
    accuracy = _checked(questions, key, dataset_name, true_false, set())
    validate.require_unique(questions, key)
    validate.require_known(answers, questions, key)
    columns = [key, F.col("label_gt").alias("reference"), text.tokens(F.col("label_gt")).alias(_TOKENS)]
    if accuracy:
        columns.append(_category(questions, true_false).alias("_category"))
    labels = questions.select(*columns)
    everything = positions.with_center_position(answers, questions, key)
    sizes = measure_groups(answers, key)
    rows = salt(everything, sizes, F.struct("position"))
    return mean_by_position(attach(rows, labels, sizes).drop("_salt"), scorers, accuracy, key)


def mean_by_position(pairs: DataFrame, scorers: Scorers, accuracy: Callable | None, key: str) -> DataFrame:
    means = {m: f"mean_{m}" for m in scorers.names()}
    if accuracy:
        # Beside the tokens, which fold the answer too.
        pairs = pairs.withColumn("accuracy", accuracy(F.col("_category"), F.col("candidate"))).drop("_category")
        means["accuracy"] = MEAN_ACCURACY
    scored = with_row_scores(pairs, scorers, "reference", "candidate", tokens={"reference": _TOKENS}).drop(_TOKENS)
    scored = with_model_scores(scored, scorers, [key, "position"])
    with passing_shuffles(pairs.sparkSession), arrow_batches(pairs.sparkSession, BATCH_BYTES):
        return positions.position_means(scored, means)
