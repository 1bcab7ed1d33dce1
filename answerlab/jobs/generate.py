"""From questions to scored answers: perturb, ask, embed, pick the centre, score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from answerlab.functions import text, vectors as vec
from answerlab.operators import centre as ctr, inference, noise, validate
from answerlab.operators.hallucination import HallucinationModels, hallucination_scores
from answerlab.operators.pairs import comparison_pairs, scatter_scores
from answerlab.plans.skew import attach, measure_groups, salt
from answerlab.session import materialise

@dataclass(frozen=True)
class Models:
    """Factories, see ``operators.inference``. ``logits`` takes premises and hypotheses."""

    answer: Callable
    embed: Callable
    logits: Callable
    semantic: Callable | None = None

    def hallucination(self) -> HallucinationModels:
        return HallucinationModels(self.semantic or self.embed, self.logits)


def generate(
    questions: DataFrame,
    models: Models,
    template: str,
    dataset_name: str | None = None,
    variants: int = noise.VARIANTS,
    rate: float = noise.TYPO_RATE,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """``(answers, scored)`` of questions ``(question_id, question, category)``.

    ``template`` is the prompt, with ``[DOCUMENT]`` where the text goes. ``answers`` has one row per question and
    position, with the errors of its model calls; ``scored`` one row per question with the centre answer, the
    similarities and, for the category data set, the accuracies. A failed call is no answer: it counts neither in
    the centre nor in the median, and a question without any answer takes the defaults. A null label has no score;
    where questions have a column ``reference_answer``, that stands in for it.
    """
    validate.require_unique(questions, "question_id")
    by_category = dataset_name is not None and validate.uses_categories(questions, dataset_name)
    if by_category:
        validate.require_categories(questions, "question_id")
    label = text.normalize_category(F.col("category")) if by_category else F.col("category")
    if "reference_answer" in questions.columns:
        label = ctr.ground_truth(label, F.col("reference_answer"))
    asked = questions.select("question_id", F.col("question").alias("text"), label.alias("label_gt"))
    # Written once: the prompts are read for the distinct calls and again to put the answers back.
    edited = materialise(noise.typo_variants(asked, seed, rate, variants))
    prompts = edited.withColumn("prompt", text.render_prompt(template, F.col("text_edited")))
    answered = inference.generate_answers(prompts, models.answer).drop("prompt")
    embedded = materialise(inference.embed_texts(answered, models.embed, "response"))
    labelled = asked.where("label_gt is not null")
    labels = inference.embed_texts(labelled, models.embed, "label_gt").select(
        "question_id", F.col("v").alias("label_v")
    )
    fault = F.when(F.col("response").isNotNull(), F.coalesce("v_error", "v_fault")).alias("embedding_fault")
    vector = F.when(F.col("response").isNotNull(), F.col("v")).alias("v")
    answers = embedded.select("question_id", "position", "text_edited", "response", "response_error", fault, vector)

    # A vector without length has similarity 0; other faults take an answer out of the centre.
    counts = F.col("embedding_fault").isNull() | (F.col("embedding_fault") == "invalid norm")
    usable = answers.withColumn("v", F.when(counts, F.col("v")))
    sizes = measure_groups(usable, "question_id")
    against = attach(salt(usable, sizes, F.col("position")), labels, sizes, how="left")
    medians = ctr.median_similarity(
        against.select("question_id", vec.cosine(F.col("v"), F.col("label_v")).alias("cos"))
    )
    metrics = ctr.centre_metrics(ctr.with_centre(usable, sizes=sizes), "response")
    clean = answers.where("position = 0").select("question_id", F.col("response").alias("clean_response"))
    per_question = materialise(
        asked.join(metrics, "question_id", "left")
        .join(clean, "question_id", "left")
        .join(medians, "question_id", "left")
    )
    scores = hallucination_scores(comparison_pairs(per_question, blank_counts=True), models.hallucination())
    scored = scatter_scores(per_question, scores, ["hallucination_score"])
    names = [c for c in scored.columns if c.startswith("hallucination_score_")]
    scored = ctr.fill_defaults(scored.withColumnRenamed("text", "sentence"), names)
    if by_category:
        scored = scored.withColumns(
            {
                "dataset_name": F.lit(dataset_name),
                "category": F.col("label_gt"),
                "accuracy_clean_vs_label": text.category_accuracy(F.col("label_gt"), F.col("clean_response")),
                "accuracy_center_vs_label": text.category_accuracy(F.col("label_gt"), F.col("center_response")),
            }
        )
    return answers.drop("v"), scored


def answer_table(answers: DataFrame, scored: DataFrame) -> DataFrame:
    """What :func:`generate` returns as one table for the analysis jobs.

    One row per question: ``responses`` and ``texts_edited`` in the order of positions, which are as many as there
    are variants, and all columns of ``scored``.
    """
    listed = answers.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "response", "text_edited"))).alias("_all")
    )
    lists = listed.select(
        "question_id",
        F.transform("_all", lambda a: a["response"]).alias("responses"),
        F.transform("_all", lambda a: a["text_edited"]).alias("texts_edited"),
    )
    return scored.join(lists, "question_id", "left")
