"""Hallucination score of answer pairs: close in wording to the reference, but not supported by it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from answerlab.functions import vectors as vec
from answerlab.operators import inference

NAME = "hallucination_score"


@dataclass(frozen=True)
class HallucinationModels:
    """Factories, see ``operators.inference``: an encoder of texts, and class logits of (premises, hypotheses)."""

    semantic: Callable
    logits: Callable


def hallucination_scores(pairs: DataFrame, models: HallucinationModels) -> DataFrame:
    """Add ``hallucination_score`` to (reference, candidate) rows; distinct texts are encoded once.

    A missing side or a failed call leaves null. Both models are called first; their results are put back by digests,
    so where the caller reads the scores only, no text is shuffled for it.
    """
    both = ["reference", "candidate"]
    texts = pairs.select(F.explode(F.array(*both)).alias("text"))
    encoded = inference.call_distinct(texts, ["text"], models.semantic, "array<double>")
    judged = inference.call_distinct(pairs, both, models.logits, "array<double>")
    scored = inference.identified(pairs, {"_ref_id": both[:1], "_cand_id": both[1:], "_pair_id": both})
    kept = scored.columns
    scored = inference.put_back_by(scored, "_ref_id", encoded, "_ref")
    scored = inference.put_back_by(scored, "_cand_id", encoded, "_cand")
    similar = vec.semantic_similarity(F.col("_ref"), F.col("_cand")).alias("_similar")
    scored = inference.put_back_by(scored.select(*kept, similar), "_pair_id", judged, "_logits")
    score = vec.hallucination_score(F.col("_similar"), vec.factual_score(F.col("_logits")))
    return scored.select(*pairs.columns, score.alias(NAME))
