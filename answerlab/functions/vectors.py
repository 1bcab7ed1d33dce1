"""Vector and score functions as Spark columns over ``ARRAY<DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_vector(column: Column) -> Column:
    return column.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either side has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))


def semantic_similarity(a: Column, b: Column) -> Column:
    """Cosine limited to [-1, 1]; null where a vector is not usable."""
    usable = is_usable(a) & is_usable(b) & (F.size(a) == F.size(b))
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_usable(v: Column) -> Column:
    """Not empty, every element a finite number, and a finite length above zero."""
    finite = F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) > 0.0) & is_finite(norm(v)), F.lit(False))


def vector_fault(v: Column, dimension: int | None = None) -> Column:
    """Why a vector cannot be used, or null."""
    finite = F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False)))
    wrong_size = (F.size(v) == 0) if dimension is None else (F.size(v) != dimension)
    return (
        F.when(v.isNull() | wrong_size, "wrong shape")
        .when(~finite, "not finite")
        .when(~is_usable(v), "invalid norm")
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    # The total goes in as an array so that it is summed once and not once per element.
    totals = F.array_repeat(_sum(weights), F.size(logits))
    return F.zip_with(weights, totals, lambda weight, total: weight / total)


def factual_score(logits: Column) -> Column:
    """The larger of the probabilities in slots 1 and 2 (slot 0 is contradiction)."""
    top = F.array_max(logits)
    total = _sum(F.transform(logits, lambda x: F.exp(x - top)))
    return F.exp(F.greatest(F.get(logits, F.lit(1)), F.get(logits, F.lit(2))) - top) / total


def hallucination_score(semantic: Column, factual: Column) -> Column:
    """High when an answer is close in wording to its reference but not supported by it."""
    return semantic * (F.lit(1.0) - factual)


def class_scores(scores: Column, labels: Column) -> Column:
    """The whole score list with its labels, best first; equal scores keep the order of the labels."""
    paired = F.transform(
        scores, lambda s, i: F.struct((-s).alias("down"), i.alias("i"), F.get(labels, i).alias("label"), s.alias("score"))
    )
    return F.transform(F.array_sort(paired), lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score")))


def best_class(scores: Column, labels: Column | None = None) -> Column:
    """Label (or index) of the highest score, the first one on a tie."""
    index = F.array_position(scores, F.array_max(scores)) - 1
    return index if labels is None else F.try_element_at(labels, (index + 1).cast("int"))
