"""Agreement of several class distributions about the same item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: smallest probability and the amount added to totals before dividing.
EPSILON = 1e-12


def kl_confidence(
    distributions: DataFrame, classes: list, group: str = "grp", model: str = "model"
) -> DataFrame:
    """``exp(-mean KL(model || mean of models))`` per group, from rows (group, model, class, prob).

    A class a model does not mention counts as 0. The divergence is split into the part
    that depends on one model and the part that depends on the mean, so both come out of
    one aggregation and nothing is joined back.
    """
    per_model = distributions.groupBy(group, model).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("class") == c, F.col("prob"))), F.lit(0.0)).alias(f"_p{i}")
            for i, c in enumerate(classes)
        ]
    )
    names = [f"_p{i}" for i in range(len(classes))]

    def scaled(columns):
        total = sum((F.col(c) for c in columns), F.lit(0.0)) + EPSILON
        return {c: F.col(c) / total for c in columns}

    def clipped(column):
        return F.greatest(F.lit(EPSILON), F.least(F.lit(1.0), column))

    per_model = per_model.withColumns(scaled(names))
    once_more = scaled(names)
    per_model = per_model.withColumns({f"_c{c}": clipped(once_more[c]) for c in names})
    own = sum((F.col(f"_c{c}") * F.ln(f"_c{c}") for c in names), F.lit(0.0))
    per_group = per_model.groupBy(group).agg(
        F.avg(own).alias("_own"),
        F.count(F.lit(1)).alias("models"),
        *[F.avg(c).alias(c) for c in names],
        *[F.avg(f"_c{c}").alias(f"_c{c}") for c in names],
    )
    mean = scaled(names)
    cross = sum((F.col(f"_c{c}") * F.ln(clipped(mean[c])) for c in names), F.lit(0.0))
    return per_group.select(group, "models", F.exp(-(F.col("_own") - cross)).alias("confidence"))
