"""Statistics of metric values. Not-a-number, infinities and text that is no number are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions.vectors import is_finite
from answerlab.operators import exact
from answerlab.plans.quantiles import exact_quantiles

# Fixed value: whisker length of a box plot, in interquartile ranges.
WHISKER = 1.5
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(value: Column) -> Column:
    """The value where it is a finite number, else null."""
    return F.when(is_finite(value), value)


def number_from_text(value: Column) -> Column:
    """Text as a number, null where it is none."""
    return F.when(value.rlike(_NUMBER), F.trim(value).try_cast("double"))


def _numbers(scored: DataFrame, metrics: list[str]) -> DataFrame:
    types = dict(scored.dtypes)
    return scored.select(
        *[
            finite(number_from_text(F.col(m)) if types[m] == "string" else F.col(m).cast("double")).alias(m)
            for m in metrics
        ]
    )


def metric_values(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """``(metric, value)`` rows of all finite values of the metric columns."""
    return _numbers(scored, metrics).unpivot([], metrics, "metric", "value").where("value is not null")


def metric_statistics(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """``(metric, mean, std, n)`` of the metric columns; mean and std are null without values.

    The standard deviation is that of the population. Sums are exact: the same on any partitioning. One pass
    over the columns as they are; rows are turned into ``metric`` rows only after it.
    """
    names = {f"_{i}": F.col(f"`{m}`") for i, m in enumerate(metrics)}
    totals = exact.statistics(_numbers(scored, metrics), [], names)
    each = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(name)["mean"].alias("mean"),
            F.col(name)["std"].alias("std"),
            F.coalesce(F.col(name)["n"], F.lit(0)).alias("n"),
        )
        for name, m in zip(names, metrics, strict=True)
    ]
    # A table without rows has no group; its metrics are listed all the same.
    one = scored.sparkSession.range(1)
    return one.join(totals, F.lit(True), "left").select(F.inline(F.array(*each)))


def metric_list(frame: DataFrame, metrics: list[str]) -> DataFrame:
    """The metric names with their order; as many rows as there are names in the call."""
    names = F.posexplode(F.array(*[F.lit(m) for m in metrics])).alias("metric_order", "metric")
    return frame.sparkSession.range(1).select(names)


def box_plot_statistics(values: DataFrame, metrics: list[str]) -> DataFrame:
    """What a box plot with means shows, per metric: box, whiskers and the number of outliers."""
    known = values.where(F.col("metric").isin(*metrics) & is_finite(F.col("value")))
    box = exact_quantiles(known, "metric", "value", [0.25, 0.5, 0.75]).select(
        "metric",
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    # One row per name in the call, so the box table is small whatever the data.
    fences = known.join(F.broadcast(box), "metric")
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    value, low, high = F.col("value"), F.col("q1") - reach, F.col("q3") + reach
    whiskers = fences.groupBy("metric", "q1", "median", "q3").agg(
        F.avg("value").alias("mean"),
        F.least(F.min(F.when(value >= low, value)), F.first("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(value <= high, value)), F.first("q3")).alias("whisker_high"),
        F.count_if((value < low) | (value > high)).alias("outliers"),
    )
    names = F.broadcast(metric_list(values, metrics))
    return whiskers.join(names, "metric", "right").drop("metric_order")


def run_summary(scored: DataFrame, mean_only: list[str], mean_and_std: list[str] = ()) -> DataFrame:
    """``(metric, mean, std)`` of a run; std only for the accuracy metrics."""
    rows = metric_statistics(scored, [*mean_only, *mean_and_std])
    std = F.when(F.col("metric").isin(*mean_and_std), F.col("std")) if mean_and_std else F.lit(None).cast("double")
    return rows.select("metric", "mean", std.alias("std"))


def accuracy_summary(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population standard deviation over answered rows (null means unanswered)."""
    return run_summary(scored, [], columns)
