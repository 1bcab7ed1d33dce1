"""Checks to run before costly work. Each check has a report (a DataFrame) and a raising form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerlab.functions import text, vectors as vec
from answerlab.plans.skew import measure_groups


def column_report(frame: DataFrame, required: set[str]) -> DataFrame:
    """``(name, present, filled)`` of the required columns: whether there, and in how many rows not null. One pass."""
    counts = [F.count(frame[c] if c in frame.columns else F.lit(None)).alias(f"c{i}") for i, c in enumerate(sorted(required))]
    told = [
        F.struct(F.lit(c).alias("name"), F.lit(c in frame.columns).alias("present"), F.col(f"c{i}").alias("filled"))
        for i, c in enumerate(sorted(required))
    ]
    return frame.agg(*counts).select(F.inline(F.array(*told)))


def require_columns(frame: DataFrame, required: set[str], what: str = "table") -> None:
    missing = sorted(required - set(frame.columns))
    if missing:
        raise ValueError(f"{what} is missing required column(s): {', '.join(missing)}")


def require_rows(frame: DataFrame, what: str = "table") -> None:
    if frame.isEmpty():
        raise ValueError(f"{what} contains no data rows")


def _report(bad: DataFrame, key: str, column: str) -> DataFrame:
    total = bad.agg(F.count(F.lit(1))).scalar()
    return bad.select(key, column).withColumn("total_rows", total)


def blank_values(frame: DataFrame, column: str, key: str) -> DataFrame:
    """The rows whose value is blank, each with the total number of such rows."""
    return _report(frame.where(text.is_blank(F.col(column))), key, column)


def require_values(frame: DataFrame, column: str, key: str) -> None:
    for row in blank_values(frame, column, key).orderBy(key).take(1):
        raise ValueError(f"row {row[key]!r}: {column!r} is empty ({row['total_rows']} such rows)")


def require_unique(frame: DataFrame, key: str) -> None:
    """Results are put back by key, so no two rows may share one."""
    sizes = measure_groups(frame, key)
    if sizes.largest > 1:
        raise ValueError(f"{key!r} is not unique: one value has {sizes.largest} rows")


def require_known(rows: DataFrame, known: DataFrame, key: str) -> None:
    """Every row's key must be one of ``known``."""
    for row in rows.select(key).join(known.select(key), key, "left_anti").orderBy(key).take(1):
        raise ValueError(f"row {row[key]!r} has no question")


def invalid_categories(frame: DataFrame, column: str, key: str) -> DataFrame:
    """The rows whose normalised category is not one of the four, each with their total number."""
    category = text.normalize_category(F.col(column))
    return _report(frame.where(~F.coalesce(category.isin(*text.CATEGORIES), F.lit(False))), key, column)


def uses_categories(frame: DataFrame, dataset_name: str | None = None) -> bool:
    """Whether category accuracy applies: by the name given, or by every row's data set name."""
    if dataset_name is not None:
        return dataset_name.strip().casefold() in text.CATEGORY_DATASET_NAMES
    if "dataset_name" not in frame.columns:
        return False
    every = frame.agg(F.bool_and(text.is_category_dataset(F.col("dataset_name"))).alias("every")).first()
    return bool(every["every"])


def category_column(frame: DataFrame) -> str:
    return "category" if "category" in frame.columns else "label_gt"


def require_categories(frame: DataFrame, key: str) -> None:
    column = category_column(frame)
    for row in invalid_categories(frame, column, key).orderBy(key).take(1):
        raise ValueError(f"row {row[key]!r}: invalid category {row[column]!r} ({row['total_rows']} such rows)")


def check_answers(frame: DataFrame, key: str, dataset_name: str | None, judge_categories: bool) -> bool:
    """Raise unless there are rows and all have a label and, where categories are judged, a category of the four.

    Returns whether they are judged. All checks are one aggregation.
    """
    column = category_column(frame)
    normal = text.normalize_category(F.col(column))
    wrong = ~F.coalesce(normal.isin(*text.CATEGORIES), F.lit(False)) if judge_categories else F.lit(False)
    blank = text.is_blank(F.col("label_gt"))
    named = F.bool_and(text.is_category_dataset(F.col("dataset_name"))) if "dataset_name" in frame.columns else F.lit(False)
    found = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank).alias("blanks"),
        F.min(F.when(blank, F.col(key))).alias("blank"),
        F.count_if(wrong).alias("wrongs"),
        F.min_by(F.struct(F.col(key).alias("key"), F.col(column).alias("value")), F.when(wrong, F.col(key))).alias("wrong"),
        named.alias("named"),
    ).first()
    if not found["rows"]:
        raise ValueError("answer table contains no data rows")
    if dataset_name is not None:
        named = dataset_name.strip().casefold() in text.CATEGORY_DATASET_NAMES
    else:
        named = bool(found["named"])
    if judge_categories and named and found["wrongs"]:
        bad = found["wrong"]
        raise ValueError(f"row {bad['key']!r}: invalid category {bad['value']!r} ({found['wrongs']} such rows)")
    if found["blanks"]:
        raise ValueError(f"row {found['blank']!r}: 'label_gt' is empty ({found['blanks']} such rows)")
    return judge_categories and named


def _pair_counts(scores: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    return (
        pairs.select(*keys, F.lit(1).alias("_pair"))
        .unionByName(scores.select(*keys, F.lit(0).alias("_pair")))
        .groupBy(*keys)
        .agg(F.sum("_pair").alias("pairs"), F.sum(1 - F.col("_pair")).alias("scores"))
    )


def score_faults(scores: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys without exactly one pair and one score, with how many there are of each."""
    return _pair_counts(scores, pairs, keys).where("pairs <> 1 OR scores <> 1")


def require_one_score_per_pair(scores: DataFrame, pairs: DataFrame, keys: list[str]) -> None:
    """Every pair has exactly one score row."""
    counted = _pair_counts(scores, pairs, keys)
    row = counted.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("scores"), F.lit(0)).alias("scores"),
        F.count_if((F.col("pairs") != 1) | (F.col("scores") != 1)).alias("wrong"),
    ).first()
    if row["wrong"]:
        raise ValueError(f"{row['scores']} scores for {row['pairs']} pairs; {row['wrong']} keys do not match")


def vector_faults(frame: DataFrame, key: str, column: str = "v", dimension: int | None = None) -> DataFrame:
    """All rows with an unusable vector, and why."""
    fault = vec.vector_fault(F.col(column), dimension)
    return frame.select(key, fault.alias("fault")).where("fault is not null")
