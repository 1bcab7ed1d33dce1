"""Reading question and answer tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlab.operators.pairs import blanks_to_null
from answerlab.operators.validate import require_columns, require_rows
from answerlab.sources.literals import decode_list
from answerlab.sources.order import number_rows

QUESTION_COLUMNS = {"question", "category"}
RESPONSE_COLUMNS = {"LLM_response", "center_response", "label_gt"}

# Split that is evaluated, by data set name.
DATASET_SPLITS = {
    "rotten tomatoes": "train_test",
    "imdb": "test",
    "pminervini/true-false": "facts",
    "domenicrosati/truthfulqa": "train",
    "iamasq/defan": "train",
    "openai/gsm8k": "test",
    "mbzuai": "test",
    "mbzuai_expanded": "test",
}


@dataclass(frozen=True)
class Dataset:
    """Where a named data set lies; ``split`` selects rows, and then the table must have such a column."""

    path: str
    format: str = "parquet"
    split: str | None = None


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Parquet, or CSV in which quoted fields may span lines and only an empty field is missing.

    A CSV with quoted line breaks cannot be split between tasks; convert large ones once.
    """
    if format == "csv":
        # Columns are matched by name in every file of a folder.
        return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False)
    return spark.read.format(format).load(path)


def with_key(frame: DataFrame, key: str) -> DataFrame:
    """The table with a key column; one without it, as it was read, gets the row number from 0 in file order."""
    return frame if key in frame.columns else number_rows(frame, key)


def read_questions(spark: SparkSession, path: str, format: str = "parquet", key: str = "id") -> DataFrame:
    questions = read_table(spark, path, format)
    require_columns(questions, QUESTION_COLUMNS, "question table")
    require_rows(questions, "question table")
    return with_key(questions, key)


def _other_format(failure: Exception) -> bool:
    """Whether a table could not be opened because its files are not of the format; a damaged file still is.

    Parquet's own mark is missing at the end of such files, or there is no Parquet file from which to take columns.
    """
    said = str(failure)
    return "UNABLE_TO_INFER_SCHEMA" in said or "is not a Parquet file" in said or "Expected magic number" in said


def read_dataset(spark: SparkSession, name: str, catalog: dict[str, Dataset]) -> DataFrame:
    """A data set by name; where its files are not of its format they are read as CSV.

    A place that is missing, not allowed or damaged is an error, not a CSV.
    """
    wanted = name.strip().lower()
    known = {entry.lower(): dataset for entry, dataset in catalog.items()}
    if wanted not in known:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(known))}")
    dataset = known[wanted]
    try:
        frame = read_table(spark, dataset.path, dataset.format)
    except Exception as failure:  # Spark reports files of another format in several classes
        if not _other_format(failure):
            raise
        frame = read_table(spark, dataset.path, "csv")
    split = dataset.split or DATASET_SPLITS.get(wanted)
    if not split:
        return frame
    require_columns(frame, {"split"}, f"data set {name!r}")
    return frame.where(F.col("split") == split)


def read_responses(
    spark: SparkSession, path: str, format: str = "parquet", key: str = "question_id"
) -> DataFrame:
    """The answer table with ``responses`` as an array, whatever its file format."""
    table = read_table(spark, path, format)
    require_columns(table, RESPONSE_COLUMNS, "answer table")
    require_rows(table, "answer table")
    table = with_key(table, key)
    if dict(table.dtypes)["LLM_response"] == "string":
        responses = decode_list(F.col("LLM_response"), F.col(key))
    else:
        responses = F.coalesce(F.col("LLM_response"), F.array().cast("array<string>"))
    return table.withColumn("responses", blanks_to_null(responses)).drop("LLM_response")
