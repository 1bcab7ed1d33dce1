"""Writing results. Nothing here writes over a source or over an earlier result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlab.operators.validate import require_columns
from answerlab.sources.order import number_rows
from answerlab.sources.tables import read_table


def _location(spark: SparkSession, path: str) -> str:
    """The full name of a place, with its store, however it was written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString().rstrip("/")


def refuse_overwrite(spark: SparkSession, output: str, sources: list[str]) -> None:
    """The output may not be a source, lie inside one, or contain one."""
    out = _location(spark, output) + "/"
    for source in sources:
        src = _location(spark, source) + "/"
        if out.startswith(src) or src.startswith(out):
            raise ValueError(f"the output {output} cannot overwrite the source {source}")


def write_table(frame: DataFrame, output: str, sources: list[str], format: str = "parquet") -> str:
    """Write to a new folder. Spark puts ``_SUCCESS`` there last, so a half result is never taken for one.

    ``sources`` are the places that the frame was read from.
    """
    refuse_overwrite(frame.sparkSession, output, list(sources))
    writer = frame.write.mode("errorifexists")
    if format == "csv":
        writer.csv(output, header=True, escape='"', encoding="UTF-8")
    else:
        writer.format(format).save(output)
    return output


def write_scored(scored: DataFrame, metrics: list[str], output: str, sources: list[str]) -> str:
    """All original columns, then the metric columns."""
    require_columns(scored, set(metrics), "scored table")
    original = [c for c in scored.columns if c not in metrics]
    return write_table(scored.select(*original, *metrics), output, sources)


def write_position_summary(summary: DataFrame, output: str, sources: list[str]) -> str:
    """A CSV folder ending in ``.csv``; the summary has one row per position, so one file."""
    name = output.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name:
        output = output.rstrip("/") + ".csv"
    elif not name.lower().endswith(".csv"):
        raise ValueError("the position summary must have a .csv name")
    ordered = summary.coalesce(1).sortWithinPartitions(F.col("position").asc_nulls_last()).drop("position")
    return write_table(ordered, output, sources, format="csv")


def parquet_to_csv(spark: SparkSession, source: str, output: str, index: str | None = "index") -> str:
    """A columnar table as CSV, its rows numbered from 0 in file order by a first column ``index`` (None: without)."""
    table = read_table(spark, source)
    if index is not None:
        if index in table.columns:
            raise ValueError(f"the table has a column {index!r}")
        table = number_rows(table, index).select(index, *table.columns)
    return write_table(table, output, [source], format="csv")
