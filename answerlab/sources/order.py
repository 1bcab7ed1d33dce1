"""Numbers of rows in file order, for tables without a key.

The rows of a table lie in splits: files, or blocks of them. A row's number is the number of rows in all earlier
splits, by name of the file, plus its place in its own. Counting reads no column, and one row for each
split is all that is brought together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from answerlab.session import materialise

_FILE, _BLOCK, _PLACE, _BEFORE = "_order_file", "_order_block", "_order_place", "_order_before"
#: Splits are broadcast up to this many bytes; beyond it the table is joined by file, which is a shuffle.
BROADCAST_BYTES = 64 << 20


def _placed(frame: DataFrame) -> tuple[DataFrame, Column]:
    """The table with file, block and place of every row, and the place at which a split begins."""
    path = F.col("_metadata.file_path").alias(_FILE)
    if "row_index" in frame.select("_metadata").schema["_metadata"].dataType.names:
        # Parquet knows the place of a row in its file, however the file is cut.
        return frame.select("*", path, F.lit(0).cast("bigint").alias(_BLOCK), F.col("_metadata.row_index").alias(_PLACE)), F.lit(0)
    # Elsewhere the rows of a block follow each other in one task, numbered from some number on.
    block = F.col("_metadata.file_block_start").alias(_BLOCK)
    return frame.select("*", path, block, F.monotonically_increasing_id().alias(_PLACE)), F.min(_PLACE)


def number_rows(frame: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``key``: the number of each row from 0, in the order of file names and then of rows in a file.

    ``frame`` is a table as it was read: files of any number and size. The numbers are those of one task
    that reads all files one after the other, whatever the splits.
    """
    try:
        placed, begin = _placed(frame)
    except AnalysisException as failure:
        raise ValueError(f"rows can only be numbered in a table read from files; it needs a column {key!r}") from failure
    splits = placed.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("rows"), begin.alias("begin"))
    earlier = Window.orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("begin")
    offsets = materialise(splits.select(_FILE, _BLOCK, before.alias(_BEFORE)))
    size = offsets.agg(F.sum(F.octet_length(_FILE) + 64)).first()[0] or 0
    joined = placed.join(F.broadcast(offsets) if size <= broadcast_bytes else offsets, [_FILE, _BLOCK])
    return joined.select(*frame.columns, (F.col(_BEFORE) + F.col(_PLACE)).cast("bigint").alias(key))
