"""Column names of the caller, out of the way of an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def renamed(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ... and the new name of every old one, in order."""
    safe = [f"c{i}" for i in range(len(frame.columns))]
    return frame.toDF(*safe), dict(zip(frame.columns, safe, strict=True))
