"""Helpers on grouped rows and graphs, shared by the operators that compare documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerlab.session import materialise


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with the same value of an integer ``key``, from batches sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = table.column(key).to_numpy()
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        begins = [0, *edges.tolist()]
        for begin, end in zip(begins, [*begins[1:], len(values)], strict=True):
            part = table.slice(begin, end - begin)
            if held and held[0].column(key)[0].as_py() != values[begin]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def map_groups(
    rows: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply ``work`` to the rows of every value of the long column ``key``, one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, key):
            yield from work(group)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def in_tiles(rows: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Deal the members of every group into blocks and repeat each for the pairs of blocks it is in.

    Every pair of members of a group meets in exactly one tile, where a row's ``_side`` is 0 for the first
    block, 1 for the second, and 2 where both are the same. Adds ``_tile``; a tile holds about 2 * block rows.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    # By the member alone: groups that overlap deal their members alike, so their forests have the same edges.
    own = F.pmod(F.xxhash64(F.col(member)), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    tile = F.xxhash64(F.col(group), F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.withColumns({"_side": side.cast("int"), "_tile": tile}).drop("_blocks", "_own", "_other")


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest index each index is connected with."""
    count = len(linked)
    labels = np.arange(count)
    while True:
        lowest = np.minimum(labels, np.where(linked, labels[None, :], count).min(axis=1, initial=count))
        lowest = lowest[lowest]
        if np.array_equal(lowest, labels):
            return labels
        labels = lowest


def spanning(linked: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For the members of a tile, the index each needs an edge to; itself where it needs none.

    The links within a block are found in the tile of that block with itself, so a tile of two blocks only
    joins what is not connected within them.
    """
    labels = forest(linked)
    if (sides == 2).all():
        return labels
    own = np.arange(len(labels))
    inner = forest(linked & (sides[:, None] == sides[None, :]))
    return np.where(inner == own, labels, own)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the smallest node of its component.

    Large-star and small-star steps alternate until every node points at a root. The edges of a node are
    never gathered: minima are aggregates, and joined back. All steps are written, so no lineage grows, and both
    sides of every join have a shuffle of their own, of which Spark splits the node that most edges are on.
    """
    stars = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        children = stars.select(F.col("u").alias("v")).distinct()
        settled = stars.groupBy("u").count().where("count > 1").limit(1).isEmpty()
        if settled and stars.join(children, "v", "left_semi").limit(1).isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        lowest = materialise(lowest)
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(lowest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars = materialise(small)
