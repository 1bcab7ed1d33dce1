"""Joining one-row-per-group values back to rows when some groups are very large.

A plain join on the group key sends a whole group to one task. Here the sizes of the
groups are measured first (a count that reads the key column only):

* few groups, small values: the values are broadcast and the rows are not shuffled;
* no large group: a plain join on the key;
* otherwise rows of a large group get a salt, and its value is repeated once per salt.

A group is large beyond ``rows_per_salt`` rows, or beyond the share of all rows at which the list of large groups
would no longer fit a broadcast. So the list is never cut: with N rows and room for G groups, fewer than G groups
can hold more than N / G rows, and no group without salts holds more.

Salting changes where rows are processed, never which rows come out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.session import materialise

ROWS_PER_SALT = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# The list of large groups is kept within this size, see above.
LIST_BYTES = 64 * 1024 * 1024
_ROW_BYTES = 64


@dataclass(frozen=True)
class GroupSizes:
    """What a count per key says about a table."""

    key: str
    groups: int
    largest: int
    key_bytes: int
    rows_per_salt: int
    counts: DataFrame

    @property
    def has_large(self) -> bool:
        return self.largest > self.rows_per_salt

    def large(self) -> DataFrame:
        """(key, salts) of the large groups; they fit a broadcast."""
        salts = F.ceil(F.col("rows") / self.rows_per_salt).cast("int").alias("salts")
        return self.counts.where(F.col("rows") > self.rows_per_salt).select(self.key, salts)


def measure_groups(rows: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> GroupSizes:
    """Count the rows of every group, once; a few numbers come back."""
    counts = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")))
    return summarise_counts(counts, key, rows_per_salt)


def summarise_counts(counts: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> GroupSizes:
    """The same from a table that already has the ``rows`` of every key."""
    kind = counts.schema[key].dataType.simpleString()
    longest_key = F.max(F.octet_length(F.col(key) if kind == "binary" else F.col(key).cast("string")))
    groups, largest, total, key_bytes = counts.agg(
        F.count(F.lit(1)),
        F.coalesce(F.max("rows"), F.lit(0)),
        F.coalesce(F.sum("rows"), F.lit(0)),
        F.coalesce(longest_key, F.lit(0)),
    ).first()
    room = max(1, LIST_BYTES // (key_bytes + _ROW_BYTES))
    return GroupSizes(key, groups, largest, key_bytes, max(rows_per_salt, total // room), counts)


def fits_broadcast(sizes: GroupSizes, bytes_per_group: int | None) -> bool:
    """Whether one value of ``bytes_per_group`` for every group is small; None means no known bound."""
    if bytes_per_group is None:
        return False
    return sizes.groups * (sizes.key_bytes + bytes_per_group + _ROW_BYTES) <= BROADCAST_BYTES


def salt(
    rows: DataFrame, sizes: GroupSizes, spread_by: Column, bytes_per_group: int | None = None
) -> DataFrame:
    """Add ``_salt`` where large groups make it necessary, so that :func:`attach` can use it.

    ``spread_by`` tells the rows of a group apart; its hash picks the salt. Joins that
    follow share the (key, salt) partitioning, so the rows are shuffled once.
    """
    if fits_broadcast(sizes, bytes_per_group) or not sizes.has_large:
        return rows
    spread = F.pmod(F.xxhash64(spread_by), F.coalesce("salts", F.lit(1)))
    return (
        rows.join(F.broadcast(sizes.large()), sizes.key, "left")
        .withColumn("_salt", spread.cast("int"))
        .drop("salts")
    )


def attach(
    rows: DataFrame,
    values: DataFrame,
    sizes: GroupSizes,
    how: str = "inner",
    bytes_per_group: int | None = None,
) -> DataFrame:
    """Join ``values`` (one row per key) to ``rows``; large groups need :func:`salt` first.

    ``bytes_per_group`` is a known upper bound for one value row and allows a broadcast.
    """
    key = sizes.key
    if fits_broadcast(sizes, bytes_per_group):
        return rows.join(F.broadcast(values), key, how)
    if "_salt" not in rows.columns:
        return rows.join(values, key, how)
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    repeated = (
        values.join(F.broadcast(sizes.large()), key, "left")
        .withColumn("_salt", F.explode(salts))
        .drop("salts")
    )
    return rows.join(repeated, [key, "_salt"], how)
