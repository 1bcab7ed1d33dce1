"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Tokens are lower-case letters and digits between blanks, other characters left out. A text leaks an
item when some WINDOW tokens in a row equal the item's tokens at the same distance in all but
WINDOW * 3 / 16 places (an item of fewer tokens counts whole). Substituted tokens are found because the
masks of a seed skip positions: MASKS were chosen by search so that, wherever the allowed substitutions
fall, at least one mask at one place of the window meets none of them. The result is therefore that of
comparing everything with everything.

Every text is hashed at every position and looked up among the seeds of the benchmark; around a hit the
tokens are compared in the same row, so texts are not shuffled. The benchmark is broadcast; its size is
measured first, and beyond BROADCAST_BYTES it is searched for in blocks of items, a pass for each.

Defined results: null or short texts leak nothing; items of fewer than MIN_TOKENS tokens or with a null
text are not searched for; a document id that several rows share is one document; null ids are one
document without an id; equal items are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MASKS = ((0, 1, 5, 7, 8), (0, 2, 3, 5, 8))
SPAN = 9
WINDOW = 16
MIN_TOKENS = 12
BROADCAST_BYTES = 32 << 20
_BLANKS = r"\x20\x09-\x0D"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; other characters but blanks are left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), rf"[^\p{{L}}\p{{N}}{_BLANKS}]+", "")
    return F.array_remove(F.split(plain, f"[{_BLANKS}]+"), "")


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_h``, the 64-bit hashes of the tokens."""
    return rows.withColumn("_h", F.transform(tokens(F.col(text)), lambda token: F.xxhash64(token)))


def _seeds(rows: DataFrame, place: str) -> DataFrame:
    """One row for each position of ``_h`` and mask: the position and the hash of the tokens it keeps."""
    last = F.size("_h") - SPAN
    # No filter on the length: it would be pushed below and split every text twice.
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    placed = rows.withColumn(place, F.explode(places))
    kept = [
        F.xxhash64(F.lit(number), *[F.get("_h", F.col(place) + step) for step in mask])
        for number, mask in enumerate(MASKS)
    ]
    return placed.withColumn("_seed", F.explode(F.array(*kept)))


def _matched(doc: Column, item: Column, at: Column, item_at: Column) -> tuple[Column, Column]:
    """(most equal tokens in a window around the hit, how many a leak needs)."""
    size = F.size(item)
    window = F.least(F.lit(WINDOW), size)
    first = F.greatest(F.lit(0), item_at + SPAN - window, item_at - at)
    last = F.least(item_at, size - window, F.size(doc) - at + item_at - window)
    shift = at - item_at

    def equal_in(start: Column) -> Column:
        places = F.sequence(start, start + window - 1)
        return F.size(F.filter(places, lambda p: F.get(doc, p + shift) == F.get(item, p)))

    found = F.array_max(F.transform(F.sequence(first, last), equal_in))
    needed = window - F.floor(window * 3 / WINDOW).cast("int")
    return F.when(first <= last, found), needed


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, item_id, matched): the documents that leak items, and the most equal tokens in a window.

    One pass over the documents for each block of the benchmark; only leaks are shuffled, to bring those
    of a document and an item together.
    """
    items = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[item_text].alias("_text"))
    items = _hashed(items, "_text").where(F.size("_h") >= MIN_TOKENS).select("item_id", F.col("_h").alias("_item"))
    # A number for every item row tells items of equal id apart.
    items = items.withColumn("_number", F.xxhash64("item_id", "_item")).dropDuplicates(["_number"])
    # Per token 8 bytes in the item and at most as many seeds as masks, of some 64 bytes in a hash table.
    bytes_each = F.size("_item") * (8 + 64 * len(MASKS)) + 128 + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))
    size = items.agg(F.sum(bytes_each)).first()[0] or 0
    blocks = 1 if size <= broadcast_bytes else 2 * -(-size // broadcast_bytes)
    rows = _hashed(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_text")), "_text").drop("_text")
    found = None
    for block in range(blocks):
        own = items.where(F.pmod("_number", F.lit(blocks)) == block) if blocks > 1 else items
        seeds = _seeds(own.select("_number", F.col("_item").alias("_h")), "_item_at").drop("_h")
        hits = _seeds(rows, "_at").join(F.broadcast(seeds), "_seed").join(F.broadcast(own), "_number")
        matched, needed = _matched(F.col("_h"), F.col("_item"), F.col("_at"), F.col("_item_at"))
        # A filter would be pushed into the join, which then copies every text for each of its positions.
        passed = F.explode(F.filter(F.array(matched), lambda m: m >= needed))
        leaks = hits.select("doc_id", "item_id", passed.alias("matched"))
        found = leaks if found is None else found.unionByName(leaks)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that leak no item, with the columns they had."""
    leaked = find_leaks(docs, benchmark, doc_id, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs[doc_id].eqNullSafe(leaked["_leaked"]), "left_anti")


#: The definition without seeds: of tokens that differ in at most 3 of 16 places, four in a row are equal,
#: so runs of four tokens give all candidates.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, [t FOR t IN string_split_regex(
    regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+') IF t <> ''] AS h
  FROM documents),
b AS (
  SELECT item_id, h, least(16, len(h)) AS w FROM (
    SELECT item_id, [t FOR t IN string_split_regex(
    regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+') IF t <> ''] AS h
    FROM benchmark) WHERE len(h) >= 12),
dg AS (SELECT doc_id, i, h[i] AS t1, h[i+1] AS t2, h[i+2] AS t3, h[i+3] AS t4
       FROM (SELECT doc_id, h, unnest(range(1, len(h) - 2)) AS i FROM d)),
bg AS (SELECT item_id, j, h[j] AS t1, h[j+1] AS t2, h[j+2] AS t3, h[j+3] AS t4
       FROM (SELECT item_id, h, unnest(range(1, len(h) - 2)) AS j FROM b)),
diagonals AS (SELECT DISTINCT doc_id, item_id, i - j AS shift
              FROM dg JOIN bg USING (t1, t2, t3, t4)),
pairs AS (
  SELECT g.doc_id, g.item_id, g.shift, d.h AS dh, b.h AS bh, b.w
  FROM diagonals g JOIN d ON d.doc_id = g.doc_id JOIN b ON b.item_id = g.item_id),
windows AS (
  SELECT doc_id, item_id, dh, bh, w, shift, unnest(range(greatest(1, 1 - shift), least(len(bh) - w + 1, len(dh) - shift - w + 1) + 1)) AS s
  FROM pairs),
counted AS (
  SELECT doc_id, item_id, w, len([p FOR p IN range(s, s + w) IF dh[p + shift] = bh[p]]) AS matched FROM windows)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched
FROM counted WHERE matched >= w - (w * 3) // 16 GROUP BY doc_id, item_id
"""
