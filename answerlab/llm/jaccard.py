"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles of SHINGLE words (of all its words if it has fewer). Documents link
when the Jaccard similarity of their sets is at least THRESHOLD.

1. Every text is read once: a 128-bit digest of its set and MINIMA tokens sampled from it by min-hashing.
   Documents with equal sets are one class, represented by its first row.
2. Chosen paths: from the root of every run, a node picks one or (one time in four) two of the sampled
   coordinates by its own hash, and sends each set to the child named by its token there, so sets stay
   together by the tokens they share. Buckets of one set end; buckets of at most LIMIT sets are compared by
   brute force; larger ones are split again. Sets that are alike stay together whatever the token, so a bucket
   that keeps most of its parent is compared in tiles, as are those at depth DEPTH. A pair at the threshold
   survives a run with known probability; runs are repeated until RECALL is reached (:func:`runs_for`).
3. Pairs whose samples agree in AGREE places are candidates. Within the connected groups of candidates all
   pairs are compared exactly, on the whole sets, each pair in exactly one tile; links are counted there
   and never written one by one.

Nothing is capped: groups of any size are dealt into tiles of bounded size. Defined results: a null text
or one without words is a class of its own with no links; rows of equal id are rows of their own; ties are
impossible, since the comparison is on integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from answerlab.llm import words as W
from answerlab.llm.columns import renamed
from answerlab.llm.graphs import components, in_tiles, map_groups, spanning
from answerlab.session import arrow_batches, materialise

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # the threshold, 0.8, as a fraction of integers
MINIMA = 64
#: At similarity 0.8 fewer than 35 of 64 samples agree with probability below 1e-6.
AGREE = 35
LIMIT = 256
DEPTH = 6
#: A bucket that keeps this share of its parent holds sets that are alike, and is compared without more splits.
ALIKE = 0.7
RECALL = 0.9999
BLOCK = 256
#: Bytes of text whose shingles are found together; they take some 20 times as much memory.
BATCH = 2 << 20
_RANDOM = np.random.default_rng(414243)
_FACTORS = _RANDOM.integers(0, 1 << 62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RANDOM.permutation(MINIMA).tolist()
_SECOND = np.uint64(0xA0761D6478BD642F)


def runs_for(recall: float, depth: int, similarity: float = NUMERATOR / DENOMINATOR) -> int:
    """Runs after which a pair of that similarity has met with probability ``recall``.

    A node picks one coordinate, and a second one time in four; a branch of the pair goes on when it agrees
    there. The chance that no branch is left is iterated over the depth.
    """
    lost = 0.0
    for _ in range(depth):
        ends = 1 - similarity + similarity * lost
        lost = ends * (0.75 + 0.25 * ends)
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts one after the other, offsets per text), found piece by piece."""
    parts, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, piece in texts.pieces(BATCH):
        hashes, offsets = _shingles(piece)
        parts.append(hashes)
        ends.append(offsets[1:] + ends[-1][-1])
    return np.concatenate(parts), np.concatenate(ends)


def _shingles(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    words = W.split_words(texts)
    owners, counts = words.owners, words.counts
    whole = np.arange(len(owners)) + SHINGLE <= words.first[1:][owners]
    found = [W.runs(words, SHINGLE)[whole]]
    whose = [owners[whole]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        if len(short):
            found.append(W.mix(W.runs(words, size)[words.first[:-1][short]] + np.uint64(size)))
            whose.append(short)
    hashes, whose = np.concatenate(found), np.concatenate(whose)
    _, first = np.unique(W.mix(hashes + whose.astype(np.uint64) * _SECOND), return_index=True)
    first = first[np.lexsort((hashes[first], whose[first]))]
    hashes, whose = hashes[first], whose[first]
    return hashes, np.searchsorted(whose, np.arange(len(texts) + 1))


def _digest(docs: DataFrame, text: str) -> DataFrame:
    """All columns and _row, _n, _key, _key2 and the sample _sig; written, so row numbers stay."""
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for table, texts in W.batches_of(batches, text, BATCH):
            hashes, offsets = shingle_sets(texts)
            count = len(texts)
            some = np.flatnonzero(np.diff(offsets))
            starts = offsets[:-1][some]
            rows = row + np.arange(count)
            keys = np.zeros((2, count), dtype=np.uint64)
            keys[0] = rows  # a text without words is like no other
            signature = np.zeros((count, MINIMA), dtype=np.uint32)
            if len(some):
                keys[0, some] = np.add.reduceat(W.mix(hashes), starts)
                keys[1, some] = np.add.reduceat(W.mix(hashes ^ _SECOND), starts)
                for place, factor in enumerate(_FACTORS):
                    signature[some, place] = np.minimum.reduceat(hashes * factor, starts) >> np.uint64(32)
            places = np.arange(count + 1, dtype=np.int32) * MINIMA
            columns = [table.column(name) for name in names] + [
                pa.array(rows),
                pa.array(np.diff(offsets).astype(np.int32)),
                pa.array(keys[0].view(np.int64)),
                pa.array(keys[1].view(np.int64)),
                pa.ListArray.from_arrays(places, signature.view(np.int32).ravel()),
            ]
            yield from pa.table(columns, names=[*names, "_row", "_n", "_key", "_key2", "_sig"]).to_batches()
            row += count

    rows = docs.mapInArrow(run, f"{kinds}, _row long, _n int, _key long, _key2 long, _sig array<int>")
    with arrow_batches(docs.sparkSession, 2 * BATCH):
        return materialise(rows)


def _buckets(reps: DataFrame) -> DataFrame:
    """(_bucket, rep, _size): the buckets that are compared by brute force, without repeated ones."""
    picks = [(run, _ORDER[run % MINIMA]) for run in range(runs_for(RECALL, DEPTH))]
    picks += [(run, _ORDER[(len(picks) + run // 4) % MINIMA]) for run, _ in picks[::4]]
    roots = F.array(*[F.xxhash64(F.lit(run), F.lit(c), F.get("sig", F.lit(c))) for run, c in picks])
    entries = reps.select("rep", F.explode(roots).alias("path"), F.lit(None).cast("long").alias("_parent"))
    done = []
    for depth in range(1, DEPTH + 1):
        # Written, as they are counted and then joined with their counts; both sides of that join have a
        # shuffle of their own, so Spark can split a bucket that holds many sets.
        entries = materialise(entries)
        sizes = entries.groupBy("path").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
        entries = materialise(entries.join(materialise(sizes), "path"))
        small = entries.where(F.col("_size") <= LIMIT).groupBy("path").agg(F.array_sort(F.collect_set("rep")).alias("_reps"))
        # The runs find the same buckets again and again; each set of members is compared once.
        small = small.select("_reps").distinct().withColumn("_bucket", F.xxhash64("_reps"))
        done.append(small.select("_bucket", F.explode("_reps").alias("rep"), F.size("_reps").alias("_size")))
        entries = entries.where(F.col("_size") > LIMIT)
        if entries.isEmpty():
            break
        alike = F.coalesce(F.col("_size") >= ALIKE * F.col("_parent"), F.lit(False)) | F.lit(depth == DEPTH)
        tiled = entries.where(alike)
        done.append(tiled.select(F.col("path").alias("_bucket"), "rep", F.col("_size").cast("int").alias("_size")))
        entries = entries.where(~alike)
        if depth == DEPTH:
            break
        path = F.col("path")
        first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(MINIMA)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(MINIMA - 1)), F.lit(MINIMA)).cast("int")
        twice = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0
        chosen = F.when(twice, F.array(first, second)).otherwise(F.array(first))
        split = entries.select("rep", "path", F.col("_size").alias("_parent"), F.explode(chosen).alias("c"))
        split = split.join(reps.select("rep", "sig"), "rep")
        entries = split.select("rep", F.xxhash64("path", "c", F.get("sig", F.col("c"))).alias("path"), "_parent")
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    return buckets


def _agreeing(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the sets of a tile whose samples agree."""
    group = group.sort_by("rep")
    reps = group.column("rep").to_numpy()
    sides = group.column("_side").to_numpy()
    count = len(reps)
    signature = group.column("sig").combine_chunks().flatten().to_numpy().reshape(count, MINIMA)
    linked = np.zeros((count, count), dtype=bool)
    for begin in range(0, count, 32):
        same = (signature[begin : begin + 32, None, :] == signature[None, :, :]).sum(axis=2, dtype=np.uint8)
        linked[begin : begin + 32] = same >= AGREE
    yield from _edges(reps, spanning(linked, sides), np.zeros(0, np.int64))


def _edges(reps: np.ndarray, labels: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = np.flatnonzero(labels != np.arange(len(labels)))
    with_links = np.flatnonzero(links)
    a = np.concatenate([reps[own], reps[with_links]])
    if len(a):
        b = np.concatenate([reps[labels[own]], reps[with_links]])
        counted = np.concatenate([np.zeros(len(own), np.int64), links[with_links]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(counted)], ["a", "b", "links"])


def intersections(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(shared shingles of every two texts, shingles of every text), by matrix products over common shingles."""
    hashes, offsets = shingle_sets(texts)
    owners = np.repeat(np.arange(len(texts)), np.diff(offsets))
    _, number, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    renumbered = np.cumsum(counts > 1) - 1
    number, owners = renumbered[number[shared]], owners[shared]
    order = np.argsort(number, kind="stable")
    number, owners = number[order], owners[order]
    out = np.zeros((len(texts), len(texts)), dtype=np.float32)
    width = 2048
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        low, high = np.searchsorted(number, [begin, begin + width])
        held = np.zeros((len(texts), width), dtype=np.float32)
        held[owners[low:high], number[low:high] - begin] = 1
        out += held @ held.T
    return out.astype(np.int64), np.diff(offsets)


def _linked(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Exact links of a tile: how many each set has, copies counted, and a spanning forest."""
    group = group.sort_by("rep")
    reps, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
    sides = group.column("_side").to_numpy()
    both, sizes = intersections(W.texts_of(group.column("_text")))
    union = sizes[:, None] + sizes[None, :] - both
    linked = DENOMINATOR * both >= NUMERATOR * union
    np.fill_diagonal(linked, False)
    # Every pair counts in one tile only: those within a block in the tile of the block with itself.
    counted = linked & ((sides[:, None] != sides[None, :]) | (sides[:, None] == 2))
    yield from _edges(reps, spanning(linked, sides), counted @ copies)


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of the documents and _row, _root (the first row of its group) and _links."""
    clash = [c for c in docs.columns if c.startswith("_")]
    if clash:
        raise ValueError(f"columns must not start with an underscore: {clash}")
    rows = _digest(docs, text)
    first = F.min(F.struct("_row", F.col("_sig").alias("sig"), "_n")).alias("f")
    classes = materialise(
        rows.groupBy("_key", "_key2").agg(first, F.count(F.lit(1)).alias("copies")).select(
            "_key", "_key2", F.col("f._row").alias("rep"), F.col("f.sig").alias("sig"), F.col("f._n").alias("n"), "copies"
        )
    )
    reps = classes.where("n > 0")
    buckets = _buckets(reps.select("rep", "sig")).join(reps.select("rep", "sig"), "rep")
    tiles = in_tiles(buckets, "_bucket", "_size", "rep", BLOCK)
    schema = "a long, b long, links long"
    candidates = map_groups(tiles.select("_tile", "_side", "rep", "sig"), "_tile", _agreeing, schema)
    near = materialise(components(candidates.select("a", "b")))
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    compared = near.join(sizes, "root").join(reps.select(F.col("rep").alias("node"), "copies"), "node")
    texts = rows.select(F.col("_row").alias("node"), F.col(text).alias("_text"))
    tiles = in_tiles(compared.join(texts, "node").withColumnRenamed("node", "rep"), "root", "_size", "rep", BLOCK)
    with arrow_batches(docs.sparkSession, 2 * BATCH):
        exact = materialise(
            map_groups(tiles.select("_tile", "_side", "rep", "copies", "_text"), "_tile", _linked, schema)
        )
    roots = components(exact.select("a", "b")).select(F.col("node").alias("rep"), F.col("root"))
    links = exact.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.join(roots, "rep", "left").join(links, "rep", "left")
    known = known.select(
        "_key",
        "_key2",
        F.coalesce("root", "rep").alias("_root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
    )
    return rows.drop("_n", "_sig").join(known, ["_key", "_key2"]).drop("_key", "_key2")


def join_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the smallest id of its group) and n_links of every document."""
    linked = link(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    linked = materialise(linked.select("doc_id", "_root", "_links"))
    named = linked.groupBy("_root").agg(F.min("doc_id").alias("class_id"))
    return linked.join(named, "_root").select("doc_id", "class_id", F.col("_links").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of every group, with the columns it had: the one of smallest id (then row)."""
    safe, named = renamed(docs)
    linked = link(safe, named[text], named[doc_id])
    chosen = linked.groupBy("_root").agg(F.min(F.struct(named[doc_id], "_row"))["_row"].alias("_kept"))
    kept = linked.join(chosen, linked["_row"] == chosen["_kept"], "left_semi")
    return kept.select(*safe.columns).toDF(*docs.columns)


#: All pairs of documents that share a shingle, and the groups they form.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [t FOR t IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF t <> ''] AS h FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(h[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, h, unnest(range(1, greatest(len(h) - 3, 2))) AS i FROM w WHERE len(h) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 5 * common >= 4 * (p.n + q.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, (SELECT min(b) FROM reach WHERE reach.a = doc_id) AS class_id,
  (SELECT count(*) FROM links WHERE links.a = doc_id) AS n_links
FROM documents
"""
