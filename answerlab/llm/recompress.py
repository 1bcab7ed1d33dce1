"""Substring dedup by recompression: remove every word covered by a window of WINDOW words that also starts in
a document of a smaller id. Windows never cross documents and are judged on the input; the result is exact.

Recompression renames a text level by level. A level first names the runs of equal symbols, then the pairs whose
left symbol is in one half of all symbols and whose right one is in the other. Names are hashes of what they
stand for and the halves are bits of the names, so all tasks give the same names without asking each other.
Whether a border between two symbols goes depends on these two alone. So equal windows have equal symbols
but for some at their ends, whatever stands around them: their *interior*.

1. Each task names its texts up to LEVELS levels. The anchor of a window is the lowest named stretch of up to GRAM
   consecutive symbols of its interior, on the highest level with an interior. Neighbouring windows mostly share it.
   The windows of one anchor are its *context*.
2. Contexts that are equal within a batch are one: the others, of larger ids, go. This keeps a passage that very
   many documents share to a row a batch.
3. The rest is dealt into buckets by the name of the anchor, so equal windows meet. There each context's
   windows are compared by name and hash, and those go that a smaller id has too.
4. The removed stretches of a document meet its text again.

A bucket is one row for each batch of texts, packed and compressed: two million contexts are some 40 MB instead
of 200. ``buckets`` follows spark.sql.shuffle.partitions, so that a bucket's size does not follow the input.

Defined results: a null text has no words; texts below WINDOW words lose nothing; rows of equal ids are not
smaller than each other, so repeated rows lose the same; a null id counts as larger than every other; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerlab.llm import words as W

WINDOW = 13
LEVELS = 1
GRAM = 3
BATCH = 8 << 20
#: Least number of buckets, and buckets for each shuffle partition.
BUCKETS = 1024
BUCKETS_EACH = 4
_LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


class Symbols:
    """The names of all texts on one level; symbol j stands for the words begins[j] to begins[j + 1]."""

    def __init__(self, names: np.ndarray, owners: np.ndarray, begins: np.ndarray):
        self.names, self.owners, self.begins = names, owners, begins

    def next_level(self, salt: int) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, run of every old symbol, whether a run is in the right half, new symbol of every run)."""
        names, owners = self.names, self.owners
        new = np.ones(len(names), dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (owners[1:] != owners[:-1])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(names))).astype(np.uint64)
        held, whose, begins = names[first], owners[first], self.begins[first]
        held = np.where(times > 1, W.mix(held * _BASE + times), held)
        right = (W.mix(held + np.uint64(salt)) >> np.uint64(17)) & np.uint64(1) == 1
        second = np.zeros(len(held), dtype=bool)
        second[1:] = ~right[:-1] & right[1:] & (whose[1:] == whose[:-1])
        symbol = np.cumsum(~second) - 1
        lead = np.flatnonzero(~second)
        made = held[lead].copy()
        paired = np.flatnonzero(np.append(second[1:], False)[lead])
        at = lead[paired]
        made[paired] = W.mix(W.mix(held[at] + np.uint64(salt + 1)) * _OTHER + held[at + 1])
        return Symbols(made, whose[lead], begins[lead]), run, right, symbol


def _lowest(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minimum of values[begin:end] for ranges that are not empty."""
    out = np.empty(len(begins), values.dtype)
    lengths = ends - begins
    width, table = 1, values
    while True:
        at = np.flatnonzero((lengths >= width) & (lengths < 2 * width))
        out[at] = np.minimum(table[begins[at]], table[ends[at] - width])
        if not (lengths >= 2 * width).any():
            return out
        ahead = table.copy()
        ahead[:-width] = np.minimum(table[:-width], table[width:])
        table, width = ahead, 2 * width


def _anchored(symbols: Symbols, begins: np.ndarray, ends: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, first symbol) of the anchors of interiors [begin, end)."""
    names, place = np.zeros(len(begins), np.uint64), np.zeros(len(begins), np.int64)
    sizes = np.minimum(ends - begins, GRAM)
    padded = np.concatenate([symbols.names, np.zeros(GRAM, np.uint64)])
    gram = np.full(len(symbols.names), salt, np.uint64)
    numbers = np.arange(len(gram), dtype=np.uint64)
    for size in range(1, GRAM + 1):
        gram = W.mix(gram * _BASE + padded[size - 1 : size - 1 + len(gram)])
        at = np.flatnonzero(sizes == size)
        if len(at):
            # The name decides in its upper half, then the place: the first one among equals.
            ranked = (gram & _HIGH) | numbers
            best = _lowest(ranked, begins[at], ends[at] - size + 1)
            place[at] = (best & _LOW).astype(np.int64)
            names[at] = W.mix(gram[place[at]] + np.uint64(size))
    return names, place


def contexts_of(words: W.Words, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the whole context, text, first word in it, windows) of all contexts, and the hashes of
    all their windows one after the other."""
    owners = words.owners
    at = np.flatnonzero(np.arange(len(owners)) + window <= words.first[1:][owners])
    none = np.zeros(0, np.int64)
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.view(np.uint64)
    symbols = Symbols(words.hashes, owners, np.arange(len(owners)))
    anchors, places = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    left, begins, ends = np.arange(len(at)), at, at + window
    for level in range(levels + 1):
        if level < levels:
            higher, run, right, symbol = symbols.next_level(2 * level)
            # Outer runs may go on outside; so may pairs that the outer symbols of the rest could be in.
            low, high = run[begins] + 1, run[ends - 1]
            inner = low < high
            low[inner] += right[low[inner]]
            high[inner] -= ~right[high[inner] - 1]
            inner &= low < high
            stay = ~inner
        else:
            stay = np.ones(len(left), dtype=bool)
        named, first = _anchored(symbols, begins[stay], ends[stay], level)
        anchors[left[stay]], places[left[stay]] = named, symbols.begins[first] if len(first) else first
        if level < levels:
            left, begins, ends = left[inner], symbol[low[inner]], symbol[high[inner] - 1] + 1
            symbols = higher
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (places[1:] != places[:-1]) | (anchors[1:] != anchors[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at)))
    hashes = W.runs(words, window)[at]
    # The windows of a context all hold its anchor: the first and the last one hold all of its words.
    whole = W.mix(hashes[first] * _BASE + hashes[first + counts - 1] + counts.astype(np.uint64))
    text = owners[at[first]]
    return anchors[first], whole, text, at[first] - words.first[:-1][text], counts, hashes


def _packed(anchors, ids, keys, starts, counts, hashes) -> bytes:
    """One bucket of a batch. Hashes lose their lowest 16 bits; with the anchor's name they still tell windows apart."""
    parts = [
        np.array([len(anchors)], np.uint32),
        anchors,
        np.diff(ids, prepend=0),
        keys.astype(np.uint32),
        starts.astype(np.uint32),
        counts.astype(np.uint16),
        (hashes >> np.uint64(32)).astype(np.uint32),
        (hashes >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16),
    ]
    return b"".join(part.tobytes() for part in parts)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    size = int(np.frombuffer(data, np.uint32, 1)[0])
    at, out = 4, []
    for kind in (np.uint64, np.int64, np.uint32, np.uint32, np.uint16):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    windows = int(out[-1].sum())
    upper = np.frombuffer(data, np.uint32, windows, at).astype(np.uint64)
    lower = np.frombuffer(data, np.uint16, windows, at + upper.nbytes // 2).astype(np.uint64)
    out[1] = np.cumsum(out[1])
    return (*out, upper << np.uint64(16) | lower)


_ROWS = pa.schema([("bucket", pa.int32()), ("solved", pa.bool_()), ("size", pa.int32()), ("data", pa.binary())])


def _deal(ids: np.ndarray, keys: np.ndarray, texts: W.Texts, buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """The contexts of a batch, a row for each bucket, and the stretches that are solved within the batch."""
    parts = []
    for first, piece in texts.pieces():
        found = contexts_of(W.split_words(piece), window)
        parts.append((*found[:2], found[2] + first, *found[3:]))
    anchors, whole, text, starts, counts, hashes = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(anchors):
        return
    own, key = ids[text], keys[text]
    same = W.mix(anchors + whole * _BASE)
    order = np.lexsort((own, same))
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = same[order[1:]] != same[order[:-1]]
    lowest = own[order][begins][np.cumsum(begins) - 1]
    solved = np.zeros(len(order), dtype=bool)
    solved[order] = own[order] > lowest
    codec = pa.Codec("zstd", compression_level=1)
    rows: list[tuple] = []

    def add(bucket: int, done: bool, data: bytes) -> None:
        rows.append((bucket, done, len(data), codec.compress(data, asbytes=True)))

    begin = np.cumsum(counts) - counts
    gone = np.flatnonzero(solved)
    if len(gone):
        # They need no comparison; any bucket will do, but not that of their anchor, which may be a frequent one.
        order = gone[np.lexsort((starts[gone], key[gone], own[gone]))]
        bucket = int(W.mix(np.array([same[order[0]]]))[0] % np.uint64(buckets))
        zero = np.zeros(len(order), np.uint64)
        none = np.zeros(0, np.uint64)
        data = _packed(zero, own[order], key[order], starts[order], np.zeros(len(order)), none)
        add(bucket, True, data + counts[order].astype(np.uint16).tobytes())
    open_ = np.flatnonzero(~solved)
    bucket = (anchors[open_] >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        at = open_[order[low:high]]
        times = counts[at]
        where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[at], times)
        add(int(bucket[order[low]]), False, _packed(anchors[at], own[at], key[at], starts[at], times, hashes[where]))
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _stretches(ids, keys, starts, lengths) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(keys.astype(np.int64)), pa.array(starts.astype(np.int32))]
    columns.append(pa.array((starts + lengths).astype(np.int32)))
    return pa.RecordBatch.from_arrays(columns, ["id", "key", "begin", "end"])


def _compare(parts: list[tuple[np.ndarray, ...]], window: int) -> pa.RecordBatch:
    """The stretches of a bucket whose windows a smaller id has too."""
    anchors, ids, keys, starts, counts, hashes = (np.concatenate(c) for c in zip(*parts, strict=True))
    counts = counts.astype(np.int64)
    whose = np.repeat(np.arange(len(anchors)), counts)
    # 48 bits of the window and 16 of the anchor, of which the bucket has more.
    same = hashes | anchors[whose] << np.uint64(48)
    order = np.argsort(same, kind="stable")
    ordered = same[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
    holder = ids[whose[order]]
    lowest = np.minimum.reduceat(holder, begins) if len(order) else holder
    gone = np.zeros(len(order), dtype=bool)
    gone[order] = holder > np.repeat(lowest, np.diff(np.append(begins, len(order))))
    at = np.flatnonzero(gone)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (whose[at[1:]] != whose[at[:-1]])
    first = at[new]
    last = at[np.append(new[1:], True)] if len(at) else at
    owner = whose[first]
    begin = starts[owner].astype(np.int64) + first - (np.cumsum(counts) - counts)[owner]
    return _stretches(ids[owner], keys[owner], begin, last - first + window)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def removed_stretches(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(id, key, begin, end): the words [begin, end) to remove; ``docs`` has id (long, null as the largest), text, key."""
    if buckets is None:
        shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(BUCKETS, BUCKETS_EACH * shuffled)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "text", BATCH):
            table = table.combine_chunks()
            keys = table.column("key").to_numpy()
            yield from _deal(_ids(table.column("id")), keys, texts, buckets, window)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, bucket, held = pa.Codec("zstd"), None, []
        for batch in batches:
            numbers, done = batch.column("bucket").to_pylist(), batch.column("solved").to_pylist()
            sizes = batch.column("size").to_pylist()
            for index, data in enumerate(batch.column("data")):
                raw = codec.decompress(data.as_buffer(), sizes[index], asbytes=True)
                if done[index]:
                    _, ids, keys, starts, _, _ = _unpacked(raw)
                    counts = np.frombuffer(raw, np.uint16, len(ids), len(raw) - 2 * len(ids)).astype(np.int64)
                    yield _stretches(ids, keys, starts.astype(np.int64), counts + window - 1)
                    continue
                if held and numbers[index] != bucket:
                    yield _compare(held, window)
                    held = []
                bucket = numbers[index]
                held.append(_unpacked(raw))
        if held:
            yield _compare(held, window)

    dealt = docs.mapInArrow(deal, "bucket int, solved boolean, size int, data binary")
    met = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(compare, "id long, key long, begin int, end int")


def _keep(data: bytes, spans) -> tuple[list[bytes], int, int]:
    """(words that stay, words, words that go)."""
    words = data.split()
    if not spans:
        return words, len(words), 0
    keep = np.ones(len(words), dtype=bool)
    for span in spans:
        keep[span["begin"] : span["end"]] = False
    return list(compress(words, keep)), len(words), int(len(words) - keep.sum())


def remove_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, buckets: int | None = None
) -> DataFrame:
    """Per document: doc_id, kept_text (the words that stay, joined by one space), n_words and n_removed."""
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # Rows of one id are told apart by their texts.
    plain = plain.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0xFFFFFFFF))
    stretches = removed_stretches(plain, window, buckets)
    span = F.struct("begin", "end")
    spans = stretches.groupBy("id", "key").agg(F.collect_list(span).alias("spans"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are shuffled as small as they get.
        codec = pa.Codec("zstd", compression_level=1)
        for table, _ in W.batches_of(batches, "text", BATCH):
            table = table.combine_chunks()
            raw = [(t or "").encode() for t in table.column("text").to_pylist()]
            columns = [table.column("id"), table.column("key"), pa.array(_ids(table.column("id")))]
            columns.append(pa.array([len(r) for r in raw], pa.int64()))
            columns.append(pa.array([codec.compress(r, asbytes=True) if r else b"" for r in raw], pa.binary()))
            yield from pa.table(columns, ["doc", "key", "id", "size", "data"]).to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            sizes, spans = batch.column("size").to_pylist(), batch.column("spans")
            # Texts one by one: a batch of very long ones is never decompressed as a whole.
            for begin in range(0, batch.num_rows, 256):
                rows = range(begin, min(begin + 256, batch.num_rows))
                out = []
                for index in rows:
                    data = b""
                    if sizes[index]:
                        data = codec.decompress(batch.column("data")[index].as_buffer(), sizes[index], asbytes=True)
                    kept, total, gone = _keep(data, spans[index].as_py())
                    out.append((b" ".join(kept), total, gone))
                texts, totals, goners = zip(*out, strict=True)
                columns = [batch.column("doc").slice(begin, len(rows))]
                columns += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(goners, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept_text", "n_words", "n_removed"])

    small = plain.mapInArrow(shrink, "doc long, key long, id long, size long, data binary")
    joined = small.join(spans, ["id", "key"], "left").select("doc", "size", "data", "spans")
    return joined.mapInArrow(finish, "doc_id long, kept_text string, n_words long, n_removed long")


def digest_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of the words that stay."""
    kept = remove_copies(docs, doc_id, text, **options)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: All windows written out and counted.
ORACLE_SQL = r"""WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     words AS (SELECT doc_id, w[i] AS word, i, len(w) AS n, w
               FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM cut)),
     windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM words WHERE i + 12 <= n),
     lowest AS (SELECT t, min(doc_id) AS low FROM windows GROUP BY t HAVING min(doc_id) <> max(doc_id)),
     hits AS (SELECT DISTINCT v.doc_id, v.i FROM windows v JOIN lowest l ON v.t = l.t AND l.low < v.doc_id),
     marked AS (SELECT w.doc_id, w.i, w.word, max(CASE WHEN h.i IS NULL THEN 0 ELSE 1 END)
                    OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
                FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.i = w.i),
     told AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept
              FROM marked GROUP BY doc_id)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN told t ON t.doc_id = c.doc_id
"""
