"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that starts anywhere else too.

Strings never cross documents, may overlap, and are judged on the input. The result is exact.

Not every suffix is sorted. The GRAM-byte string of lowest hash in a window of LENGTH bytes (the leftmost
one among equals) is the window's anchor; equal windows have equal anchors at equal places, and neighbouring
windows mostly share theirs. A *context* is the stretch of text that the windows of one anchor cover.

1. All texts are read; each gives its contexts as (hash of the anchor, hash of the context).
2. Anchors that occur once cover nothing repeated. Contexts that occur twice are repeated as a whole.
3. The different contexts of an anchor are range-partitioned by their leading bytes from the anchor on, at
   splitters that Spark samples, so an anchor's contexts meet in one bucket. There all window suffixes are
   sorted by multikey quicksort, eight bytes at a time: groups of equal beginnings are split by their next
   eight bytes, and suffixes that are alone drop out; neighbours that are equal to the end are repeated.
4. An anchor with more than HOT different contexts is not gathered in a bucket: its windows are dealt by a
   128-bit fingerprint, so equal windows meet across what would be bucket boundaries.
5. The repeated windows of a document come together and its bytes are cut.

Copies are reduced by partial aggregation before every shuffle, so a text that a third of all documents
share is a few rows. Defined results: null is the empty text; texts below LENGTH bytes lose nothing; repeated
rows are copies of each other and lose everything if long enough; equal ids with other texts are other
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from answerlab.llm import words as W
from answerlab.llm.columns import renamed
from answerlab.session import materialise

LENGTH = 200
GRAM = 32
HOT = 20_000
CHUNK_WINDOWS = 400_000
_SECOND_BASE = 0xC6BC279692B5CC83
_SECOND_INVERSE = pow(_SECOND_BASE, -1, 1 << 64)


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for every i that leaves room."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def contexts_of(texts: W.Texts) -> tuple[np.ndarray, ...]:
    """(text, start in it, windows, hash of the anchor, hash of the context) of all contexts."""
    data, size = texts.data, len(texts.data)
    none = np.zeros(0, np.int64)
    if size < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = W.prefix_hashes(data)
    places = np.arange(size - GRAM + 1)
    grams = W.span_hashes(sums, places, places + GRAM)
    bits = np.uint64(int(size).bit_length())
    ranked = (grams >> bits << bits) | places.astype(np.uint64)
    anchors = (sliding_minima(ranked, LENGTH - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows that begin in a text and end in it.
    rooms = np.maximum(np.diff(texts.offsets) - LENGTH + 1, 0)
    edges = np.zeros(len(anchors) + 1, np.int8)
    some = rooms > 0
    edges[texts.offsets[:-1][some]] += 1
    edges[(texts.offsets[:-1] + rooms)[some]] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    begins[texts.offsets[:-1][some]] = True
    ends = np.zeros(len(inside), dtype=bool)
    ends[:-1] = begins[1:] | ~inside[1:]
    ends[-1] = True
    ends &= inside
    starts, lasts = np.flatnonzero(begins), np.flatnonzero(ends)
    owners = np.searchsorted(texts.offsets, starts, "right") - 1
    at = anchors[starts]
    # The anchor's place belongs to a context: the same bytes around another anchor are other windows.
    whole = W.mix(W.span_hashes(sums, starts, lasts + LENGTH) + (at - starts).astype(np.uint64))
    return owners, starts - texts.offsets[owners], lasts - starts + 1, grams[at], whole


def sort_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which windows of LENGTH bytes equal another one of their group, by multikey quicksort.

    ``groups`` numbers the windows that may be equal at all. A character is eight bytes.
    """
    repeated = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return repeated
    # Eight bytes from every place on, the first one most significant.
    wide = np.zeros(max(0, len(data) - 7), dtype=np.uint64)
    for byte in range(8):
        wide = wide << np.uint64(8) | data[byte : byte + len(wide)]
    alive = np.argsort(groups, kind="stable")
    alive, group = _not_alone(alive, groups[alive], groups[alive])
    for depth in range(0, LENGTH, 8):
        if not len(alive):
            return repeated
        character = wide[starts[alive] + min(depth, LENGTH - 8)]
        differs = np.flatnonzero(character[1:] != character[:-1])
        # Only groups whose characters differ need sorting.
        inner = differs[group[differs] == group[differs + 1]]
        if len(inner):
            torn = np.zeros(int(group[-1]) + 1, dtype=bool)
            torn[group[inner]] = True
            where = np.flatnonzero(torn[group])
            order = np.lexsort((character[where], group[where]))
            alive[where], character[where] = alive[where][order], character[where][order]
            alive, group = _not_alone(alive, group, character)
    repeated[alive] = True
    return repeated


def _not_alone(alive: np.ndarray, group: np.ndarray, character: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes without those whose (group, character) is alone, and the new groups' numbers."""
    new = np.ones(len(alive), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (character[1:] != character[:-1])
    last = np.append(new[1:], True)
    keep = ~(new & last)
    return alive[keep], (np.cumsum(new) - 1)[keep]


def _pieces(docs: DataFrame) -> DataFrame:
    """(id, key, gram, ctx, start, windows) of every context of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "text", W.PIECE):
            owners, starts, windows, grams, whole = contexts_of(texts)
            if len(owners):
                columns = [
                    table.column("id").take(pa.array(owners)),
                    table.column("key").take(pa.array(owners)),
                    pa.array(grams.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(starts),
                    pa.array(windows.astype(np.int32)),
                ]
                names = ["id", "key", "gram", "ctx", "start", "windows"]
                yield from pa.table(columns, names=names).to_batches()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key long, gram long, ctx long, start long, windows int")


def _cut(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of contexts: (gram, ctx, copies, hot, lead, anchor, bytes), lead being the bytes at the anchor."""
    per_text = wanted.groupBy("id", "key").agg(
        F.collect_list(F.struct("gram", "ctx", "start", "windows", "copies", "hot")).alias("wanted")
    )
    texts = docs.alias("d").join(
        per_text.alias("w"), F.col("d.key").eqNullSafe(F.col("w.key")) & F.col("d.id").eqNullSafe(F.col("w.id"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in range(batch.num_rows):
                row = batch.slice(index, 1).to_pylist()[0]
                texts = W.texts_of(pa.array([row["text"]]))
                data = texts.data
                held = []
                for part in row["wanted"]:
                    own = data[part["start"] : part["start"] + part["windows"] + LENGTH - 1]
                    anchor = _anchor(own, part["windows"])
                    held.append(
                        {
                            **{name: part[name] for name in ("gram", "ctx", "copies", "hot")},
                            "lead": own[anchor : anchor + GRAM].tobytes(),
                            "anchor": anchor,
                            "bytes": own.tobytes(),
                        }
                    )
                yield pa.RecordBatch.from_pylist(held, schema=_CUT)

    return texts.select("d.text", "wanted").mapInArrow(
        run, "gram long, ctx long, copies long, hot boolean, lead binary, anchor int, bytes binary"
    )


_CUT = pa.schema(
    [
        ("gram", pa.int64()),
        ("ctx", pa.int64()),
        ("copies", pa.int64()),
        ("hot", pa.bool_()),
        ("lead", pa.binary()),
        ("anchor", pa.int32()),
        ("bytes", pa.binary()),
    ]
)


def _anchor(context: np.ndarray, windows: int) -> int:
    """Where the anchor of a context's first window is."""
    sums = W.prefix_hashes(context)
    places = np.arange(LENGTH - GRAM + 1)
    return int(np.argmin(W.span_hashes(sums, places, places + GRAM)))


def _compare(cut: DataFrame) -> DataFrame:
    """(gram, ctx, spans) of the contexts of cold anchors: which of their windows are repeated."""
    ordered = cut.repartitionByRange("lead").sortWithinPartitions("lead", "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("bytes")).to_numpy() - LENGTH + 1
            grams = batch.column("gram").to_numpy()
            begin = 0
            # Buckets end between anchors once they hold enough windows.
            for edge in [*(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)]:
                if held and windows >= CHUNK_WINDOWS and held[-1].column("gram")[-1].as_py() != grams[begin]:
                    yield from _bucket(pa.Table.from_batches(held))
                    held, windows = [], 0
                held.append(batch.slice(begin, edge - begin))
                windows += int(sizes[begin:edge].sum())
                begin = edge
        if held:
            yield from _bucket(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "gram long, ctx long, spans array<struct<first: int, last: int>>")


def _bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
    column = table.column("bytes").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    texts = W.texts_of(column.cast(pa.large_binary()).view(pa.large_string()))
    grams, anchors = table.column("gram").to_numpy(), table.column("anchor").to_numpy()
    counts = np.maximum(np.diff(texts.offsets) - LENGTH + 1, 0)
    owners = np.repeat(np.arange(len(texts)), counts)
    places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Equal windows have equal anchors at equal places.
    number = np.unique(grams, return_inverse=True)[1]
    groups = number[owners] * (LENGTH + GRAM) + (anchors[owners] - places)
    repeated = sort_windows(texts.data, texts.offsets[:-1][owners] + places, groups)
    # Contexts that several rows share are repeated as a whole.
    repeated |= (table.column("copies").to_numpy() > 1)[owners]
    yield from _spans(table, owners, places, repeated)


def _spans(table: pa.Table, owners: np.ndarray, places: np.ndarray, repeated: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(repeated)
    if not len(at):
        return
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owners[at[1:]] != owners[at[:-1]])
    firsts, lasts = at[new], at[np.append(new[1:], True)]
    whose, offsets = np.unique(owners[firsts], return_index=True)
    offsets = np.append(offsets, len(firsts)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(places[firsts].astype(np.int32)), pa.array(places[lasts].astype(np.int32))], ["first", "last"]
    )
    part = table.select(["gram", "ctx"]).take(pa.array(whose))
    part = part.append_column("spans", pa.ListArray.from_arrays(offsets, spans))
    yield from part.to_batches()


def _by_fingerprint(cut: DataFrame) -> DataFrame:
    """The same for hot anchors: their windows one by one, counted by fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                table = batch.slice(part, 256)
                texts = W.texts_of(table.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
                counts = np.maximum(np.diff(texts.offsets) - LENGTH + 1, 0)
                owners = np.repeat(np.arange(len(texts)), counts)
                places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = texts.offsets[:-1][owners] + places
                sums = np.zeros(len(texts.data) + 1, np.uint64)
                np.cumsum((texts.data.astype(np.uint64) + np.uint64(1)) * W.powers(_SECOND_BASE, len(texts.data)), out=sums[1:])
                second = (sums[starts + LENGTH] - sums[starts]) * W.powers(_SECOND_INVERSE, len(sums))[starts]
                first = W.span_hashes(W.prefix_hashes(texts.data), starts, starts + LENGTH)
                columns = [table.column(n).take(pa.array(owners)) for n in ("gram", "ctx", "copies")]
                columns += [pa.array(places.astype(np.int32)), pa.array(first.view(np.int64)), pa.array(W.mix(second).view(np.int64))]
                names = ["gram", "ctx", "copies", "place", "f1", "f2"]
                yield from pa.table(columns, names=names).to_batches()

    windows = cut.mapInArrow(run, "gram long, ctx long, copies long, place int, f1 long, f2 long")
    twice = windows.groupBy("f1", "f2").agg(F.sum("copies").alias("n")).where("n > 1").select("f1", "f2")
    found = windows.join(twice, ["f1", "f2"]).groupBy("gram", "ctx")
    spans = F.transform(F.array_sort(F.collect_set("place")), lambda p: F.struct(p.alias("first"), p.alias("last")))
    return found.agg(spans.alias("spans"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, key, spans): byte ranges [begin, end) that repeated strings cover; ``docs`` has id, text and key."""
    pieces = _pieces(docs)
    grams = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    # Written, so that the join below is between two shuffles, of which Spark splits the frequent anchors.
    grams = materialise(grams.where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")))
    shared = materialise(pieces.join(grams, "gram"))
    # Anchors with a single context: all of it is repeated.
    whole = shared.where(~F.col("mixed")).select(
        "id", "key", F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + LENGTH).alias("end")
    )
    mixed = shared.where("mixed")
    example = F.min(F.struct("id", "key", "start", "windows")).alias("e")
    distinct = materialise(mixed.groupBy("gram", "ctx").agg(example, F.count(F.lit(1)).alias("copies")))
    frequent = materialise(distinct.groupBy("gram").count().where(F.col("count") > hot).select("gram"))
    flagged = distinct.join(frequent.withColumn("hot", F.lit(True)), "gram", "left")
    wanted = flagged.select("gram", "ctx", "copies", F.coalesce("hot", F.lit(False)).alias("hot"), "e.*")
    cut = materialise(_cut(wanted, docs))
    marks = _compare(cut.where(~F.col("hot")))
    if not cut.where("hot").limit(1).isEmpty():
        marks = marks.unionByName(_by_fingerprint(cut.where("hot")))
    found = mixed.join(marks, ["gram", "ctx"]).select("id", "key", "start", F.inline("spans"))
    found = found.select(
        "id",
        "key",
        (F.col("start") + F.col("first")).alias("begin"),
        (F.col("start") + F.col("last") + LENGTH).alias("end"),
    )
    spans = F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")
    return whole.unionByName(found).groupBy("id", "key").agg(spans)


def _joined(docs: DataFrame, doc_id: str, text: str, hot: int) -> DataFrame:
    """All columns of the documents under safe names, and the spans of their rows."""
    keyed = docs.withColumns({"_text": F.coalesce(F.col(text).cast("string"), F.lit("")), "_id": F.col(doc_id)})
    keyed = keyed.withColumn("_key", F.xxhash64("_text"))
    plain = keyed.select(F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_key").alias("key"))
    spans = repeated_spans(plain, hot).select(F.col("id").alias("_sid"), F.col("key").alias("_skey"), F.col("spans").alias("_spans"))
    return keyed.join(
        spans, keyed["_id"].eqNullSafe(spans["_sid"]) & (keyed["_key"] == spans["_skey"]), "left"
    ).drop("_sid", "_skey", "_id", "_key")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the spans, which are sorted by their beginnings."""
    runs: list[list[int]] = []
    for span in spans or ():
        if runs and span["begin"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], span["end"])
        else:
            runs.append([span["begin"], span["end"]])
    return [(begin, end) for begin, end in runs]


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for begin, end in runs:
        parts.append(data[at:begin])
        at = end
    return b"".join([*parts, data[at:]])


def digest_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    joined = _joined(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests = [], [], [], []
            for value, spans in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                data, runs = value.as_py().encode(), merged(spans.as_py())
                sizes.append(len(data))
                removed.append(sum(end - begin for begin, end in runs))
                counts.append(len(runs))
                digests.append(hashlib.sha256(_kept(data, runs)).hexdigest())
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "_text", "_spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their ends, so that what stays is valid UTF-8."""
    out = []
    for begin, end in runs:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, hot: int = HOT) -> DataFrame:
    """The documents without their repeated strings (whole characters), with the columns they had.

    ``n_chars`` names a column that holds the length of the text in characters, to be renewed.
    """
    safe, named = renamed(docs)
    text, n_chars = named[text], None if n_chars is None else named[n_chars]
    joined = _joined(safe, named[doc_id], text, hot)
    names = safe.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            for index, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans:
                    data = texts[index].encode()
                    texts[index] = _kept(data, whole_characters(data, merged(spans))).decode()
            columns = [batch.column(name) for name in names]
            columns[names.index(text)] = pa.array(texts, columns[names.index(text)].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in safe.schema)
    cleaned = joined.select(*names, "_spans").mapInArrow(run, kinds)
    if n_chars is not None:
        changed = F.when(F.col(text).isNotNull(), F.length(text).cast(safe.schema[n_chars].dataType)).otherwise(F.col(n_chars))
        cleaned = cleaned.withColumn(n_chars, changed)
    return cleaned.toDF(*docs.columns)
