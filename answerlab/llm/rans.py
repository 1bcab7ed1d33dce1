"""Token ids as files: a static range asymmetric numeral system over interleaved blocks.

File format: a Parquet folder with one row per segment. A segment holds the ids of consecutive
documents and one frequency table (``symbols`` and ``freqs``, little-endian unsigned 32-bit; the
frequencies sum to 2**SCALE) that all its blocks share. A block codes up to BLOCK ids in LANES
interleaved lanes: id i belongs to lane i % LANES and step i // LANES. Each block is decoded on its
own; its ``marks`` are checkpoints (step, word of the payload, the lanes' 64-bit states), the first at
step 0, so stretches between them are decoded side by side. ``crc32`` is that of the block's ids as
little-endian unsigned 32-bit integers and is checked on reading.

Rows are in ascending document id; null ids come first, and rows of equal id keep the order of their
ids. A null or empty text holds its end id only. Every task works on one segment at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from answerlab.llm import words as W

LANES, STEPS, MARK = 64, 1024, 256
BLOCK = LANES * STEPS
SCALE = 18
SEGMENT = 2_000_000
#: Ids below this have their row of the frequency table looked up; larger ones are searched for.
TABLE = 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(SCALE)
_SLOT = np.uint64((1 << SCALE) - 1)

SEGMENT_SCHEMA = (
    "part int, segment int, part_offset long, n_ids long, doc_ids array<bigint>, lengths array<int>, "
    "symbols binary, freqs binary, blocks array<struct<start: int, n: int, crc32: bigint, payload: binary, "
    "marks: array<struct<step: int, word: int, states: binary>>>>"
)
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("part_offset", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("symbols", pa.binary()),
        ("freqs", pa.binary()),
        (
            "blocks",
            pa.list_(
                pa.struct(
                    [
                        ("start", pa.int32()),
                        ("n", pa.int32()),
                        ("crc32", pa.int64()),
                        ("payload", pa.binary()),
                        ("marks", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int32()), ("states", pa.binary())]))),
                    ]
                )
            ),
        ),
    ]
)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies that sum to 2**SCALE, each at least 1) of some ids."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE
    if len(symbols) > total // 2:
        raise ValueError("too many different ids for the scale")
    # Every symbol keeps one slot; the others are dealt in proportion, the remainder to the commonest.
    spare = total - len(symbols)
    freqs = 1 + (counts * spare) // counts.sum()
    freqs[np.argmax(counts)] += total - freqs.sum()
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def encode_blocks(places: np.ndarray, freqs: np.ndarray) -> list[tuple[bytes, list[dict]]]:
    """(payload, marks) of blocks of the same shape; ``places`` (block, step, lane) are rows of the table."""
    blocks, steps, lanes = places.shape
    wide = freqs.astype(np.uint64)
    below = np.concatenate([[0], np.cumsum(wide[:-1])]).astype(np.uint64)
    states = np.full((blocks, lanes), _LOW, dtype=np.uint64)
    out = np.zeros((blocks, steps, lanes), dtype=np.uint32)
    sent = np.zeros((blocks, steps, lanes), dtype=bool)
    kept: dict[int, np.ndarray] = {}
    room = np.uint64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        place = places[:, step]
        freq = wide[place]
        full = states >= (freq << room)
        out[:, step] = states & np.uint64(0xFFFFFFFF)
        sent[:, step] = full
        states = np.where(full, states >> _WORD, states)
        whole = states // freq
        states = (whole << _BITS) + (states - whole * freq) + below[place]
        if step % MARK == 0:
            kept[step] = states
    words = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(sent.sum(axis=2), axis=1)], axis=1)
    return [
        (
            out[b][sent[b]].astype("<u4").tobytes(),
            [
                {"step": step, "word": int(words[b, step]), "states": kept[step][b].astype("<u8").tobytes()}
                for step in sorted(kept)
            ],
        )
        for b in range(blocks)
    ]


def encode_segment(ids: np.ndarray) -> dict:
    """Table and blocks of the ids of a segment."""
    symbols, freqs = frequencies(ids)
    if symbols[-1] < TABLE:
        place_of = np.zeros(int(symbols[-1]) + 1, np.int64)
        place_of[symbols] = np.arange(len(symbols))
        places = place_of[ids]
    else:
        places = np.searchsorted(symbols, ids)
    whole = len(ids) // BLOCK * BLOCK
    groups = [places[:whole].reshape(-1, STEPS, LANES)] if whole else []
    if whole < len(ids):
        rest = places[whole:]
        # The last step is filled up with the commonest symbol; ``n`` tells how many ids count.
        padded = np.full(-(-len(rest) // LANES) * LANES, np.argmax(freqs))
        padded[: len(rest)] = rest
        groups.append(padded.reshape(1, -1, LANES))
    blocks, start = [], 0
    for group in groups:
        for payload, marks in encode_blocks(group, freqs):
            own = ids[start : start + BLOCK]
            crc = zlib.crc32(own.astype("<u4").tobytes())
            blocks.append({"start": start, "n": len(own), "crc32": crc, "payload": payload, "marks": marks})
            start += len(own)
    return {"symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "blocks": blocks}


def decode_segment(symbols: bytes, freqs: bytes, blocks: list[dict], n_ids: int) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block does not match its checksum."""
    names, wide = np.frombuffer(symbols, "<u4"), np.frombuffer(freqs, "<u4").astype(np.uint64)
    below = np.concatenate([[0], np.cumsum(wide[:-1])]).astype(np.uint64)
    at_slot = np.repeat(np.arange(len(names), dtype=np.int32), wide.astype(np.int64))
    stretches = []  # (steps, first word, states, first id)
    streams, base = [], 0
    for block in blocks:
        steps = -(-block["n"] // LANES)
        ends = [mark["step"] for mark in block["marks"][1:]] + [steps]
        for mark, end in zip(block["marks"], ends, strict=True):
            states = np.frombuffer(mark["states"], "<u8")
            stretches.append((end - mark["step"], base + mark["word"], states, block["start"] + mark["step"] * LANES))
        streams.append(np.frombuffer(block["payload"], "<u4"))
        base += len(streams[-1])
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    stretches.sort(key=lambda s: -s[0])
    lengths = np.array([s[0] for s in stretches])
    word = np.array([s[1] for s in stretches], dtype=np.int64)
    first = np.array([s[3] for s in stretches], dtype=np.int64)
    states = np.stack([s[2] for s in stretches])
    ids = np.zeros(n_ids + LANES, dtype=np.uint32)
    lane = np.arange(LANES)
    for step in range(lengths[0]):
        active = int(np.searchsorted(-lengths, -step, "left"))
        state = states[:active]
        slot = state & _SLOT
        place = at_slot[slot]
        ids[first[:active, None] + step * LANES + lane] = names[place]
        state = wide[place] * (state >> _BITS) + slot - below[place]
        short = state < _LOW
        ranks = np.cumsum(short, axis=1)
        refill = stream[word[:active, None] + np.maximum(ranks - 1, 0)]
        states[:active] = np.where(short, state << _WORD | refill, state)
        word[:active] += ranks[:, -1]
    ids = ids[:n_ids]
    for block in blocks:
        own = ids[block["start"] : block["start"] + block["n"]]
        if zlib.crc32(own.astype("<u4").tobytes()) != block["crc32"]:
            raise ValueError(f"checksum of the block at {block['start']} does not match")
    return ids


class ByteBpe:
    """Encodes texts with the tokenizers library, each distinct blank-and-word unit once.

    The splitting pattern of byte-level vocabularies joins nothing across the end of a word, so a text's
    ids are those of its units. Texts with other Unicode blanks or with special tokens written out are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        odd = [rb"[\x1c-\x1f]", rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]"]
        odd += [rb"\xe2\x81\x9f", rb"\xe3\x80\x80", *[re.escape(s.encode()) for s in special]]
        self.odd = re.compile(b"|".join(odd))
        # The pairs of bytes that the pattern can begin with: it is tried only there.
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.begins[0x1C << 8 : 0x20 << 8] = True
        self.begins[[0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]] = True
        for name in filter(None, (s.encode() for s in special)):
            self.begins[name[0] << 8 : (name[0] + 1) << 8] |= np.arange(256) == name[1] if len(name) > 1 else True
        self.memo = W.Memo(self._encode, np.uint32)

    def _encode(self, strings: list[bytes]) -> list[list[int]]:
        texts = [s.decode("utf-8", "replace") for s in strings]
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def odd_places(self, data: np.ndarray) -> list[int]:
        """Where ``odd`` matches."""
        pairs = data.astype(np.uint16) << 8
        pairs[:-1] |= data[1:]
        held = data.tobytes()
        return [place for place in np.flatnonzero(self.begins[pairs]).tolist() if self.odd.match(held, place)]

    def encode(self, texts: W.Texts) -> W.Ragged:
        starts, ends, hashes, first = W.split_units(texts)
        distinct, number = self.memo.look_up(texts.data, starts, ends, hashes)
        tokens = distinct.take(number)
        rows = W.Ragged(tokens.values, tokens.offsets[first])
        places = self.odd_places(texts.data)
        if places:
            odd = np.unique(np.searchsorted(texts.offsets, places, "right") - 1)
            strings = [texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes() for i in odd]
            index = np.arange(len(texts))
            index[odd] = len(texts) + np.arange(len(odd))
            rows = rows.append(W.Ragged.of(self._encode(strings), np.uint32)).take(index)
        return rows


_loaded: dict[str, ByteBpe] = {}


def _byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_rows(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of all documents in ascending id. One shuffle, by ranges of ids."""
    ordered = (
        docs.select(docs[doc_id].cast("bigint").alias("_id"), docs[text].alias("_text"))
        .repartitionByRange("_id")
        .sortWithinPartitions("_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        segment = offset = 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            lengths = np.concatenate([h[1] for h in held])
            row = {
                "part": part,
                "segment": segment,
                "part_offset": offset,
                "n_ids": size,
                "doc_ids": [i for h in held for i in h[0]],
                "lengths": lengths.tolist(),
            }
            row |= encode_segment(np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for table, texts in W.batches_of(batches, "_text", W.BATCH // 2):
            tokens = _byte_bpe(vocabulary).encode(texts)
            lengths = tokens.lengths
            ids = np.insert(tokens.values, tokens.offsets[1:], end_id)
            held.append((table.column("_id").to_pylist(), lengths + 1, ids))
            size += len(ids)
            if size >= SEGMENT:
                yield close()
                segment, offset, size, held = segment + 1, offset + size, 0, []
        if size:
            yield close()

    return ordered.mapInArrow(run, SEGMENT_SCHEMA)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, **columns) -> None:
    """Write the ids of all documents as a new folder in the format described above."""
    encode_rows(docs, vocabulary, end_id, **columns).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for.

    Segments are decoded in parallel. ``start`` counts the ids of all documents before; it needs the
    ids per part only, one row for each range of the writing job.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.num_rows and (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)) or ():
                ids = decode_segment(row["symbols"], row["freqs"], row["blocks"], row["n_ids"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "part": pa.array(np.full(len(ends), row["part"], np.int32)),
                    "_at": pa.array(ends - lengths + row["part_offset"]),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                }
                if with_ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(offsets, ids.astype(np.int32))
                yield from pa.table(columns).to_batches()

    schema = "doc_id long, part int, _at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = segments.mapInArrow(run, schema).join(F.broadcast(bases), "part")
    names = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return rows.select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), *names)
