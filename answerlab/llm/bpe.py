"""Byte-pair encoding and decoding by merge rank, for vocabularies with word-end symbols.

A word is merged by a priority queue of (rank, position) over a doubly linked list of its symbols;
queue entries whose symbols have changed meanwhile are skipped. Decoding concatenates vocabulary
strings. Normalisation and splitting follow the vocabulary file: NFC, white space to blanks,
lower case letter by letter, then contractions, letter runs, single numbers and runs of the rest.
No such part crosses a blank, so distinct blank-separated strings are encoded once per task.

What a character is composed to, its lower case and its class depend on the Unicode version, which the library, Python and
its pattern library each have their own of. So all but Latin-1 is normalised with the library's tables, and strings with
characters younger than Unicode 3.2 are split with them.

Defined results: a null or empty text has no tokens and decodes to the empty text; special tokens
written out in a text count as those tokens; equal texts have equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from answerlab.llm import words as W
from answerlab.llm.columns import renamed

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_category = unicodedata.ucd_3_2_0.category
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value of the vocabulary file


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {byte: chr(byte) for byte in plain}
    for place, byte in enumerate(sorted(set(range(256)) - set(plain))):
        letters[byte] = chr(256 + place)
    return letters


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge neighbouring symbols, lowest rank first and leftmost among equals, until none has a rank.

    ``ranks`` has the rank of a pair under left << 32 | right; ``made`` has the symbol of each rank.
    """
    count = len(symbols)
    symbols = list(symbols)
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    rank_of = ranks.get
    # The rank of each symbol with the one after it; a queue entry that differs from it is stale.
    now = [rank_of(left << 32 | right, -1) for left, right in zip(symbols, symbols[1:])]
    now.append(-1)
    queue = [rank << 32 | place for place, rank in enumerate(now) if rank >= 0]
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        place, rank = entry & 0xFFFFFFFF, entry >> 32
        if now[place] != rank:
            continue
        other = after[place]
        symbols[place] = joined = made[rank]
        symbols[other] = now[other] = now[place] = -1
        follower = after[place] = after[other]
        if follower < count:
            before[follower] = place
            rank = now[place] = rank_of(joined << 32 | symbols[follower], -1)
            if rank >= 0:
                heapq.heappush(queue, rank << 32 | place)
        leader = before[place]
        if leader >= 0:
            rank = now[leader] = rank_of(symbols[leader] << 32 | joined, -1)
            if rank >= 0:
                heapq.heappush(queue, rank << 32 | leader)
    return [symbol for symbol in symbols if symbol >= 0]


class Bpe:
    """A vocabulary file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        letters = byte_letters()
        if any(letter + end not in ids for letter in letters.values() for end in ("", suffix)):
            raise ValueError("the vocabulary lacks a byte")
        self.inner = [ids[letters[byte]] for byte in range(256)]
        self.final = [ids[letters[byte] + suffix] for byte in range(256)]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left] << 32 | ids[right]] = len(self.made)
            self.made.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        rows = [self.strings.get(i, "") for i in range(max(self.strings) + 1)]
        self.decoded = W.Ragged.of([f"{s} ".encode() for s in rows], np.uint8)
        self.shown = W.Ragged.of([f"{i} ".encode() for i in range(len(rows))], np.uint8)
        # Unicode white space, as the splitting pattern of the file means it; other engines differ in \\s.
        blank = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.parts = regex.compile(_PARTS.replace(r"\s", blank))
        self.normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.split = pre_tokenizers.Split(Regex(_PARTS), "removed", invert=True).pre_tokenize_str
        named = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.named = regex.compile(f"({named})") if named else None
        self.known: dict[str, list[int]] = {}

    def encode_part(self, part: str) -> list[int]:
        found = self.known.get(part)
        if found is None:
            data = part.encode("utf-8")
            symbols = [self.inner[byte] for byte in data]
            symbols[-1] = self.final[data[-1]]
            found = merge(symbols, self.ranks, self.made)
            if len(self.known) >= 250_000:
                self.known.clear()
            self.known[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        out: list[int] = []
        for i, stretch in enumerate(self.named.split(text) if self.named else [text]):
            if i % 2:
                out.append(self.special[stretch])
                continue
            for part in self.parts_of(stretch):
                out += self.encode_part(part)
        return out

    def parts_of(self, text: str) -> list[str]:
        """The normalised parts that are merged each by itself."""
        if text.isascii() or max(text) < "\u0100":
            return self.parts.findall(text.lower())
        lower = self.normalise(text)
        if any(_category(letter) == "Cn" for letter in lower):
            return [part for part, _ in self.split(lower)]
        return self.parts.findall(lower)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, put together with blanks as the library does without a decoder."""
        return " ".join(self.strings[i] for i in ids)


#: Bytes of text encoded together, and of the memo of words.
BATCH = 2 << 20
MEMO = 32 << 20


def _bpe(path: str) -> tuple[Bpe, W.Memo]:
    def make():
        bpe = Bpe(path)
        encode = lambda strings: [bpe.encode(s.decode("utf-8", "replace")) for s in strings]
        return bpe, W.Memo(encode, np.uint32, most_bytes=MEMO)

    return W.only(("bpe", path), make)


def encode_texts(texts: W.Texts, path: str) -> W.Ragged:
    """Token ids of every text."""
    bpe, memo = _bpe(path)
    words = W.split_words(texts)
    distinct, number = memo.look_up(texts.data, words.starts, words.ends, words.hashes)
    tokens = distinct.take(number)
    return W.Ragged(tokens.values, tokens.offsets[words.first])


def encode_documents(
    docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """The columns ``keep`` and the array ``ids`` of every document; one pass without a shuffle."""
    return _mapped(docs, path, ["doc_id"] if keep is None else keep, text, f"{ids} array<int>", _ids)


def digest_documents(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` and RESULT: tokens, digest of the ids, digest of the decoded text."""
    return _mapped(docs, path, ["doc_id"] if keep is None else keep, text, RESULT, _digests)


def _mapped(docs: DataFrame, path: str, keep: list[str], text: str, result: str, make) -> DataFrame:
    names = [part.split()[0] for part in result.split(", ")]
    clash = set(keep) & set(names)
    if clash:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    safe, named = renamed(docs)
    own = [named[c] for c in keep]
    read = safe.select(*own, safe[named[text]].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "text", BATCH):
            columns = [table.column(c) for c in own] + make(encode_texts(texts, path), path)
            yield from pa.table(columns, names=own + names).to_batches()

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.select(*own).schema)
    return read.mapInArrow(run, f"{kept}, {result}" if kept else result).toDF(*keep, *names)


def _ids(tokens: W.Ragged, path: str) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(tokens.offsets.astype(np.int32), tokens.values.astype(np.int32))]


def _digests(tokens: W.Ragged, path: str) -> list[pa.Array]:
    bpe = _bpe(path)[0]
    columns = [pa.array(tokens.lengths)]
    for table in (bpe.shown, bpe.decoded):
        rows = table.take(tokens.values)
        data, edges = memoryview(rows.values), rows.offsets[tokens.offsets].tolist()
        # Every row ends with a blank; the last one of a text does not belong to it.
        columns.append(
            pa.array(
                hashlib.sha256(data[begin : max(begin, end - 1)]).hexdigest()
                for begin, end in zip(edges[:-1], edges[1:], strict=True)
            )
        )
    return columns
