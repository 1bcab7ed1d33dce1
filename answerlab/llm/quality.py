"""Quality rules from tokeniser fertility.

Every text is measured once: its words, symbols, repeated lines and repeated passages, and what
a public vocabulary makes of its words: characters per token, the share of tokens that are single
bytes for lack of a piece (byte fallback), and the entropy of the tokens. A text is rejected by the
base rules, or when a measure lies outside the band of its language. Bands are learned from labelled
documents (``learn_bands``); BANDS are for tables without labels.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null or
unknown language takes the default band; equal rows get equal results; other columns are not read
unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerlab.llm import words as W
from answerlab.llm.columns import renamed
from answerlab.session import arrow_batches, materialise

WINDOW = 8
#: Bytes of text measured together, and of the memo of words: a worker takes some 100 MB besides its vocabulary.
BATCH = 2 << 20
MEMO = 32 << 20
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, fallback_share double, token_entropy double, base_failed boolean, kept boolean"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER_START = np.ones(256, dtype=bool)
_LETTER_START[0x80:0xC0] = False


@dataclass(frozen=True)
class Band:
    """What a language's texts may measure; the ends belong to the band.

    Entropy follows length, so ``min_spread`` bounds the entropy over its largest possible value for
    so many tokens, log2(min(n_tokens, vocabulary)).
    """

    min_chars: float
    max_chars: float
    max_fallback: float
    min_spread: float

    def holds(self, per_token, fallback, entropy, n_tokens, pieces) -> np.ndarray:
        possible = np.log2(np.maximum(np.minimum(n_tokens, pieces), 2))
        inside = (per_token >= self.min_chars) & (per_token <= self.max_chars)
        return inside & (fallback <= self.max_fallback) & (entropy >= self.min_spread * possible)


@dataclass(frozen=True)
class LearnedBand:
    """What a language's texts may measure for their length.

    A mean over n tokens scatters by 1 / sqrt(n). So the distance from the language's characters per token, and
    from its entropy at that length, is multiplied by sqrt(n) before it is held against the limits: short texts
    have wider bands. ``lengths`` (log2 of tokens, rising) and ``entropies`` are the corners of the entropy's
    curve; below the first it falls by a bit for each halving, above the last it is level.
    """

    chars: float
    min_chars: float
    max_chars: float
    max_fallback: float
    lengths: tuple[float, ...]
    entropies: tuple[float, ...]
    min_entropy: float

    def distances(self, per_token, entropy, n_tokens) -> tuple[np.ndarray, np.ndarray]:
        root = np.sqrt(np.maximum(n_tokens, 1))
        length = np.log2(np.maximum(n_tokens, 1))
        usual = np.interp(length, self.lengths, self.entropies) + np.minimum(length - self.lengths[0], 0)
        return (per_token - self.chars) * root, (entropy - usual) * root

    def holds(self, per_token, fallback, entropy, n_tokens, pieces) -> np.ndarray:
        chars, spread = self.distances(per_token, entropy, n_tokens)
        inside = (chars >= self.min_chars) & (chars <= self.max_chars)
        return inside & (fallback <= self.max_fallback) & (spread >= self.min_entropy)


#: Share of good texts beyond each end of a learned band, and the fewest good texts to learn a language from.
TAIL = 0.002
LEAST = 50
#: Fewest texts for a corner of the entropy's curve. The share of byte tokens that is never held against a text.
CORNER = 8
FREE_FALLBACK = 0.05
#: Without labels an end lies so many times as far from the middle as a sixth of the texts do.
FAR = 3.5

#: Lower ends near the 0.3 % point of texts labelled good, so prose of any topic stays inside; texts of
#: symbols or of a foreign language fall below. Upper ends and spreads are far from all prose.
BANDS = {
    "en": Band(1.95, 6.5, 0.05, 0.40),
    "de": Band(2.04, 6.5, 0.05, 0.40),
    "fr": Band(1.72, 6.5, 0.05, 0.40),
    "es": Band(1.78, 6.5, 0.05, 0.40),
}
DEFAULT_BAND = Band(1.1, 7.0, 0.30, 0.35)

def _vocabulary(path: str):
    """(memo of piece numbers per word, which pieces are single bytes) in this worker."""

    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        single = np.array([model.is_byte(i) for i in range(model.vocab_size())])

        def encode(strings: list[bytes]) -> list[list[int]]:
            return model.encode([s.decode("utf-8", "replace") for s in strings], num_threads=1)

        return W.Memo(encode, np.uint16 if len(single) <= 1 << 16 else np.uint32, most_bytes=MEMO), single

    return W.only(("quality", path), make)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[place] == keys


def _in_text(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    return W.mix(hashes + (owners.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def repeat_words(words: W.Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows of ``window`` words that its text holds twice or more."""
    owners = words.owners
    inside = np.arange(len(owners)) + window <= words.first[1:][owners]
    starts = np.flatnonzero(inside)
    covered = np.zeros(len(owners) + 1, np.int64)
    found = starts[_repeated(_in_text(W.runs(words, window)[starts], owners[starts]))]
    np.add.at(covered, found, 1)
    np.add.at(covered, found + window, -1)
    return np.bincount(owners[np.cumsum(covered[:-1]) > 0], minlength=len(words.first) - 1)


def duplicate_lines(texts: W.Texts) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    found = np.zeros(len(texts), np.int64)
    for first, piece in texts.pieces():
        breaks = np.flatnonzero(piece.data == 0x0A)
        starts = np.concatenate([piece.offsets[:-1], breaks + 1])
        ends = np.concatenate([piece.offsets[1:], breaks])
        starts.sort(), ends.sort()
        # An empty last text has no line of its own to end; starts and ends still pair up in order.
        letters = np.concatenate([[0], np.cumsum(~W._BLANK[piece.data])])
        worded = letters[ends] > letters[starts]
        starts, ends = starts[worded], ends[worded]
        owners = np.searchsorted(piece.offsets, starts, "right") - 1
        keys = _in_text(W.span_hashes(W.prefix_hashes(piece.data), starts, ends), owners)
        distinct = np.unique(keys, return_index=True)[1]
        lines = np.bincount(owners, minlength=len(piece))
        found[first : first + len(piece)] = lines - np.bincount(owners[distinct], minlength=len(piece))
    return found


def _entropy(tokens: np.ndarray, owners: np.ndarray, counts: np.ndarray, pieces: int) -> np.ndarray:
    """Bits per token of every text; 0 without tokens."""
    keys = np.sort(owners * pieces + tokens)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    times = np.diff(edges)
    held = np.bincount(keys[edges[:-1]] // pieces, times * np.log2(np.maximum(times, 1)), len(counts))
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)) - held / np.maximum(counts, 1), 0.0)


def measure(texts: W.Texts, vocabulary: str) -> dict:
    """The columns of MEASURES but the last one for the texts, as NumPy arrays, and the size of the vocabulary."""
    memo, single = _vocabulary(vocabulary)
    words = W.split_words(texts)
    owners, n_words = words.owners, words.counts
    pieces, number = memo.look_up(texts.data, words.starts, words.ends, words.hashes)
    n_texts = len(texts)
    letters = np.concatenate([[0], np.cumsum(_LETTER_START[texts.data], dtype=np.int64)])
    word_chars = np.bincount(owners, letters[words.ends] - letters[words.starts], n_texts).astype(np.int64)
    del letters  # as long as all texts together, eight bytes each
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[texts.data], dtype=np.int64)])
    n_symbols = symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]]
    del symbols
    tokens = pieces.take(number)
    n_tokens = np.bincount(owners, tokens.lengths, n_texts).astype(np.int64)
    owner_of = np.repeat(owners, tokens.lengths)
    bytes_only = np.bincount(owner_of[single[tokens.values]], minlength=n_texts)
    entropy = _entropy(tokens.values.astype(np.int64), owner_of, n_tokens, len(single))
    some = np.maximum(n_tokens, 1)
    n_repeat = repeat_words(words)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": n_repeat,
        "n_tokens": n_tokens,
        "chars_per_token": word_chars / some,
        "fallback_share": bytes_only / some,
        "token_entropy": entropy,
        "base_failed": base_failed,
        "pieces": np.full(n_texts, len(single)),
    }


def judge(found: dict, langs: list, bands: dict[str, Band | LearnedBand], default: Band) -> np.ndarray:
    """Which texts pass, by their measures and languages."""
    per_token, fallback, entropy, n_tokens, pieces = (
        found[name] for name in ("chars_per_token", "fallback_share", "token_entropy", "n_tokens", "pieces")
    )
    fine = np.zeros(len(per_token), dtype=bool)
    named = np.array([lang if lang in bands else None for lang in langs], dtype=object)
    for lang in set(named):
        at = np.flatnonzero(named == lang)
        band = default if lang is None else bands[lang]
        fine[at] = band.holds(per_token[at], fallback[at], entropy[at], n_tokens[at], pieces[at])
    return ~found["base_failed"] & fine


def _names() -> list[str]:
    return [part.split()[0] for part in MEASURES.split(", ")]


def measured(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``keep`` of every document, its language as ``_lang``, MEASURES but the last, and ``pieces``."""
    names = [*_names()[:-1], "pieces"]
    clash = set(keep) & {*names, "kept", "_lang", "_text"}
    if clash:
        raise ValueError(f"columns to keep have the names of measures: {sorted(clash)}")
    read = docs.select(
        *[docs[c] for c in keep], docs[lang].cast("string").alias("_lang"), docs[text].cast("string").alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "_text", BATCH):
            found = measure(texts, vocabulary)
            columns = [table.column(c) for c in [*keep, "_lang"]] + [pa.array(found[n]) for n in names]
            yield from pa.table(columns, names=[*keep, "_lang", *names]).to_batches()

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.select(*keep).schema)
    made = MEASURES.rpartition(", ")[0]
    return read.mapInArrow(run, f"{kept}_lang string, {made}, pieces long")


def judged(rows: DataFrame, bands: dict[str, Band | LearnedBand] | None = None, default: Band = DEFAULT_BAND) -> DataFrame:
    """Rows of ``measured`` with ``kept`` in place of ``_lang`` and ``pieces``."""
    bands = BANDS if bands is None else bands
    needed = ("chars_per_token", "fallback_share", "token_entropy", "n_tokens", "pieces", "base_failed")
    left = [c for c in rows.columns if c not in ("_lang", "pieces")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in needed}
            kept = judge(found, batch.column("_lang").to_pylist(), bands, default)
            columns = [batch.column(c) for c in left] + [pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, [*left, "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*left).schema)
    return rows.mapInArrow(run, f"{kinds}, kept boolean")


def score_quality(
    docs: DataFrame,
    vocabulary: str,
    keep: list[str] | None = None,
    text: str = "text",
    lang: str = "lang",
    bands: dict[str, Band | LearnedBand] | None = None,
    default: Band = DEFAULT_BAND,
) -> DataFrame:
    """The columns ``keep`` of every document and MEASURES. One pass without a shuffle.

    ``vocabulary`` is the path of a sentencepiece model that every executor has.
    """
    return judged(measured(docs, vocabulary, ["doc_id"] if keep is None else keep, text, lang), bands, default)


def _written(rows: DataFrame) -> DataFrame:
    with arrow_batches(rows.sparkSession, 2 * BATCH):
        return materialise(rows)


def score_learned(docs: DataFrame, labels: DataFrame, vocabulary: str, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and MEASURES of every document, by bands learned from its labels. Texts are measured once."""
    rows = _written(measured(docs, vocabulary, [doc_id]))
    return judged(rows, bands_of(rows, labels, doc_id))


def _fitted(rows: DataFrame, end) -> dict[str, LearnedBand]:
    """Bands of the languages with LEAST rows. ``end`` makes a lower (0) or upper (1) end of five quantiles."""
    found = rows.groupBy("lang", F.floor(F.log2("n_tokens")).alias("k")).agg(
        F.percentile_approx(F.log2("n_tokens"), 0.5, 100_000).alias("length"),
        F.percentile_approx("token_entropy", 0.5, 100_000).alias("entropy"),
        F.count("*").alias("rows"),
    )
    classes: dict[str, list] = {}
    for row in found.orderBy("lang", "k").collect():
        classes.setdefault(row["lang"], []).append(row)
    classes = {lang: parts for lang, parts in classes.items() if sum(row["rows"] for row in parts) >= LEAST}
    if not classes:
        return {}
    rows = rows.where(F.col("lang").isin(list(classes)))
    middle = dict(rows.groupBy("lang").agg(F.percentile_approx("chars_per_token", 0.5, 100_000)).collect())
    plain = {}
    for lang, parts in classes.items():
        corners = [r for r in parts if r["rows"] >= CORNER] or [max(parts, key=lambda r: r["rows"])]
        curve = tuple(r["length"] for r in corners), tuple(r["entropy"] for r in corners)
        plain[lang] = LearnedBand(middle[lang], 0.0, 0.0, 0.0, *curve, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            measures = [batch.column(c).to_numpy() for c in ("chars_per_token", "token_entropy", "n_tokens")]
            chars, entropy = np.zeros(len(langs)), np.zeros(len(langs))
            for lang in set(langs):
                at = langs == lang
                chars[at], entropy[at] = plain[lang].distances(*(m[at] for m in measures))
            columns = [batch.column("lang"), pa.array(chars), batch.column("fallback_share"), pa.array(entropy)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "chars", "fallback", "entropy"])

    shares = F.array(*(F.lit(q) for q in (TAIL, 1 / 6, 0.5, 5 / 6, 1 - TAIL)))
    apart = rows.mapInArrow(run, "lang string, chars double, fallback double, entropy double")
    quantiles = [F.percentile_approx(c, shares, 100_000).alias(c) for c in ("chars", "fallback", "entropy")]
    return {
        row["lang"]: replace(
            plain[row["lang"]],
            min_chars=end(row["chars"], 0),
            max_chars=end(row["chars"], 1),
            max_fallback=max(FREE_FALLBACK, end(row["fallback"], 1)),
            min_entropy=end(row["entropy"], 0),
        )
        for row in apart.groupBy("lang").agg(*quantiles).collect()
    }


def bands_of(
    rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label_id: str = "doc_id", quality: str = "quality"
) -> dict[str, Band | LearnedBand]:
    """A band for every language with LEAST documents that pass the base rules, and BANDS besides.

    Learned from the ``measured`` rows whose id has the label 1 in ``quality``. A language with fewer than LEAST of
    them is learned from all its documents, with ends from the inner part of their scatter, since some of
    them are junk. ``rows`` is read several times; only the bands come to the driver.
    """
    fine = rows.where("NOT base_failed AND _lang IS NOT NULL").select(
        F.col(doc_id).alias("_id"), F.col("_lang").alias("lang"), "chars_per_token", "fallback_share", "token_entropy", "n_tokens"
    )
    marks = labels.where(labels[quality] == 1).select(labels[label_id].alias("_id"))
    good = _fitted(fine.join(marks, "_id", "left_semi"), lambda ends, i: (ends[0], ends[4])[i])
    rest = fine.where(~F.col("lang").isin(list(good))) if good else fine
    return BANDS | _fitted(rest, lambda ends, i: ends[2] + FAR * (ends[1 + 2 * i] - ends[2])) | good


def learn_bands(
    docs: DataFrame,
    labels: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quality: str = "quality",
) -> dict[str, Band | LearnedBand]:
    """The bands of ``bands_of`` for documents that are not measured yet."""
    named = docs.select(docs[doc_id].alias("_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    return bands_of(_written(measured(named, vocabulary, ["_id"])), labels, "_id", doc_id, quality)


def keep_good(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    lang: str = "lang",
    labels: DataFrame | None = None,
    doc_id: str = "doc_id",
    bands: dict[str, Band | LearnedBand] | None = None,
    default: Band = DEFAULT_BAND,
) -> DataFrame:
    """The documents that pass, with the columns they had, of any names.

    With ``labels`` the bands are learned from them in a pass of its own, which writes the measures without the
    texts: measuring twice costs processor time, a copy of all texts would stay on the disk. Texts are measured and
    judged by the same worker, and only those that pass come back from it.
    """
    safe, named = renamed(docs)
    if labels is not None:
        bands = learn_bands(docs, labels, vocabulary, doc_id, text, lang)
    bands = BANDS if bands is None else bands
    names = safe.columns
    read = safe.withColumn("_lang", safe[named[lang]].cast("string"))
    whole = named[text]
    if dict(safe.dtypes)[whole] != "string":
        read, whole = read.withColumn("_text", safe[whole].cast("string")), "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, whole, BATCH):
            kept = judge(measure(texts, vocabulary), table.column("_lang").to_pylist(), bands, default)
            yield from table.select(names).filter(pa.array(kept)).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema)
    return read.mapInArrow(run, kinds).toDF(*docs.columns)
