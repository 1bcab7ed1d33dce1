"""A log-bilinear language model, trained with noise-contrastive estimation.

Tokens are the words of a text with A-Z in lower case, then one end token. Words that occur
often enough (``own_count``, which grows more slowly than the corpus, so there are more of them the larger
it is) have vectors of their own, as targets and as context; other words share the vectors of their ending.
A *class* is a word by itself (the commonest ones), an equal share of the other words with vectors, in the
order of their last letters, or an ending. The probability of a token is that of its class in its context,
times that of the word among the words of the class, and within an ending the add-one probability by
counts. So the whole open vocabulary has probability one.

The network: the context vector is the sum of the vectors of the ``CONTEXT`` words before, each
weighted by its place; a score is its product with an output vector plus a bias.
Scoring normalises over all classes, and over the words of a token's class, by matrix products for
blocks of tokens.

Training is by noise-contrastive estimation over all training texts. The texts are dealt by hashes of
their rows into rounds and shards of about ``SHARD_TOKENS`` tokens; in every round each shard starts from
the same parameters and Adagrad sums, goes through its texts in the order of their hashes, and Spark
averages what the shards have learned, in whole numbers. So the model follows from the rows alone: not
from the number of tasks, the files or the batches; and a larger corpus has more shards, not shorter ones.

Counts cover all training texts. The counts of the commonest words (``COMMON``, a fixed number) are sent
to the tasks; rarer words are joined by their hash, so nothing that grows with the data is broadcast.
Words are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; a null document id counts as not held
out; repeated rows are scored each; a word never seen in training counts as unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlab.llm import words as W
from answerlab.session import arrow_batches, materialise

TEXT_BYTES = 2 << 20  # of an Arrow batch; by rows alone a task holds ten times as much
COUNTED = 1 << 19  # words whose counts a task sums up at once
COMMON = 200_000
OWN_CLASSES = 96
GROUP_CLASSES = 80
ENDING_CLASSES = 78
OWN_WORDS = 600
ENDING = 3
DIMENSION = 16
CONTEXT = 3
ROUNDS = 4
SHARD_TOKENS = 1_000_000
MAX_TASKS = 1 << 14
SLICE = 64  # batches whose contexts are laid out at once
MOST_LOG = 85.0  # of a sum of scores that 32-bit numbers hold
_WEIGHT = 256  # of a shard of SHARD_TOKENS in the averages
_FIXED = float(1 << 20)  # parameters are averaged as whole multiples of its inverse
BATCH = 1024
NOISE = 32
WORD_NOISE = 2
RATE = 0.12
FIRST_ROOT = 10.0  # of the Adagrad sums
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
_END_ENDING = -1


@dataclass
class Vocabulary:
    """What the tasks know of the words: common ones, endings, classes and totals.

    Words with vectors and endings are numbered class by class; ``first`` are the classes' first ones. ``keys``, ``counts`` and ``numbers`` are the hashes, counts and numbers of the common words.
    """

    keys: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    endings: np.ndarray
    ending_classes: np.ndarray
    first: np.ndarray
    word_tokens: np.ndarray
    spread: np.ndarray  # log10 of what a word's count + 1 is divided by within its number
    tokens: int
    words: int

    @property
    def size(self) -> int:
        return len(self.word_tokens)

    @property
    def start(self) -> int:
        """The number that stands before the first word of a text."""
        return self.size

    @cached_property
    def index(self) -> pd.Index:
        """The keys as a hash table, which is made in the tasks."""
        return pd.Index(self.keys)

    @property
    def shares(self) -> np.ndarray:
        return (self.word_tokens + 0.5) / (self.word_tokens + 0.5).sum()


def own_count(tokens: int) -> float:
    """How often a word must occur to have vectors: as tokens ** 0.75, which leaves more and more words."""
    return max(2.0, tokens**0.75 / OWN_WORDS)


def folded(texts: W.Texts) -> W.Texts:
    return W.Texts(np.take(_FOLD, texts.data), texts.offsets)


def tokens_of(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every token, its ending, first token of each text), with an end token after each text."""
    texts = folded(texts)
    words = W.split_words(texts)
    endings = np.zeros(len(words.ends), np.int64)
    for back in range(1, ENDING + 1):
        at = words.ends - back
        letters = np.take(texts.data, at, mode="clip").astype(np.int64)
        letters *= at >= words.starts
        endings |= letters << (8 * (back - 1))
    hashes = np.insert(words.hashes, words.first[1:], _END)
    endings = np.insert(endings, words.first[1:], _END_ENDING)
    return hashes, endings, words.first + np.arange(len(words.first))


def count_words(docs: DataFrame, text: str, learn: str) -> DataFrame:
    """(hash, ending, c) of all words of the rows where ``learn`` is true, the end token included."""

    def summed(parts: list[tuple]) -> pa.RecordBatch:
        hashes, endings, counts = (np.concatenate(column) for column in zip(*parts, strict=True))
        numbers, keys = pd.factorize(hashes)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, numbers, counts)
        columns = [keys.view(np.int64), _by_number(numbers, endings, len(keys)), sums]
        return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["hash", "ending", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, texts in W.batches_of(batches, "_text", 2 * TEXT_BYTES):
            hashes, endings, _ = tokens_of(texts)
            numbers, keys = pd.factorize(hashes)
            parts.append((keys, _by_number(numbers, endings, len(keys)), np.bincount(numbers, minlength=len(keys))))
            held += len(keys)
            if held >= COUNTED:
                yield summed(parts)
                parts, held = [], 0
        if parts:
            yield summed(parts)

    read = docs.where(F.col(learn)).select(F.col(text).alias("_text"))
    partial = read.mapInArrow(run, "hash long, ending long, c long")
    return partial.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def _by_number(numbers: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The value of each number, where equal numbers have equal values."""
    out = np.empty(size, values.dtype)
    out[numbers] = values
    return out


def _commonest(counts: DataFrame) -> pd.DataFrame:
    """The words of at least some count, as many as there are within COMMON.

    The count is found from a histogram of at most 8 bins for each doubling, so no task and not the driver
    gets more than COMMON words.
    """
    level = F.floor(F.log2(F.col("c")) * 8).cast("int")
    bins = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    lowest, held = 1 << 30, 0
    for number, words in bins:
        held += words
        if held > COMMON:
            break
        lowest = number
    return counts.where(level >= lowest).toPandas()


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """Common words, endings and totals from written counts; what comes to the driver has a fixed bound."""
    top = _commonest(counts).sort_values(["c", "hash"], ascending=[False, True], ignore_index=True)
    own = top.head(OWN_CLASSES)
    rest = counts.join(
        F.broadcast(counts.sparkSession.createDataFrame(own[["hash"]], "hash long")), "hash", "left_anti"
    )
    by_ending = rest.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("words"))
    kept = by_ending.orderBy(F.desc("c"), "ending").limit(ENDING_CLASSES).toPandas()
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, words = int(totals[0] or 0), int(totals[1])
    found = top["c"].to_numpy(np.int64)
    last_letters = top["ending"].to_numpy(np.int64)
    grouped = np.flatnonzero(found >= own_count(tokens))
    grouped = grouped[grouped >= len(own)]
    # By the last letter, the one before it, and so on; words of one ending in the order of their counts.
    letters = [last_letters[grouped] >> (8 * back) & 255 for back in reversed(range(ENDING))]
    grouped = grouped[np.lexsort(letters)]
    held = np.concatenate([np.arange(len(own)), grouped]).astype(np.int64)
    groups = min(GROUP_CLASSES, len(grouped))
    bounds = len(own) + np.arange(groups) * len(grouped) // max(1, groups)
    endings_at = len(own) + groups
    other = endings_at + len(kept)
    first = np.concatenate([np.arange(len(own)), bounds, len(held) + np.arange(len(kept) + 2)]).astype(np.int64)

    order = np.argsort(kept["ending"].to_numpy(np.int64))
    endings, ending_classes = kept["ending"].to_numpy(np.int64)[order], endings_at + order
    classes = _class_of(endings, ending_classes, other, last_letters)
    numbers = first[classes]
    numbers[held] = np.arange(len(held))
    # What the words with vectors leave of each ending.
    inside = classes[grouped] - endings_at
    left_tokens = np.append(kept["c"].to_numpy(np.int64), 0)
    left_words = np.append(kept["words"].to_numpy(np.int64), 0)
    left_tokens[-1] = tokens - found[: len(own)].sum() - left_tokens.sum()
    left_words[-1] = words - len(own) - left_words.sum()
    np.subtract.at(left_tokens, inside, found[grouped])
    np.subtract.at(left_words, inside, 1)
    word_tokens = np.concatenate([found[held], left_tokens])
    spread = np.log10(np.concatenate([found[held], left_tokens + left_words]) + 1.0)
    keys = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Vocabulary(
        keys[order], found[order], numbers[order], endings, ending_classes, first, word_tokens, spread, tokens, words
    )


def _class_of(endings: np.ndarray, ending_classes: np.ndarray, other: int, given: np.ndarray) -> np.ndarray:
    classes = np.full(len(given), other)
    if len(endings):
        place = np.minimum(np.searchsorted(endings, given), len(endings) - 1)
        found = endings[place] == given
        classes[found] = ending_classes[place[found]]
    return classes


def look_up(vocabulary: Vocabulary, hashes: np.ndarray, endings: np.ndarray):
    """(number, count or 0, whether the word is common) for every token."""
    inverse, distinct = pd.factorize(hashes)
    other = len(vocabulary.first) - 2
    own_endings = _by_number(inverse, endings, len(distinct))
    numbers = vocabulary.first[_class_of(vocabulary.endings, vocabulary.ending_classes, other, own_endings)]
    counts = np.zeros(len(distinct), np.int64)
    place = vocabulary.index.get_indexer(distinct)
    common = place >= 0
    numbers[common] = vocabulary.numbers[place[common]]
    counts[common] = vocabulary.counts[place[common]]
    return numbers[inverse], counts[inverse], common[inverse]


def contexts(units: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """Numbers 1 .. CONTEXT places before every token; ``start`` before a text's beginning."""
    places = np.arange(len(units)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((len(units), CONTEXT), start)
    for back in range(1, CONTEXT + 1):
        inside = np.flatnonzero(places >= back)
        out[inside, back - 1] = units[inside - back]
    return out


class LogBilinear:
    """The parameters as rows of one table, each a vector and a bias.

    Rows: a context vector for every word number and the start of a text, an output vector for every class, one
    for every word number, and the weights by place. ``roots`` are the roots of the Adagrad sums.
    """

    def __init__(self, first: np.ndarray, shares: np.ndarray, table: np.ndarray, roots: np.ndarray | None = None):
        self.first, self.words, self.classes = first, len(shares), len(first) - 1
        self.class_of = np.repeat(np.arange(self.classes), np.diff(first))
        self.class_shares = np.add.reduceat(shares, first[:-1])
        self.within = shares / self.class_shares[self.class_of]
        self.table = table.astype(np.float32)
        self.roots = np.full(table.shape, FIRST_ROOT, np.float32) if roots is None else roots.astype(np.float32)
        self.class_row = self.words + 1
        self.word_row = self.class_row + self.classes
        self.place_row = self.word_row + self.words

    @classmethod
    def fresh(cls, first: np.ndarray, shares: np.ndarray, seed: int = 7) -> LogBilinear:
        """Small random vectors; biases that make the model the unigram distribution ``shares``."""
        rows = 2 * len(shares) + len(first) + CONTEXT
        table = np.zeros((rows, DIMENSION + 1), np.float32)
        table[:, :DIMENSION] = np.random.default_rng(seed).normal(0, 0.1, (rows, DIMENSION))
        model = cls(first, shares, table)
        table[model.class_row : model.word_row, DIMENSION] = np.log(model.class_shares)
        table[model.word_row : model.place_row, DIMENSION] = np.log(model.within)
        table[model.place_row :, :DIMENSION] = 1.0
        return cls(first, shares, table)

    def predicted(self, weighted: list[np.ndarray], context: np.ndarray) -> np.ndarray:
        """Sums of the vectors, weighted by place, of every context, with a one for the bias."""
        out = np.empty((len(context), DIMENSION + 1), np.float32)
        for begin in range(0, len(context), 8 * BATCH):
            around, part = context[begin : begin + 8 * BATCH], out[begin : begin + 8 * BATCH]
            np.take(weighted[0], around[:, 0], axis=0, out=part, mode="clip")
            for place in range(1, CONTEXT):
                part += np.take(weighted[place], around[:, place], axis=0, mode="clip")
        out[:, DIMENSION] = 1.0
        return out

    @staticmethod
    def _log_share(hidden: np.ndarray, norms: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Logarithm of the chosen row's share in the normalised scores of all rows; ``norms`` are those of ``hidden``."""
        out = np.empty(len(hidden))
        size = max(1, BATCH * 256 // len(rows))
        ones = np.ones(len(rows), np.float32)
        across = np.ascontiguousarray(rows.T)
        held = np.empty((min(size, len(hidden)), len(rows)), np.float32)
        # No score is above the product of the norms; where that could overflow, it is taken off first.
        most = (MOST_LOG - np.log(len(rows))) / max(np.sqrt(np.square(rows).sum(axis=1).max()), 1e-30)
        for begin in range(0, len(hidden), size):
            part = hidden[begin : begin + size]
            scores = np.matmul(part, across, out=held[: len(part)])
            if norms[begin : begin + size].max() > most:
                scores -= scores.max(axis=1)[:, None]
            own = scores[np.arange(len(scores)), chosen[begin : begin + size]]
            np.exp(scores, out=scores)
            out[begin : begin + size] = own - np.log(scores @ ones)
        return out

    def log_probabilities(self, words: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of each word number in its context."""
        out = np.empty(len(words))
        several = np.diff(self.first) > 1
        weighted = [self.table[: self.class_row] * weights for weights in self.table[self.place_row :]]
        for begin in range(0, len(words), SLICE * BATCH):
            own = words[begin : begin + SLICE * BATCH]
            hidden = self.predicted(weighted, context[begin : begin + SLICE * BATCH])
            norms = np.sqrt(np.einsum("ij,ij->i", hidden, hidden))
            classes = self.class_of[own]
            logs = self._log_share(hidden, norms, self.table[self.class_row : self.word_row], classes)
            # The tokens of classes that hold several words, class by class.
            order = np.flatnonzero(several[classes])
            inner = classes[order].astype(np.uint16)  # sorted by counting
            order = order[np.argsort(inner, kind="stable")]
            hidden, norms, own = np.take(hidden, order, axis=0), norms[order], own[order]
            within = np.empty(len(order))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(inner, minlength=self.classes))])
            for number in np.flatnonzero(np.diff(bounds)):
                low, high = self.first[number], self.first[number + 1]
                at = slice(bounds[number], bounds[number + 1])
                rows = self.table[self.word_row + low : self.word_row + high]
                within[at] = self._log_share(hidden[at], norms[at], rows, own[at] - low)
            logs[order] += within
            out[begin : begin + SLICE * BATCH] = logs
        return out

    def train(self, words: np.ndarray, context: np.ndarray, rate: float, random) -> None:
        """One pass of noise-contrastive estimation with Adagrad.

        Noise classes are shared within a batch; noise words are drawn for each token from its class.
        """
        class_noise = np.log(self.class_shares * NOISE).astype(np.float32)
        word_noise = np.log(self.within * WORD_NOISE).astype(np.float32)
        class_sums = np.cumsum(self.class_shares)
        sums = np.cumsum(self.within)
        several = np.diff(self.first) > 1
        table, width = self.table, DIMENSION
        small = len(table) <= 1 << 16
        # The rows that a batch touches and their changes, one kind after the other.
        held = np.empty((1 + WORD_NOISE + CONTEXT) * BATCH + BATCH + NOISE + CONTEXT, np.uint16 if small else np.int64)
        changed = np.empty((len(held), width + 1), np.float32)
        for begin in range(0, len(words), BATCH):
            own, around = words[begin : begin + BATCH], context[begin : begin + BATCH]
            count = len(own)
            classes = self.class_of[own]
            drawn = np.minimum(np.searchsorted(class_sums, random.random(NOISE)), self.classes - 1)
            places = table[self.place_row :]
            rows = [np.take(table, around[:, p], axis=0) for p in range(CONTEXT)]
            hidden = rows[0] * places[0]
            for p in range(1, CONTEXT):
                hidden += rows[p] * places[p]
            hidden[:, width] = 1.0
            # Data are labelled 1 and noise 0; these are the gradients of the log likelihood of the labels.
            outputs, noise = np.take(table, self.class_row + classes, axis=0), table[self.class_row + drawn]
            up = _miss(np.einsum("ij,ij->i", hidden, outputs) - class_noise[classes])
            down = -_miss(class_noise[drawn] - hidden @ noise.T)
            back = up[:, None] * outputs + down @ noise
            np.add(classes, self.class_row, out=held[:count], casting="unsafe")
            np.multiply(up[:, None], hidden, out=changed[:count])
            at = count + NOISE
            held[count:at] = self.class_row + drawn
            changed[count:at] = down.T @ hidden
            # The words of classes that hold several.
            inside = np.flatnonzero(several[classes])
            if len(inside):
                inner, owned, known = np.take(hidden, inside, axis=0), own[inside], classes[inside]
                low, high = self.first[known], self.first[known + 1]
                before = np.where(low > 0, sums[np.maximum(low, 1) - 1], 0.0)
                draws = random.random((len(inside), WORD_NOISE)) + before[:, None]
                others = np.clip(np.searchsorted(sums, draws), low[:, None], high[:, None] - 1)
                outputs = np.take(table, self.word_row + owned, axis=0)
                noise = np.take(table, self.word_row + others, axis=0)
                up = _miss(np.einsum("ij,ij->i", inner, outputs) - word_noise[owned])
                down = -_miss(word_noise[others] - np.einsum("ij,ikj->ik", inner, noise))
                back[inside] += up[:, None] * outputs + np.einsum("ik,ikj->ij", down, noise)
                end, last = at + len(inside), at + (1 + WORD_NOISE) * len(inside)
                held[at:end] = self.word_row + owned
                held[end:last] = (self.word_row + others).ravel()
                np.multiply(up[:, None], inner, out=changed[at:end])
                each = changed[end:last].reshape(len(inside), WORD_NOISE, width + 1)
                np.multiply(down[:, :, None], inner[:, None, :], out=each)
                at = last
            back[:, width] = 0
            for place in range(CONTEXT):
                end = at + count
                held[at:end], held[end] = around[:, place], self.place_row + place
                np.multiply(back, places[place], out=changed[at:end])
                np.einsum("ij,ij->j", back, rows[place], out=changed[end])
                at = end + 1
            self._step(held[:at], changed[:at], rate)

    def _step(self, touched: np.ndarray, changes: np.ndarray, rate: float) -> None:
        """Adagrad on the rows that a batch touches, their changes summed first."""
        order = np.argsort(touched, kind="stable")  # 16-bit rows are sorted by counting
        sorted_rows = touched[order]
        edges = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        rows = sorted_rows[edges].astype(np.int64)
        change = np.add.reduceat(np.take(changes, order, axis=0), edges, axis=0)
        root = np.square(np.take(self.roots, rows, axis=0))
        root += np.square(change)
        np.sqrt(root, out=root)
        self.roots[rows] = root
        change *= np.float32(rate)
        change /= root
        change += np.take(self.table, rows, axis=0)
        self.table[rows] = change


def _miss(logits: np.ndarray) -> np.ndarray:
    """One less the probability that the logits give."""
    out = np.minimum(np.maximum(logits, -30.0), 30.0)
    np.exp(out, out=out)
    out += 1.0
    return np.divide(1.0, out, out=out)


def dealt_units(docs: DataFrame, text: str, learn: str, key: str, vocabulary: Vocabulary) -> tuple[DataFrame, int]:
    """The learning rows as word numbers, dealt into rounds and shards; and how many shards a round has.

    Rows of equal id and text are counted before they are shuffled and numbered afterwards, so that also
    the copies of one row are spread over all shards.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "_text", 2 * TEXT_BYTES):
            hashes, endings, first = tokens_of(texts)
            units = look_up(known.value, hashes, endings)[0].astype("<u4").tobytes()
            held = pa.array([units[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield from pa.table({"_row": table.column("_row"), "units": held}).to_batches()

    shards = max(1, round(vocabulary.tokens / (ROUNDS * SHARD_TOKENS)))
    read = docs.where(F.col(learn)).select(F.xxhash64(F.col(key), F.col(text)).alias("_row"), F.col(text).alias("_text"))
    copies = read.mapInArrow(run, "_row long, units binary").groupBy("_row", "units").count()
    each = copies.select("_row", "units", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    place = F.pmod(F.xxhash64("_row", "copy"), F.lit(ROUNDS * shards)).cast("int")
    dealt = each.withColumn("_place", place).select(
        (F.col("_place") % ROUNDS).alias("round"), F.floor(F.col("_place") / ROUNDS).cast("int").alias("shard"), "_row", "copy", "units"
    )
    return materialise(dealt), shards


def _learn_shard(model: LogBilinear, pieces: list[bytes], start: int, rate: float, random) -> int:
    """Train on the texts of a shard one after the other; the number of their tokens."""
    first = np.cumsum([0] + [len(p) // 4 for p in pieces])
    units = np.frombuffer(b"".join(pieces), "<u4")
    size = SLICE * BATCH
    for begin in range(0, len(units), size):
        end = min(begin + size, len(units))
        # The slice with the tokens before it, of which only those of the same text count.
        lead = min(begin, CONTEXT)
        inside = first[(first > begin - lead) & (first < end)] - (begin - lead)
        # Where the slice begins in the middle of a text, its start lies further back than any context.
        bounds = np.concatenate([[0], inside, [end - begin + lead]])
        own = units[begin - lead : end].astype(np.int64)
        model.train(own[lead:], contexts(own, bounds, start)[lead:], rate, random)
    return len(units)


def fit(docs: DataFrame, text: str, learn: str, key: str, vocabulary: Vocabulary) -> LogBilinear:
    """Train over all learning rows, in ROUNDS rounds of a share each.

    A shard sends the rows of the parameters that it touched; what comes to the driver is as long as the model.
    """
    first, shares, start = vocabulary.first, vocabulary.shares, vocabulary.start
    model = LogBilinear.fresh(first, shares)
    spark = docs.sparkSession
    dealt, shards = dealt_units(docs, text, learn, key, vocabulary)
    names = [f"p{i}" for i in range(DIMENSION + 1)] + [f"r{i}" for i in range(DIMENSION + 1)]
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((first, shares, model.table, model.roots))
        rate = RATE * (1 - number / (2 * ROUNDS))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate, number=number) -> Iterator[pa.RecordBatch]:
            def learned(shard: int, pieces: list[bytes]) -> pa.RecordBatch:
                own = LogBilinear(*sent.value)
                seen = _learn_shard(own, pieces, start, rate, np.random.default_rng([number, shard]))
                weight = max(1, round(_WEIGHT * seen / SHARD_TOKENS))
                rows = np.flatnonzero((own.roots != sent.value[3]).any(axis=1))
                values = np.hstack([own.table[rows], own.roots[rows]]).astype(np.float64)
                values = np.rint(values * _FIXED).astype(np.int64) * weight
                # The last row tells the shard's weight.
                values = np.vstack([values, np.zeros((1, values.shape[1]), np.int64)])
                columns = [np.append(rows, -1).astype(np.int32), np.full(len(values), weight, np.int64), *values.T]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "weight", *names])

            shard, pieces = -1, []
            for batch in batches:
                for own, units in zip(batch.column("shard").to_pylist(), batch.column("units").to_pylist(), strict=True):
                    if own != shard and pieces:
                        yield learned(shard, pieces)
                        pieces = []
                    shard = own
                    pieces.append(units)
            if pieces:
                yield learned(shard, pieces)

        own = dealt.where(F.col("round") == number).select("shard", "_row", "copy", "units")
        # A partition for each shard, as far as a driver can list them; those with several take one by one.
        own = own.repartitionById(min(shards, MAX_TASKS), F.col("shard") % MAX_TASKS)
        trained = own.sortWithinPartitions("shard", "_row", "copy", "units").select("shard", "units").mapInArrow(
            run, "row int, weight long, " + ", ".join(f"{name} long" for name in names)
        )
        summed = trained.groupBy("row").agg(*[F.sum(name).alias(name) for name in ["weight", *names]])
        summed = summed.toPandas().sort_values("row")
        sent.unpersist()
        if len(summed):
            values = summed[names].to_numpy(np.float64)[1:] / _FIXED
            rows, weights = summed["row"].to_numpy()[1:], summed["weight"].to_numpy(np.float64)
            total, weights = weights[0], weights[1:, None]
            both = np.hstack([model.table, model.roots]).astype(np.float64)
            # Shards that did not touch a row leave it as it was.
            both[rows] = (values + (total - weights) * both[rows]) / total
            model = LogBilinear(first, shares, *np.hsplit(both, 2))
    return model


def _score(model: LogBilinear, vocabulary: Vocabulary, texts: W.Texts) -> tuple[dict[str, np.ndarray], W.Ragged, np.ndarray]:
    """Sums per text without its rare words; the rare words' hashes and how often each occurs."""
    hashes, endings, first = tokens_of(texts)
    numbers, counts, common = look_up(vocabulary, hashes, endings)
    owners = np.repeat(np.arange(len(texts)), np.diff(first))
    logs = model.log_probabilities(numbers, contexts(numbers, first, vocabulary.start)) / np.log(10)
    logs -= vocabulary.spread[numbers]
    sums = {
        "n_tokens": np.diff(first),
        "n_common": np.bincount(owners, common, len(texts)).astype(np.int64),
        "common_log": np.bincount(owners, np.log10(counts + 1.0), len(texts)),
        "model_log": np.bincount(owners, logs, len(texts)),
    }
    rare = ~common
    rare_hashes, rare_owners = hashes[rare], owners[rare]
    order = np.lexsort((rare_hashes, rare_owners))
    rare_hashes, rare_owners = rare_hashes[order], rare_owners[order]
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = (rare_hashes[1:] != rare_hashes[:-1]) | (rare_owners[1:] != rare_owners[:-1])
    at = np.flatnonzero(edge)
    times = np.diff(np.append(at, len(order)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rare_owners[at], minlength=len(texts)))])
    return sums, W.Ragged(rare_hashes[at], offsets), times


def score_documents(docs: DataFrame, learn: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probabilities of every text under the model and under add-one unigram counts.

    ``learn`` names a boolean column: rows where it is true are learned from; all rows are scored.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        docs[doc_id].alias("doc_id"), docs[text].alias("_text"), F.coalesce(docs[learn], F.lit(False)).alias("_learn")
    )
    with arrow_batches(spark, TEXT_BYTES):
        counts = materialise(count_words(rows, "_text", "_learn"))
        vocabulary = read_vocabulary(counts)
        model = fit(rows, "_text", "_learn", "doc_id", vocabulary)
    known = spark.sparkContext.broadcast((vocabulary, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = known.value
        own = LogBilinear(words.first, words.shares, table)
        number = TaskContext.get().partitionId() << 36
        for table, texts in W.batches_of(batches, "_text", 2 * TEXT_BYTES):
            sums, rare, times = _score(own, words, texts)
            columns = {
                "row": pa.array(number + np.arange(len(texts))),
                "doc_id": table.column("doc_id"),
                "held_out": pc.invert(table.column("_learn")),
                **{name: pa.array(values) for name, values in sums.items()},
                "rare": pa.ListArray.from_arrays(
                    rare.offsets.astype(np.int32),
                    pa.StructArray.from_arrays(
                        [pa.array(rare.values.view(np.int64)), pa.array(times.astype(np.int32))], ["hash", "times"]
                    ),
                ),
            }
            number += len(texts)
            yield from pa.table(columns).to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    # Written once: the row numbers that the next join uses must not be made anew.
    with arrow_batches(spark, TEXT_BYTES):
        scored = materialise(
            rows.mapInArrow(
                run,
                f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_common long, common_log double, "
                "model_log double, rare array<struct<hash: bigint, times: int>>",
            )
        )
    # No rare word is frequent, so this join has no hot key; what it finds is summed before the next one.
    rare = scored.select("row", F.inline("rare")).join(counts.select("hash", "c"), "hash")
    found = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum("times").alias("n_rare")
    )
    logs = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0))
    total = float(vocabulary.tokens + vocabulary.words + 1)
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(total))).alias("base_score"),
        (logs + F.col("model_log")).alias("score"),
    )
