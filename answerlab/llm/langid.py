"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A text is parsed into the longest
phrases that occur in a language's text: the automaton reads on until a letter does not follow, and
starts anew with it. The language that needs the fewest phrases, each costing the logarithm of the
text learned from (log2(n) bits per phrase, per letter parsed), wins.

Texts are read as letters in lower case with one blank between runs of letters. Texts longer than
STRETCH are parsed in stretches of that length, all of which count, so that many are read side by side.

The automata are fitted on a bounded sample: per language the ROWS learning texts of lowest hash, and
of each the first LETTERS letters, together at most ROWS * LETTERS. With more than FULL labels all learn, each
from fewer rows. Every text is then judged whole. All letters of a sample are told apart, in any script: an
automaton's commonest letters have columns of a table of moves, its other moves are looked up in sorted order.

Defined results: a null text, or one without a letter, is ``und`` with score 0; labels that are null are
not learned; ties go to the label that sorts first; without any label all texts are ``und``.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from answerlab.llm import words as W
from answerlab.session import materialise

ROWS = 48
LETTERS = 1_200
STRETCH = 2_048
#: Labels that learn from ROWS texts each; columns of an automaton's table, and cells of all tables.
FULL = 64
COLUMNS = 62
CELLS = 64_000_000


def letters_of(text: str) -> np.ndarray:
    """Code points of the text in lower case, other characters than letters as single blanks (0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint32)
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    return points[keep]


_letter_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter_table:
        table = np.zeros(0x110000, dtype=bool)
        # Marks belong to the letters they stand on.
        table[[p for p in range(0x110000) if unicodedata.category(chr(p))[0] == "L"]] = True
        _letter_table.append(table)
    return _letter_table[0]


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, int]:
    """Moves (state, symbol, next state) of the automaton of all substrings, and the number of states."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols:
        current = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in follow[state]:
            follow[state][symbol] = current
            state = link[state]
        if state >= 0:
            other = follow[state][symbol]
            if length[state] + 1 == length[other]:
                link[current] = other
            else:
                copy = len(follow)
                follow.append(dict(follow[other]))
                length.append(length[state] + 1)
                link.append(link[other])
                while state >= 0 and follow[state].get(symbol) == other:
                    follow[state][symbol] = copy
                    state = link[state]
                link[other] = link[current] = copy
        last = current
    moves = [(state, symbol, target) for state, found in enumerate(follow) for symbol, target in found.items()]
    return np.array(moves, dtype=np.int64).reshape(-1, 3), len(follow)


class Parser:
    """Automata of all languages in one table of moves.

    A move holds (next state << 1 | 1 if a phrase ends before this letter). Where a letter does not
    follow, the next phrase starts with it; a letter that the language lacks is a phrase of its own there.
    A move of -1 is one of a rarer letter, to be found among ``keys``.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.labels = sorted(samples)
        learned = {label: [letters_of(text) for text in samples[label]] for label in self.labels}
        seen = np.concatenate([p for parts in learned.values() for p in parts] or [np.zeros(0, np.uint32)])
        points = np.unique(seen[seen > 0])
        # 0 is the blank, the last symbol any letter that no language has.
        unknown = len(points) + 1
        self.size = unknown + 1
        self.symbol = np.full(0x110000, unknown, dtype=np.uint8 if self.size <= 256 else np.int32)
        self.symbol[0] = 0
        self.symbol[points] = np.arange(1, unknown)
        built = []
        for label in self.labels:
            text = np.concatenate([np.append(self.symbol[p], 0) for p in learned[label]] or [np.zeros(1, np.uint8)])
            built.append((text, *suffix_automaton(text.tolist())))
        own = max(1, min(COLUMNS, CELLS // max(1, sum(states for _, _, states in built)) - 2))
        # Few letters in all: the same columns for every language. Otherwise each has those of its own
        # commonest letters, then one for letters it lacks and one for its rarer letters.
        shared = self.size <= own + 2
        width = self.size if shared else own + 2
        self.columns = None if shared else np.full((len(built), self.size), own, dtype=np.int16)
        self.fresh = None if shared else np.zeros((len(built), self.size), dtype=np.int64)
        tables, roots, bits, keys, targets, base = [], [], [], [], [], 0
        for number, (text, moves, states) in enumerate(built):
            column = np.arange(self.size)
            if not shared:
                counts = np.bincount(text, minlength=self.size)
                order = np.lexsort((np.arange(self.size), -counts))
                order = order[counts[order] > 0]
                column = self.columns[number]
                column[order[:own]] = np.arange(min(own, len(order)))
                column[order[own:]] = own + 1
                starts = moves[moves[:, 0] == 0]
                self.fresh[number, starts[:, 1]] = (starts[:, 2] + base) * width << 1 | 1
                rarer = moves[column[moves[:, 1]] == own + 1]
                keys.append((rarer[:, 0] + base) * width * self.size + rarer[:, 1])
                targets.append((rarer[:, 2] + base) * width << 1)
                moves = moves[column[moves[:, 1]] < own]
            table = np.full((states, width), -1, dtype=np.int64)
            table[moves[:, 0], column[moves[:, 1]]] = moves[:, 2]
            # Moves lead to rows of the flat table.
            ended = (np.maximum(table[0], 0) + base) * width << 1 | 1
            table = np.where(table >= 0, (table + base) * width << 1, ended)
            if not shared:
                table[:, own + 1] = -1
            tables.append(table.astype(np.int32 if table.max() < 1 << 31 else np.int64))
            roots.append(base)
            bits.append(np.log2(max(2, len(text))))
            base += states
        self.moves = (np.concatenate(tables) if tables else np.zeros((1, width), np.int64)).ravel()
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.targets = np.concatenate(targets) if keys else self.keys
        order = np.argsort(self.keys)
        self.keys, self.targets = self.keys[order], self.targets[order]
        self.roots = np.array(roots, dtype=np.int64) * width
        self.bits = np.array(bits)

    def _rarer(self, move: np.ndarray, state: np.ndarray, symbols: np.ndarray) -> None:
        """Puts the moves of rarer letters in the place of -1."""
        label, at = np.nonzero(move < 0)
        if len(at):
            key = state[label, at] * self.size + symbols[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            move[label, at] = np.where(self.keys[place] == key, self.targets[place], self.fresh[label, symbols[at]])

    def phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Phrases of every stretch of symbols (rows) in every language (columns)."""
        order = np.argsort([-len(s) for s in stretches], kind="stable")
        lengths = np.array([len(stretches[i]) for i in order])
        grid = np.zeros((int(lengths[0]), len(order)), dtype=self.symbol.dtype)
        for column, index in enumerate(order.tolist()):
            grid[: lengths[column], column] = stretches[index]
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        count = np.ones(state.shape, dtype=np.int32)
        for step in range(len(grid)):
            active = int(np.searchsorted(-lengths, -step, "left"))
            symbols = grid[step, :active]
            move = self.moves[state[:, :active] + (symbols if self.columns is None else self.columns[:, symbols])]
            if len(self.keys):
                self._rarer(move, state, symbols)
            count[:, :active] += move & 1
            state[:, :active] = move >> 1
        out = np.empty((len(order), len(self.labels)), dtype=np.int64)
        out[order] = count.T
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(label, score) of every text."""
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        stretches, owners = [], []
        lengths = np.zeros(len(texts), np.int64)
        for index, text in enumerate(texts):
            points = letters_of(text) if text else ()
            if len(points) == 0 or not np.any(points):
                continue
            lengths[index] = len(points)
            symbols = self.symbol[points]
            for begin in range(0, len(symbols), STRETCH):
                stretches.append(symbols[begin : begin + STRETCH])
                owners.append(index)
        if not stretches or not self.labels:
            return labels, scores
        counts = np.zeros((len(texts), len(self.labels)), np.int64)
        np.add.at(counts, owners, self.phrases(stretches))
        cost = counts * self.bits / np.maximum(lengths, 1)[:, None]
        best = cost.argmin(axis=1)
        # How far the best is from the others: its share when costs are turned into likelihoods per letter.
        with np.errstate(under="ignore"):
            likely = np.exp2(-4.0 * (cost - cost.min(axis=1, keepdims=True)))
        share = 1.0 / likely.sum(axis=1)
        for index in np.flatnonzero(lengths).tolist():
            labels[index], scores[index] = self.labels[best[index]], share[index]
        return labels, scores


def sample(docs: DataFrame, text: str, lang: str, learn: str, key: str) -> dict[str, list[str]]:
    """The bounded sample per label that the automata are built from."""
    order = Window.partitionBy("lang").orderBy("_h", "text")
    chosen = (
        docs.where(F.col(learn) & F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("_h"))
        .where(F.length("text") > 0)
        .withColumn("text", F.substring("text", 1, 2 * LETTERS))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= ROWS)
    )
    found = materialise(chosen.select("lang", "text", "_n"))
    n_labels = found.where("_n = 1").count()
    rows = found.where(F.col("_n") <= max(1, ROWS * FULL // max(FULL, n_labels))).orderBy("lang", "_n").collect()
    samples: dict[str, list[str]] = {}
    for row in rows:
        samples.setdefault(row["lang"], []).append(row["text"][:LETTERS])
    return samples


_parsers: dict[str, Parser] = {}


def predict(docs: DataFrame, learn: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    ``learn`` names a boolean column: where it is true the label may be learned from. A prediction
    reads the text only.
    """
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        docs[text].alias("text"),
        docs[lang].alias("lang"),
        F.coalesce(docs[learn], F.lit(False)).alias("learn"),
    )
    samples = rows.sparkSession.sparkContext.broadcast(sample(rows, "text", "lang", "learn", "doc_id"))
    fitted = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fitted not in _parsers:
            _parsers.clear()
            _parsers[fitted] = Parser(samples.value)
        parser = _parsers[fitted]
        for table, _ in W.batches_of(batches, "text", W.BATCH // 2):
            labels, scores = parser.judge(table.column("text").to_pylist())
            held_out = [not learned for learned in table.column("learn").to_pylist()]
            columns = [table.column("doc_id"), pa.array(held_out, pa.bool_()), pa.array(labels, pa.string()), pa.array(scores)]
            yield from pa.table(columns, names=["doc_id", "held_out", "lang_pred", "score"]).to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "learn").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
