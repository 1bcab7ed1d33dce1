"""Perturbed variants of questions: typos and synonyms, the same on every run.

Position 0 is the clean text; positions 1.. are variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from answerlab.functions import text
from answerlab.operators.sampling import draw_order

# Perturbed variants per question and the share of letters edited in each.
VARIANTS = 18
TYPO_RATE = 0.09
_OUTPUT_CHARS = 4_000_000
#: Characters of the variants of one text that are made side by side.
_TOGETHER = 1 << 18


def fan_out(questions: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """One row per question and position 0..variants, in place (no shuffle)."""
    return questions.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(variants))))


def _typo_mapper(seed: int, rate: float, variants: int, key: str):
    """A mapInPandas function. It holds all it needs, so workers need not import this package.

    The variants of a text are made side by side: a text is short, and then calls cost more than letters.
    """
    most, most_together = _OUTPUT_CHARS, _TOGETHER

    def letters_and_parts(codes):
        """Positions of the letters and the text part each is in; digit runs separate parts."""
        import numpy as np

        used, place = np.unique(codes, return_inverse=True)
        chars = [chr(code) for code in used]
        letter = np.array([char.isalpha() for char in chars], dtype=bool)[place]
        part = np.cumsum(np.array([char.isdecimal() for char in chars], dtype=bool)[place])
        letters = np.flatnonzero(letter)
        return letters, part[letters]

    def hashed(places, coefficients):
        prime = 2_147_483_647
        a, b, c = coefficients
        return ((a * places % prime + b) * places % prime + c) % prime

    def edited(codes, letters, begins_of_parts, edits, coefficients):
        """(code points, how many of them each has) of the variants with these rows of coefficients, side by side."""
        import numpy as np

        none = np.iinfo(np.int64).max
        count, size = len(coefficients), len(letters)
        variant = np.arange(count)[:, None]
        # Letters in the order of their hashes, equal ones by place. Only the first ones of an order are needed.
        keys = (hashed(letters, coefficients.T[:, :, None]) << 32) + np.arange(size)

        def first_ones(keys, most):
            """Marks of the ``most`` smallest keys of each variant, or of all there are."""
            marks = np.zeros(keys.shape, dtype=bool)
            if 0 < most < size:
                marks[variant, np.argpartition(keys, most - 1, axis=1)[:, :most]] = True
            else:
                marks[:] = most > 0
            return marks & (keys != none)

        # The last letter of each part in this order stays, so no part loses all its letters.
        free = keys.copy()
        free[variant, np.maximum.reduceat(keys, begins_of_parts, axis=1) & 0xFFFFFFFF] = none
        dropped = first_ones(free, edits)
        # Letters that stay, in runs of neighbours; every second one of a run and its follower are a pair.
        own, index = np.nonzero(~dropped)
        staying = letters[index]
        begins = np.ones(len(staying), dtype=bool)
        begins[1:] = (staying[1:] != staying[:-1] + 1) | (own[1:] != own[:-1])
        places = np.arange(len(staying))
        offset = places - np.maximum.accumulate(np.where(begins, places, 0))
        leads = (offset & 1 == 0) & np.append(~begins[1:], False)
        leaders = np.full(keys.shape, none)
        leaders[own[leads], index[leads]] = keys[own[leads], index[leads]]
        own, index = np.nonzero(first_ones(leaders, edits))
        first = letters[index]
        out = np.tile(codes, (count, 1))
        out[own, first], out[own, first + 1] = codes[first + 1], codes[first]
        kept = np.ones(out.shape, dtype=bool)
        kept[:, letters] = ~dropped
        return out[kept], kept.sum(axis=1)

    def variants_of(question, value):
        import hashlib

        import numpy as np

        codes = np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32)
        letters, parts = letters_and_parts(codes) if len(codes) else ((), ())
        edits = int(rate * len(letters))
        yield 0, value
        if not edits:
            yield from ((position, value) for position in range(1, variants + 1))
            return
        begins_of_parts = np.flatnonzero(np.diff(parts, prepend=-1))
        together = max(1, most_together // len(codes))
        for begin in range(1, variants + 1, together):
            positions = range(begin, min(begin + together, variants + 1))
            digests = [hashlib.md5(f"{seed}|{question}|{position}".encode()).hexdigest() for position in positions]
            coefficients = np.array([[int(digest[i : i + 7], 16) for i in (0, 7, 14)] for digest in digests])
            out, sizes = edited(codes, letters, begins_of_parts, edits, coefficients)
            text, end = out.tobytes().decode("utf-32-le"), 0
            for position, chars in zip(positions, sizes.tolist()):
                yield position, text[end : end + chars]
                end += chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for question, value in zip(batch[key], batch["text"]):
                for position, variant in variants_of(question, value):
                    rows.append((question, position, variant))
                    size += len(variant)
                if size > most:
                    yield pd.DataFrame(rows, columns=[key, "position", "text_edited"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[key, "position", "text_edited"])

    return run


def _compounding_mapper(seed: int, rate: float, variants: int, key: str):
    """As above, for edits that act one after the other. Every edit takes steps in the logarithm of the text's length."""
    most = _OUTPUT_CHARS

    class Sums:
        """Whole numbers by place, with their running sums: a tree of prefix sums."""

        def __init__(self, values):
            self.size = len(values)
            self.tree = [0, *values]
            self.top = 1 << self.size.bit_length() >> 1
            for place in range(1, self.size + 1):
                above = place + (place & -place)
                if above <= self.size:
                    self.tree[above] += self.tree[place]

        def copy(self):
            other = object.__new__(Sums)
            other.size, other.top, other.tree = self.size, self.top, self.tree[:]
            return other

        def add(self, place, value):
            place += 1
            while place <= self.size:
                self.tree[place] += value
                place += place & -place

        def before(self, place):
            total = 0
            while place:
                total += self.tree[place]
                place &= place - 1
            return total

        def find(self, rank):
            """The first place whose running sum, itself included, exceeds ``rank``."""
            place, step = 0, self.top
            while step:
                ahead = place + step
                if ahead <= self.size and self.tree[ahead] <= rank:
                    place, rank = ahead, rank - self.tree[ahead]
                step >>= 1
            return place

    def prepared(value):
        letter = [int(char.isalpha()) for char in value]
        part, parts, begins = [], 0, [0]
        for place, char in enumerate(value):
            # Every digit begins a part, so a part is letters and signs without a digit between them.
            if char.isdecimal():
                parts += 1
                begins.append(place)
            part.append(parts)
        counts = [0] * (parts + 1)
        for place, own in enumerate(part):
            counts[own] += letter[place]
        pairs = [int(a and b) for a, b in zip(letter, [*letter[1:], 0])]
        weights = Sums([count if count > 1 else 0 for count in counts])
        return letter, [*begins, len(value)], counts, weights, Sums(letter), Sums(pairs)

    def edited(value, state, edits, draws):
        letter, begins, counts, weights, letters, pairs = state
        counts, weights, letters, pairs = counts[:], weights.copy(), letters.copy(), pairs.copy()
        chars = list(value)
        size = len(chars)
        after, ahead = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size
        left = sum(count for count in counts if count > 1)
        for step in range(edits):
            if not left:
                break
            which, swap, drop = draws(step)
            # A part is drawn by the letters it still has; parts with a single one are left alone.
            own = weights.find(which % left)
            begin, end = begins[own], begins[own + 1]
            held = pairs.before(begin)
            found = pairs.before(end) - held
            if found:
                first = pairs.find(held + swap % found)
                second = after[first]
                chars[first], chars[second] = chars[second], chars[first]
            gone = letters.find(letters.before(begin) + drop % counts[own])
            before, next_ = ahead[gone], after[gone]
            alive[gone] = False
            letters.add(gone, -1)
            follows = next_ < size and letter[next_]
            if follows:
                pairs.add(gone, -1)
            if before >= 0 and letter[before] and not follows:
                pairs.add(before, -1)
            if before >= 0:
                after[before] = next_
            if next_ < size:
                ahead[next_] = before
            counts[own] -= 1
            lost = 1 if counts[own] > 1 else 2
            weights.add(own, -lost)
            left -= lost
        return "".join(char for char, stays in zip(chars, alive) if stays)

    def variants_of(question, value):
        import hashlib

        yield 0, value
        state = prepared(value)
        edits = int(rate * sum(state[2]))
        for position in range(1, variants + 1):

            def draws(step, position=position):
                digest = hashlib.md5(f"{seed}|{question}|{position}|{step}".encode()).hexdigest()
                return int(digest[:10], 16), int(digest[10:20], 16), int(digest[20:30], 16)

            yield position, edited(value, state, edits, draws) if edits else value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for question, value in zip(batch[key], batch["text"]):
                for position, variant in variants_of(question, value):
                    rows.append((question, position, variant))
                    size += len(variant)
                if size > most:
                    yield pd.DataFrame(rows, columns=[key, "position", "text_edited"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[key, "position", "text_edited"])

    return run


def typo_variants(
    questions: DataFrame,
    seed: int = 42,
    rate: float = TYPO_RATE,
    variants: int = VARIANTS,
    key: str = "question_id",
    compounding: bool = False,
) -> DataFrame:
    """``(key, position, text_edited)``: the clean text and its typo variants.

    With ``compounding`` the ``int(rate * letters)`` edits of a variant act one after the other, each on the text that the
    last one left. Digits cut a text into parts. An edit draws a part with at least two letters, in proportion to the letters
    it still has; there it swaps two neighbouring letters, if any stand together, and then drops a letter. Where
    no part has two letters left the variant is done.

    Without, all sites are drawn at once from the clean text, which is some ten times faster.
    ``int(rate * letters)`` edits per variant. Each drops a letter and swaps two neighbouring letters that stay;
    no letter takes part in two swaps. Digits never move, and every text part keeps a letter. So there are as many
    drops as edits, or as many as leave every part a letter, and as many swaps as edits, or as many as the runs
    of letters that stay have pairs (half their length, rounded down). Sites are drawn by a hash of seed, key (as
    text) and position, so they do not depend on batches or retries.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    kind = questions.schema[key].dataType.simpleString()
    # The key travels as text: batches with a missing number would turn the others into fractions.
    asked = questions.where("text is not null").select(F.col(key).cast("string").alias(key), "text")
    edited = asked.mapInPandas(
        (_compounding_mapper if compounding else _typo_mapper)(seed, rate, variants, key), f"`{key}` string, position int, text_edited string"
    )
    return edited.withColumn(key, F.col(key).cast(kind))


def synonym_variants(
    questions: DataFrame,
    lexicon: DataFrame,
    sample_size: int = 2,
    seed: int = 42,
    variants: int = VARIANTS,
    pos: str = "VERB",
    key: str = "question_id",
    whole_words: bool = True,
) -> DataFrame:
    """``(key, position, text_edited, replaced)``: up to ``sample_size`` words swapped for a synonym.

    Words whose lexicon entry (word, pos, synonyms) has the wanted part of speech are
    candidates. Whole words are replaced, everywhere in the text.

    Without ``whole_words`` one picked word after the other, in the order they were drawn, is replaced wherever its
    letters stand, inside other words and in what was put in before; the number of its synonym is drawn below the number
    of picked words, and a word with fewer synonyms than that stays. ``replaced`` counts the picked words.
    """
    # One entry for each word: the synonyms of repeated entries are put together.
    usable = (
        lexicon.where((F.col("pos") == pos) & (F.size("synonyms") > 0))
        .groupBy("word")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))).alias("synonyms"))
    )
    # Distinct words per question are found in the row, so a frequent word counts once per text.
    candidates = questions.select(
        key, F.explode(F.array_distinct(text.words(F.col("text")))).alias("token")
    ).withColumn("word", F.lower("token"))
    # Spark checks the size of the lexicon before it broadcasts it. The list gathered per
    # question holds words of one text, so it is never larger than that text.
    known = (
        candidates.join(usable, "word")
        .groupBy(key)
        .agg(F.collect_list(F.struct("token", "synonyms")).alias("known"))
    )
    # Words and gaps in turn; only words are looked up.
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    fanned = fan_out(questions.join(known, key, "left").select(key, "text", "known", pieces.alias("pieces")), variants)
    ordered = F.transform(
        "known",
        lambda w: F.struct(
            draw_order(seed, F.concat_ws("|", F.col(key), F.col("position"), w["token"])).alias("draw"),
            w["token"].alias("token"),
            w["synonyms"].alias("synonyms"),
        ),
    )

    drawn = F.when(F.col("position") > 0, F.slice(F.sort_array(ordered), 1, sample_size))

    def choose(w):
        number = F.conv(F.substring(F.md5(F.concat(w["draw"], F.lit("choice"))), 1, 7), 16, 10).cast("bigint")
        bound = F.size(w["synonyms"]) if whole_words else F.size(drawn)
        chosen = F.get(w["synonyms"], F.pmod(number, bound).cast("int"))
        return F.struct(w["token"].alias("token"), chosen.alias("synonym"))

    fanned = fanned.withColumn("swaps", F.transform(drawn, choose))
    replaced = F.coalesce(F.size("swaps"), F.lit(0)).alias("replaced")
    if not whole_words:
        put_in = lambda held, swap: F.replace(held, swap["token"], F.coalesce(swap["synonym"], swap["token"]))
        everywhere = F.aggregate(F.coalesce("swaps", F.array().cast(fanned.schema["swaps"].dataType)), F.col("text"), put_in)
        return fanned.select(key, "position", everywhere.alias("text_edited"), replaced)
    swapped = F.transform(
        "pieces",
        lambda piece: F.coalesce(
            F.get(F.filter("swaps", lambda swap: swap["token"] == piece), F.lit(0))["synonym"], piece
        ),
    )
    edited = F.when(F.coalesce(F.size("swaps"), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(swapped, ""))
    return fanned.select(key, "position", edited.alias("text_edited"), replaced)
