"""Text functions as Spark columns. Blank, fold and word follow Python's ``str`` rules."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
_WS = r"\p{IsWhite_Space}\x1c-\x1f"
_WORD = r"\p{L}\p{N}_"

# A BLEU token is a run of word characters or one punctuation mark.
TOKEN_PATTERN = f"[{_WORD}]+|[^{_WORD}{_WS}]"

# The four answer categories whose expected boolean answer is True.
CATEGORIES = ("did_not_happen", "far_future", "nonsense", "obscure")
# Names under which the category data set is known.
CATEGORY_DATASET_NAMES = ("mbzuai", "mbzuai/lamini-hallucination")
# Fixed value: numbering in front of a category label, such as "4." or "(4)".
NUMBERING_PATTERN = rf"^\(?\p{{Nd}}+\)?[.:)\-]?[{_WS}]*"
# Fixed value: a category at the start of an answer; numbering and decoration may precede it.
LEADING_CATEGORY_PATTERN = (
    rf"""(?iu)^[{_WS}*_'"`]*(?:\(?\p{{Nd}}+\)?[.:)\-]?[{_WS}]*)?[{_WS}*_'"`]*"""
    rf"(did_not_happen|far_future|nonsense|obscure)(?![{_WORD}])"
)
# Prompt placeholder and the text embedded in place of an empty answer.
PLACEHOLDER = "[DOCUMENT]"
EMPTY_TEXT = "[EMPTY RESPONSE]"


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Where full case folding goes beyond ``lower``: one-to-one and one-to-many pairs."""
    ones, many = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        folded = char.casefold()
        if char.lower() == char and folded != char:
            (ones if len(folded) == 1 else many).append((char, folded))
    return "".join(a for a, _ in ones), "".join(b for _, b in ones), many


def _ranges(chars: str, gap: int = 40) -> str:
    """A short character class that covers the characters (and some between them)."""
    codes = sorted(map(ord, chars))
    runs = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - runs[-1][1] <= gap:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in runs) + "]"


_FOLD_FROM, _FOLD_TO, _FOLD_MANY = _fold_tables()
_FOLD_MANY = [(a, b) for a, b in _FOLD_MANY if a != "ß"]
_FOLD_PAIRS = "array(" + ", ".join(f"struct('{a}' AS a, '{b}' AS b)" for a, b in _FOLD_MANY) + ")"
_FOLD_CHARS = sorted(_FOLD_FROM + "".join(a for a, _ in _FOLD_MANY))
_FOLD_CLASS = _ranges("".join(_FOLD_CHARS))
# A letter beyond Latin text, or the one in it: looked for first, since many ranges take long for every letter.
_LOW, _HIGH = map(ord, _FOLD_CHARS[:2])
_FOLD_LIKELY = rf"[^\x00-\x{{{_LOW - 1:x}}}\x{{{_LOW + 1:x}}}-\x{{{_HIGH - 1:x}}}]"


def fold(text: Column) -> Column:
    """Full Unicode case folding.

    For most texts this is ``lower`` and the replacement of ß; the other letters whose
    folding differs from lower case are looked for first, and mapped only where they occur.
    """
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    replaced = F.aggregate(
        F.expr(_FOLD_PAIRS), lowered, lambda acc, pair: F.replace(acc, pair["a"], pair["b"])
    )
    occurs = lowered.rlike(_FOLD_LIKELY) & lowered.rlike(_FOLD_CLASS)
    return F.when(occurs, F.translate(replaced, _FOLD_FROM, _FOLD_TO)).otherwise(lowered)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def _from_first_letter(text: Column) -> Column:
    """The text without white space in front: empty where ``strip`` is, and the rest of the text is not looked at."""
    return F.ltrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null and for text made of white space only."""
    return F.coalesce(_from_first_letter(text) == "", F.lit(True))


def blank_to_null(text: Column) -> Column:
    """Null instead of a blank; any other text keeps its outer spaces."""
    return F.when(_from_first_letter(text) != "", text)


def tokens(text: Column) -> Column:
    """Case-folded words and single punctuation marks."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def words(text: Column) -> Column:
    """Runs of word characters, unchanged."""
    return F.regexp_extract_all(text, F.lit(f"[{_WORD}]+"), F.lit(0))


def normalize_category(label: Column) -> Column:
    """Trim, fold, collapse white space, drop leading numbering. Validity is a separate check."""
    collapsed = F.regexp_replace(fold(strip(label)), f"[{_WS}]+", " ")
    return F.regexp_replace(collapsed, NUMBERING_PATTERN, "")


def extract_category(answer: Column) -> Column:
    """The category an answer starts with, or null."""
    return F.nullif(fold(F.regexp_extract(answer, LEADING_CATEGORY_PATTERN, 1)), F.lit(""))


def is_category_dataset(name: Column) -> Column:
    return F.coalesce(fold(strip(name)).isin(*CATEGORY_DATASET_NAMES), F.lit(False))


def category_accuracy(category: Column, answer: Column) -> Column:
    """1.0 when the answer starts with the category, else 0.0; null for a blank answer."""
    hit = extract_category(answer).eqNullSafe(category)
    return F.when(~is_blank(answer), hit.cast("double"))


def boolean_accuracy(label: Column, answer: Column) -> Column:
    """1.0 when the only boolean word of the answer is the expected one; null for a blank answer."""
    return says_boolean(expected_boolean(label), answer)


def expected_boolean(label: Column) -> Column:
    """The boolean word that a label asks for."""
    joined = F.regexp_replace(fold(strip(label)), f"[{_WS}]+", "_")
    return F.when(joined.isin(*CATEGORIES), F.lit("true")).otherwise(F.lit("false"))


def says_boolean(expected: Column, answer: Column) -> Column:
    """The accuracy of :func:`boolean_accuracy` by the expected word."""
    # What stands before a word is looked at where the word is found, not at every letter.
    word = f"(?:true(?<![{_WORD}]true)|false(?<![{_WORD}]false))(?![{_WORD}])"
    said = F.regexp_extract_all(fold(answer), F.lit(word), F.lit(0))
    right = F.array_distinct(said) == F.array(expected)
    return F.when(~is_blank(answer), right.cast("double"))


def render_prompt(template: Column | str, text: Column) -> Column:
    """Put the text in place of every placeholder, literally."""
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(template, F.lit(PLACEHOLDER), text)


def embedding_text(text: Column) -> Column:
    """What is sent to an encoder: NULs become spaces, blanks become a placeholder."""
    cleaned = strip(F.replace(text, F.lit("\x00"), F.lit(" ")))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(EMPTY_TEXT))
