"""Lists written as Python literals, against Python's own reader."""

import ast
import random
import sys

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from answerlab.sources import literals
from answerlab.sources.literals import decode_list


def decoded(spark, literals):
    frame = spark.createDataFrame(list(enumerate(literals)), "i int, x string")
    rows = frame.select("i", decode_list(F.col("x"), F.col("i")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def written(value, chance):
    """A literal of one text, in one of the ways to write it."""
    quote = chance.choice(["'", '"'])
    kind = chance.randrange(6)
    if kind == 0:
        return repr(value)
    if kind == 1:
        escaped = value.replace("\\", "\\\\").replace(quote, "\\" + quote).replace("\n", "\\n").replace("\r", "\\r")
        return chance.choice(["", "u", "U"]) + quote + escaped.replace("\0", "\\0") + quote
    if kind == 2:
        codes = [f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04X}" if ord(c) < 65536 else f"\\U{ord(c):08x}" for c in value]
        return quote + "".join(codes) + quote
    if kind == 3 and not set(value) & {"\\", quote, "\r", "\n", "\0"}:
        return chance.choice("rR") + quote + value + quote
    if kind == 4:
        half = len(value) // 2
        return f"{value[:half]!r} {chance.choice(['', chr(10), '  # note, it is ]' + chr(10)])} {value[half:]!r}"
    escaped = value.replace("\\", "\\\\").replace(quote, "\\" + quote).replace("\r", "\\r").replace("\0", "\\000")
    return quote * 3 + escaped + quote * 3


def listed(values, chance):
    body = f"{chance.choice(['', ' ', chr(10)])},".join("None" if v is None else written(v, chance) for v in values)
    if len(values) == 1 or values and chance.random() < 0.3:
        body += ","
    return f"({body})" if chance.random() < 0.4 else f" [ {body} ]"


TEXTS = st.lists(st.none() | st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXTS, min_size=20, max_size=40), st.integers(0, 1 << 30))
def test_any_texts(spark, lists, seed):
    chance = random.Random(seed)
    literals = [listed(values, chance) for values in lists]
    assert [list(ast.literal_eval(x.strip())) for x in literals] == lists
    assert decoded(spark, literals) == lists


def test_every_character(spark):
    """Also private ones, as they are and by repr, alone and between quotes and backslashes."""
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    parts = ["".join(chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    texts = [f"'{p}\\" for p in parts] + [f'{p}"' for p in parts] + parts
    literals = [repr([t]) for t in texts]
    literals += [listed([t, None, t[::-1]], random.Random(i)) for i, t in enumerate(parts)]
    assert decoded(spark, literals) == [list(ast.literal_eval(x.strip())) for x in literals]


FORMS = [
    "['a' 'b']",
    "[u'a', r'b', R\"c\\n\", U'd\\n']",
    "['\\N{LATIN SMALL LETTER A}\\N{grinning face}\\N{CJK UNIFIED IDEOGRAPH-4E00}']",
    "['\\d \\. \\\n x']",
    "['''it's \"here\" ''', \"\"\"two\nlines\"\"\", '''''', '']",
    "['a' # no ] end\n , 'b']",
    "['a' \\\n 'b',]",
    "['\\0\\12\\1234\\777']",
    "(None, 'x',)",
    "('a', 'b')",
    "('a',)",
    "[]",
    "[ ]",
    "()",
    "['\ue000\ue001\ue002\ue003\\\\\\'']",
    "['], [', \"', '\", '#', '\\\\']",
    "[" + "'\\\\\\'' " * 20_000 + ", '" + "long \\n \\' text" * 20_000 + "']",
    "[" + ", ".join(f"'item {i}'" for i in range(20_000)) + "]",
    "['" + "x" * 2_000_000 + "']",
]


def test_forms(spark):
    assert decoded(spark, FORMS) == [list(ast.literal_eval(x)) for x in FORMS]


def test_values_keep_their_spelling(spark):
    literals = ["[1, -2.50, +3, 1_000, 1e5, .5, 7., True, False, None, 0, 00]", "[12.5e-3]"]
    assert decoded(spark, literals) == [["1", "-2.50", "+3", "1_000", "1e5", ".5", "7.", "True", "False", None, "0", "00"], ["12.5e-3"]]


def test_blank_and_null(spark):
    assert decoded(spark, [None, "", " \n\t"]) == [[], [], []]


BAD = [
    "['a',,]", "[,]", "['a'", "('x')", "a", "['a']]", "[b'x']", "[x]", "{'a': 1}", "['a' None]", "[1 2]", "['a\nb']", "['\\x1']",
    "['\\u12']", "['\\U00110000']", "['\\N{no such name}']", "['a\x00b']", "['a', 'b'] x", "[['a']]", "[('a',)]", "[01]", "[1__0]",
    "[None'a']", "['a'b]", "'a'", "['''a''''b]", "[r'\\']", "[Nonex]", "[\xa0'a']", "[f'a']",
]


@pytest.mark.parametrize("bad", BAD)
def test_no_list(spark, bad):
    with pytest.raises(Exception, match="row 0: .*list"):
        decoded(spark, [bad])


def test_a_string_is_cut_out_once(spark):
    made = literals._content(F.col("w"), F.lit(""), F.lit(""))._jc.toString()
    assert made.count("substring(w") == 1
