import re

import pytest
from pyspark.sql import functions as F

from answerlab.functions import spans, text


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row.y for row in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


# Letters that Java's Unicode tables do not know yet; they cannot fold there.
NEWER = {0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66)}


def test_fold_strip_and_tokens_agree_with_python_on_every_character(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and c not in NEWER]
    frame = spark.createDataFrame([(c,) for c in chars], "c string").select(
        "c", text.fold(F.col("c")).alias("f"), text.is_blank(F.col("c")).alias("b"), text.strip(F.col("c")).alias("s")
    )
    for row in frame.collect():
        assert row.f == row.c.casefold()
        assert row.s == row.c.strip()
        assert row.b == (not row.c.strip())


def test_tokens_match_the_python_pattern(spark):
    texts = ["Hello, World! ΟΔΟΣ straße", "a_b-c 12.5%  x\ty", "", "  ", "'quoted' (x)", "né ǅ ﬁn 中文 🙂!"]
    expected = [re.findall(r"\w+|[^\w\s]", t.casefold()) for t in texts]
    assert column(spark, texts, text.tokens) == expected


def test_blank_is_null_or_white_space(spark):
    values = [None, "", "  ", "\n\t\x85　\x1f", " a "]
    assert column(spark, values, text.is_blank) == [True, True, True, True, False]
    assert column(spark, values, text.blank_to_null) == [None, None, None, None, " a "]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ("(7) Did_Not_Happen as far as known", "did_not_happen"),
        (" *3: Far_Future* - some day", "far_future"),
        ("12] nonsense", None),
        ("9- NONSENSE of a kind", "nonsense"),
        ("_obscure", "obscure"),
        ("`non\u017fense`", "nonsense"),
        ("far future", None),
        ("It is obscure", None),
        ("nonsensegroup", None),
        ("far_future_2", None),
        ("15", None),
        ("", None),
    ],
)
def test_extract_category(spark, answer, expected):
    assert column(spark, [answer], text.extract_category) == [expected]


def test_normalize_category(spark):
    labels = ["4. Obscure", " (2) FAR_future ", "did_not_happen", "10) a  b\nc", "correct"]
    assert column(spark, labels, text.normalize_category) == ["obscure", "far_future", "did_not_happen", "a b c", "correct"]


def test_category_accuracy(spark):
    rows = [("nonsense", "1. nonsense", 1.0), ("nonsense", "obscure", 0.0), ("nonsense", "what", 0.0), ("x", " \n", None), ("x", None, None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "c string, a string")
    got = [r.y for r in frame.select(text.category_accuracy(F.col("c"), F.col("a")).alias("y")).collect()]
    assert got == [r[2] for r in rows]


@pytest.mark.parametrize(
    "label, answer, expected",
    [
        ("did_not_happen", "True: no such event.", 1),
        ("far_future", "**TRUE**: far ahead.", 1),
        ("Far Future", "The answer is true.", 1),
        ("obscure", "False", 0),
        ("ordinary", "false: known answer.", 1),
        ("ordinary", "True", 0),
        ("nonsense", "untrue", 0),
        ("nonsense", "true_", 0),
        ("ordinary", "No boolean answer", 0),
        ("nonsense", "True or False", 0),
        (None, "FALSE", 1),
        ("obscure", None, None),
        ("obscure", "", None),
        ("obscure", "   ", None),
    ],
)
def test_boolean_accuracy(spark, label, answer, expected):
    frame = spark.createDataFrame([(label, answer)], "l string, a string")
    assert frame.select(text.boolean_accuracy(F.col("l"), F.col("a"))).first()[0] == expected


def test_prompt_and_embedding_text(spark):
    assert column(spark, ["$1 \\d"], lambda x: text.render_prompt("Q: [DOCUMENT]?", x)) == ["Q: $1 \\d?"]
    values = [None, " \x00 ", "a\x00b "]
    assert column(spark, values, text.embedding_text) == ["[EMPTY RESPONSE]", "[EMPTY RESPONSE]", "a b"]


def test_category_data_set_names(spark):
    names = [" MBZUAI ", "mbzuai/LaMini-Hallucination", "imdb", None]
    assert column(spark, names, text.is_category_dataset) == [True, True, False, False]


def test_message_span(spark):
    def span(names):
        content = [(n, None if n == "gap" else -1.0) for n in names]
        frame = spark.createDataFrame([(content,)], "c array<struct<token:string,logprob:double>>")
        return [(r.token, r.probability) for r in frame.select(spans.message_span(F.col("c")).alias("s")).first().s]

    e = pytest.approx(0.36787944117144233)
    assert span(["a", "<|message|>", "old", "<|message|>", "x", "gap", "<|end|>", "y"]) == [("x", e), ("gap", None)]
    assert span(["<|message|>", "x", "y"]) == [("x", e), ("y", e)]
    assert span(["<|message|>"]) == [] and span(["x"]) == [] and span([]) == []
    assert span(["<|message|>", "<|end|>", "x"]) == []
