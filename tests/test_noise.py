import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from answerlab.functions import text as tx
from answerlab.operators import noise, thesaurus

TEXTS = [
    "Hello World! Happy new year 2021. Price: 123.45",
    "Wer gewann 1954 die Weltmeisterschaft im Fußball, straße 9a?",
    "a1b2c3",
    "12345",
    "",
    "Ünïcödé 🙂 tëxt ١٢٣ with digits and a much longer tail so that there are many edits to make here",
]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "question_id bigint, text string")


def test_fan_out_keeps_order_of_variants(questions):
    rows = noise.fan_out(questions, 18).where("question_id = 0").collect()
    assert [r.position for r in rows] == list(range(19))


@pytest.mark.parametrize("rate", [0.0, 0.09, 0.4, 1.0])
def test_typo_variants(questions, rate):
    rows = noise.typo_variants(questions, rate=rate, variants=4).collect()
    assert len(rows) == 5 * len(TEXTS)
    again = noise.typo_variants(questions.repartition(3), rate=rate, variants=4).collect()
    assert sorted(rows) == sorted(again)
    for row in rows:
        original, edited = TEXTS[row.question_id], row.text_edited
        if row.position == 0:
            assert edited == original
            continue
        # Digits stay, in place between the other parts.
        assert re.findall(r"\d+", edited) == re.findall(r"\d+", original)
        parts = [p for p in re.split(r"\d+", original)]
        letters = [sum(c.isalpha() for c in p) for p in parts]
        droppable = sum(max(n - 1, 0) for n in letters)
        edits = min(int(rate * sum(letters)), droppable)
        assert len(edited) == len(original) - edits
        lost = Counter(original) - Counter(edited)
        assert lost.total() == edits and all(c.isalpha() for c in lost)
        for before, after in zip(parts, re.split(r"\d+", edited)):
            assert not any(c.isalpha() for c in before) or any(c.isalpha() for c in after)


def test_variants_differ_from_each_other(questions):
    rows = noise.typo_variants(questions, variants=18).where("question_id = 5").collect()
    assert len({r.text_edited for r in rows}) > 15


@pytest.mark.parametrize("rate", [0.09, 0.3, 0.5])
def test_as_many_swaps_as_drops(spark, rate):
    """With letters that are all different, letters out of order tell the swaps."""
    value = "".join(chr(0x4E00 + i) for i in range(200))
    rows = noise.typo_variants(spark.createDataFrame([(1, value)], "question_id int, text string"), rate=rate, variants=6).collect()
    edits = int(rate * 200)
    for row in rows[1:]:
        out = row.text_edited
        swaps = sum(a > b for a, b in zip(out, out[1:]))
        held = [value.index(c) for c in out]
        runs = [i for i in range(len(held)) if i == 0 or sorted(held)[i] != sorted(held)[i - 1] + 1]
        possible = sum((b - a) // 2 for a, b in zip(runs, [*runs[1:], len(held)]))
        assert len(out) == 200 - edits and swaps == min(edits, possible)


def test_keys_do_not_depend_on_the_batch(spark):
    schema = "question_id bigint, text string"
    alone = noise.typo_variants(spark.createDataFrame([(1, TEXTS[5])], schema), variants=3).collect()
    mixed = spark.createDataFrame([(1, TEXTS[5]), (None, "another text")], schema).coalesce(1)
    assert sorted(alone) == sorted(noise.typo_variants(mixed, variants=3).where("question_id = 1").collect())


def compounded(value, edits, draws):
    """The definition, on a list of parts."""
    parts, digits = re.split(r"\d", value), re.findall(r"\d", value)
    for step in range(edits):
        letters = [[i for i, c in enumerate(p) if c.isalpha()] for p in parts]
        weights = [len(places) if len(places) > 1 else 0 for places in letters]
        if not sum(weights):
            break
        which, swap, drop = draws(step)
        own = next(i for i in range(len(parts)) if sum(weights[: i + 1]) > which % sum(weights))
        chars = list(parts[own])
        pairs = [i for i in range(len(chars) - 1) if chars[i].isalpha() and chars[i + 1].isalpha()]
        if pairs:
            i = pairs[swap % len(pairs)]
            chars[i], chars[i + 1] = chars[i + 1], chars[i]
        del chars[letters[own][drop % weights[own]]]
        parts[own] = "".join(chars)
    return "".join(p + d for p, d in zip(parts, [*digits, ""], strict=True))


@pytest.mark.parametrize("rate", [0.0, 0.09, 0.4, 1.0])
def test_compounding_edits(spark, rate):
    texts = [*TEXTS, "ab1cd2e3", "a b c d e f", "x" * 300 + "7" + "yz " * 50, "longer text 4 of many words " * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, text string")
    rows = noise.typo_variants(frame, rate=rate, variants=4, compounding=True).collect()
    again = noise.typo_variants(frame.repartition(3), rate=rate, variants=4, compounding=True).collect()
    assert len(rows) == 5 * len(texts) and sorted(rows) == sorted(again)
    for row in rows:
        original, edited = texts[row.question_id], row.text_edited

        def draws(step, row=row):
            digest = hashlib.md5(f"42|{row.question_id}|{row.position}|{step}".encode()).hexdigest()
            return [int(digest[i : i + 10], 16) for i in (0, 10, 20)]

        edits = int(rate * sum(c.isalpha() for c in original)) if row.position else 0
        assert edited == compounded(original, edits, draws)
        # What held before: digits stay, a part keeps a letter, only letters go, one an edit as far as they last.
        assert re.findall(r"\d", edited) == re.findall(r"\d", original)
        parts = re.split(r"\d", original)
        droppable = sum(max(sum(c.isalpha() for c in p) - 1, 0) for p in parts)
        assert len(edited) == len(original) - min(edits, droppable)
        assert all(c.isalpha() for c in Counter(original) - Counter(edited))
        for before, after in zip(parts, re.split(r"\d", edited), strict=True):
            assert not any(c.isalpha() for c in before) or any(c.isalpha() for c in after)


def test_parts_are_drawn_by_their_letters(spark):
    """Chi-square of the first edit over parts of 2, 4, 8, 16 and 30 letters, and of the dropped place."""
    parts = ["ab", "cdef", "ghijklmn", "opqrstuvwxyzABCD", "EFGHIJKLMNOPQRSTUVWXYZabcdefgh"]
    value, letters = "1".join(["x", *parts]), 60
    questions = spark.createDataFrame([(i, value) for i in range(400)], "question_id int, text string")
    rows = noise.typo_variants(questions, rate=1.01 / 61, variants=60, compounding=True).where("position > 0").collect()
    hit = Counter()
    for row in rows:
        after = row.text_edited.split("1")
        assert after[0] == "x"
        lost = [i for i, (a, b) in enumerate(zip(["x", *parts], after, strict=True)) if len(b) < len(a)]
        assert len(lost) == 1
        hit[lost[0] - 1] += 1
    expected = [len(rows) * len(p) / letters for p in parts]
    # 4 degrees of freedom: 18.5 is exceeded once in a thousand.
    assert sum((hit[i] - e) ** 2 / e for i, e in enumerate(expected)) < 18.5
    plain = spark.createDataFrame([(i, "abcdefghij") for i in range(400)], "question_id int, text string")
    rows = noise.typo_variants(plain, rate=0.1, variants=60, compounding=True).where("position > 0").collect()
    gone = Counter(next(iter(set("abcdefghij") - set(r.text_edited))) for r in rows)
    # 9 degrees of freedom; a swap before the drop only exchanges neighbours.
    assert sum((gone[c] - len(rows) / 10) ** 2 / (len(rows) / 10) for c in "abcdefghij") < 27.9


def test_rate_is_checked(questions):
    with pytest.raises(ValueError):
        noise.typo_variants(questions, rate=1.5)


def test_synonym_variants(spark):
    questions = spark.createDataFrame(
        [(1, "Running dogs run; the runner will run and jump."), (2, "no verbs here")], "question_id int, text string"
    )
    lexicon = spark.createDataFrame(
        [("run", "VERB", ["sprint", "dash"]), ("run", "VERB", ["dash"]), ("jump", "VERB", ["leap"]), ("dogs", "NOUN", ["hounds"]), ("will", "VERB", [])],
        "word string, pos string, synonyms array<string>",
    )
    rows = noise.synonym_variants(questions, lexicon, sample_size=2, variants=6).collect()
    by = {(r.question_id, r.position): r for r in rows}
    assert len(by) == 14
    for (question, position), row in by.items():
        if question == 2 or position == 0:
            assert row.replaced == 0 and row.text_edited == {1: "Running dogs run; the runner will run and jump.", 2: "no verbs here"}[question]
        else:
            # Whole words only, everywhere, the same synonym each time.
            assert row.text_edited in {
                f"Running dogs {s}; the runner will {s} and leap." for s in ("sprint", "dash")
            }
    one = noise.synonym_variants(questions, lexicon, sample_size=1, variants=6).where("question_id = 1 and position > 0")
    assert {r.replaced for r in one.collect()} == {1}


def test_synonyms_inside_words(spark):
    questions = spark.createDataFrame([(1, "cat scatter Cat concat"), (2, None), (3, "")], "question_id int, text string")
    lexicon = spark.createDataFrame([("cat", "VERB", ["scatter"]), ("scatter", "VERB", ["cat", "dog"])], "word string, pos string, synonyms array<string>")
    rows = noise.synonym_variants(questions, lexicon, sample_size=2, variants=40, whole_words=False).collect()
    found = {}
    for row in rows:
        if row.question_id == 1 and row.position:
            found.setdefault(row.replaced, set()).add(row.text_edited)
        elif row.question_id != 1 or not row.position:
            assert row.text_edited == {1: "cat scatter Cat concat", 2: None, 3: ""}[row.question_id] and row.replaced == 0
    assert list(found) == [2]
    # Any two of cat, Cat and scatter, either first; the second of two numbers has no synonym of cat.
    made = set()
    options = {"cat": ["scatter", None], "Cat": ["scatter", None], "scatter": ["cat", "dog"]}
    for one in options:
        for two in set(options) - {one}:
            for s1 in options[one]:
                for s2 in options[two]:
                    done = "cat scatter Cat concat"
                    for word, synonym in ((one, s1), (two, s2)):
                        done = done.replace(word, word if synonym is None else synonym)
                    made.add(done)
    assert found[2] <= made and len(found[2]) > 4
    one = noise.synonym_variants(questions, lexicon, sample_size=1, variants=9, whole_words=False).where("position > 0 AND question_id = 1")
    assert {r.text_edited for r in one.collect()} <= {"scatter sscatterter Cat conscatter", "cat cat Cat concat", "cat scatter scatter concat"}


ENTRY = """{"meta": {"id": "run", "syns": [["dash", "sprint"], ["flow"]]}, "def": [{"sseq": [
 [["sense", {"dt": [], "syn_list": [[{"wd": "race"}, {"wd": "dash"}, {"wvrs": []}]]}], ["pseq", [["sense", {"syn_list": [[{"wd": "no"}]]}]]]],
 [["sense", {"dt": []}], ["bs", {"sense": {}}]]]}, {}]}"""


@pytest.mark.parametrize(
    "payload, expected",
    [
        ("[" + ENTRY + "]", ["dash", "flow", "race", "sprint"]),
        ("[" + ENTRY + ', "text", {"meta": {"syns": [["aaa"]]}}, {}]', ["aaa", "dash", "flow", "race", "sprint"]),
        ('["rung", "ruin"]', []),
        ('["rung", ' + ENTRY + "]", []),
        ("[]", []),
        ("{}", []),
        ("not json", []),
        (None, []),
        ('[{"meta": {"syns": [["l","k","j","i","h","g","f","e","d","c","b","a"]]}}]', list("abcdefghij")),
    ],
)
def test_thesaurus(spark, payload, expected):
    frame = spark.createDataFrame([("w", payload)], "word string, payload string")
    assert thesaurus.synonym_table(frame).first().synonyms == expected


def test_words_helper(spark):
    frame = spark.createDataFrame([("a-b ç_1",)], "t string")
    assert frame.select(tx.words(F.col("t"))).first()[0] == ["a", "b", "ç_1"]


def test_variants_made_side_by_side_are_those_made_alone(monkeypatch):
    import pandas as pd

    texts = ["", "a", "ab1", "12 34", "one two 3 four five 67 eight nine", "straße 5 über " * 40, "x" * 300, "a1b2c3 " * 60]
    frame = pd.DataFrame({"k": [str(i) for i in range(len(texts))], "text": texts})
    made = []
    for together in (1, 500, 1 << 18):
        monkeypatch.setattr(noise, "_TOGETHER", together)
        made += [pd.concat(noise._typo_mapper(3, rate, 18, "k")(iter([frame]))).reset_index(drop=True) for rate in (0.09, 1.0)]
    for one, other in zip(made, made[2:]):
        assert one.equals(other)
    assert len(made[0]) == 19 * len(texts)
