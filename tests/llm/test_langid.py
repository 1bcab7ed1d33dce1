"""Language identification: the automaton against plain search, whole texts, held-out accuracy."""

import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlab.llm import langid


def plain_phrases(text, learned):
    """Longest phrases of ``text`` that occur in ``learned``; a letter that ends one starts the next."""
    count, phrase = 1, ""
    for letter in text:
        if phrase + letter in learned:
            phrase += letter
        else:
            count += 1
            phrase = letter if letter in learned else ""
    return count


def test_phrases_equal_plain_search():
    chance = random.Random(3)
    samples = {"x": ["".join(chance.choices("abc ", k=300))], "y": ["".join(chance.choices("bcd ", k=200))]}
    parser = langid.Parser(samples)
    texts = ["".join(chance.choices("abcde ", k=chance.randint(1, 80))) for _ in range(60)]
    read = [langid.letters_of(t) for t in texts]
    keep = [i for i, points in enumerate(read) if len(points)]
    found = parser.phrases([parser.symbol[read[i]] for i in keep])
    for row, i in zip(found, keep, strict=True):
        text = "".join(chr(p) if p else " " for p in read[i])
        for column, label in enumerate(parser.labels):
            learned = "".join(chr(p) if p else " " for p in langid.letters_of(samples[label][0])) + " "
            assert row[column] == plain_phrases(text, learned)


def test_letters():
    assert langid.letters_of("Ab1 c!\n").tolist() == [97, 98, 0, 99, 0]
    assert not np.any(langid.letters_of("12 !?"))


@pytest.fixture(scope="module")
def rows():
    return [(i, cases.prose(i, 60, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", "s", 1) for i in range(300)]


def test_held_out_accuracy(spark, rows):
    docs = cases.frame(spark, rows).withColumn("learn", F.col("doc_id") % 5 != 1)
    found = langid.predict(docs, "learn").collect()
    right = {row[0]: row[2] for row in rows}
    held = [row for row in found if row["held_out"]]
    assert len(held) == 60 and len(found) == 300
    assert sum(row["lang_pred"] == right[row["doc_id"]] for row in held) >= 58
    assert all(0 <= row["score"] <= 1 for row in found)


def test_odd_documents(spark, rows):
    docs = cases.frame(spark, rows[:40] + [(1000 + (r[0] or 0), *r[1:]) for r in cases.documents()])
    found = {row["doc_id"]: row for row in langid.predict(docs.withColumn("learn", F.col("doc_id") < 1000), "learn").collect()}
    assert [found[1000 + i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und"] * 4
    assert found[1009]["lang_pred"] == "de" and found[1007]["lang_pred"] == "en"
    assert found[1]["held_out"] is False and found[1001]["held_out"] is True


def test_without_labels(spark):
    docs = cases.frame(spark).withColumn("learn", F.lit(None).cast("boolean"))
    found = langid.predict(docs, "learn").collect()
    assert {row["lang_pred"] for row in found} == {"und"} and {row["score"] for row in found} == {0.0}
    assert langid.predict(cases.frame(spark, []).withColumn("learn", F.lit(True)), "learn").collect() == []


def test_stretches_count_together(monkeypatch):
    parser = langid.Parser({"x": ["abcabc"], "y": ["xyzxyz"]})
    long = "abc " * 5000
    assert parser.judge([long])[0] == ["x"]
    monkeypatch.setattr(langid, "STRETCH", 10)
    assert parser.judge([long, "zyx", None])[0] == ["x", "y", "und"]


def test_letters_of_many_scripts():
    scripts = {"ru": (0x430, 32), "el": (0x3B1, 24), "zh": (0x4E00, 900), "ja": (0x5200, 700), "ko": (0xAC00, 800), "en": (0x61, 26)}

    def text(label, seed, length):
        first, size = scripts[label]
        chance = random.Random(f"{label}-{seed}")
        words = ["".join(chr(first + int(size * chance.random() ** 2)) for _ in range(4)) for _ in range(length)]
        return " ".join(words)

    samples = {label: [text(label, seed, 150) for seed in range(6)] for label in scripts}
    samples["zh2"] = ["".join(reversed(t)) for t in samples["zh"]]
    parser = langid.Parser(samples)
    found = [text(label, 99, 40) for label in scripts]
    assert [label[:2] for label in parser.judge(found)[0]] == list(scripts)
    texts = found + samples["zh2"][:1] + samples["ko"][:1] + ["\u0e01\u0e02 " * 5]
    counts = parser.phrases([parser.symbol[langid.letters_of(t)] for t in texts])
    for row, t in zip(counts, texts, strict=True):
        read = "".join(chr(p) if p else " " for p in langid.letters_of(t))
        for column, label in enumerate(parser.labels):
            parts = [langid.letters_of(s) for s in samples[label]]
            learned = "".join("".join(chr(p) if p else " " for p in part) + " " for part in parts)
            assert row[column] == plain_phrases(read, learned), label


def test_more_labels_than_learn_in_full(spark, monkeypatch):
    monkeypatch.setattr(langid, "FULL", 3)
    monkeypatch.setattr(langid, "ROWS", 4)
    rows = [(i, chr(0x4E00 + i % 450) * 3 + f" {'abc'[i % 3]}", f"l{i % 450}", "s", 1) for i in range(900)]
    docs = cases.frame(spark, rows).withColumn("learn", F.lit(True))
    assert all(row["lang_pred"] == f"l{row['doc_id'] % 450}" for row in langid.predict(docs, "learn").collect())
