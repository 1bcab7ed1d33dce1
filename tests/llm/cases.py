"""Documents that every operator has to cope with."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that some operator uses as names of its own results or steps.
CLASHING = ["row", "rep", "path", "score", "kept", "hash", "key", "id", "a", "b", "n", "rule"]


def prose(seed: int, words: int, lang: str = "en") -> str:
    """Invented prose; the same for the same arguments."""
    chance = random.Random(f"{seed}-{lang}")
    parts = {
        "en": ["th", "er", "ing", "on", "re", "at", "ed", "nd", "ou", "ea"],
        "de": ["ch", "ei", "sch", "ung", "en", "pf", "tz", "ge", "ä", "ß"],
    }[lang]
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "zu"]}[lang]
    out = []
    for _ in range(words):
        word = chance.choice(common) if chance.random() < 0.3 else "".join(chance.choices(parts, k=chance.randint(2, 4)))
        out.append(word + (".\n" if chance.random() < 0.05 else ""))
    return " ".join(out)


def documents() -> list[tuple]:
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, "one", "en", "s", 3),
        (5, "!!! 123 ###", None, "s", 11),
        (None, prose(6, 60), "en", None, None),
        (7, prose(7, 80), "en", "s", 1),
        (7, prose(7, 80), "en", "s", 1),
        (8, prose(7, 80), "en", "t", 1),
        (9, prose(9, 9000, "de"), "de", "t", 1),
        (10, prose(10, 120, "de"), "de", "t", 1),
        (11, "a b é́ Ünï 日本語 😀 <|endoftext|> I'll\x1cgo", "xx", "t", 1),
        (-12, "ha " * 70, "en", "t", 1),
    ]
    # Near copies and a passage that several documents share.
    base = prose(20, 200).split(" ")
    for step in range(6):
        words = list(base)
        for place in range(step):
            words[30 * place + 5] = f"changed{step}"
        rows.append((20 + step, " ".join(words), "en", "hot", 1))
    passage = prose(30, 60)
    rows += [(30 + i, f"{prose(31 + i, 50)} {passage} {prose(61 + i, 50)}", "en", "hot", 1) for i in range(4)]
    return rows


def frame(spark, rows=None):
    """The cases as a DataFrame over several partitions, with columns of clashing names."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return made.repartition(3).withColumns({name: F.lit("x") for name in CLASHING})


def rows_of(data) -> list[tuple]:
    return sorted((tuple(row) for row in data.collect()), key=repr)
