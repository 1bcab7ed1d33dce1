import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from answerlab.operators import bleu
from answerlab.operators.bleu import with_bleu


def expected_bleu(reference, candidate):
    """The definition, spelled out: geometric mean of clipped precisions times brevity."""
    pattern = re.compile(r"\w+|[^\w\s]")
    r, c = pattern.findall(reference.casefold()), pattern.findall(candidate.casefold())
    if not r or not c:
        return 0.0
    product = 1.0
    for n in (1, 2, 3, 4):
        cg, rg = (Counter(zip(*(side[k:] for k in range(n)))) for side in (c, r))
        hits = (cg & rg).total()
        product *= (hits or 0.1) / max(1, len(c) - n + 1)
    return min(1.0, math.exp(1 - len(r) / len(c))) * product**0.25


def scores(spark, pairs):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, reference string, candidate string")
    return [row.bleu for row in with_bleu(frame).orderBy("i").collect()]


def test_known_values(spark):
    line = "Rain fell on seven quiet roofs tonight."
    same, unrelated, empty, a, b, c, d, short = scores(
        spark,
        [
            (line, line.upper()),
            (line, "Nobody here drinks cold coffee without sugar"),
            (line, ""),
            ("one two three four five six", "one two three four five"),
            ("one two three four five", "one two three four"),
            ("one two three four five six", "one two three four"),
            ("p q r s t", "p q r s u"),
            ("x y z", "x"),
        ],
    )
    assert same == pytest.approx(1.0)
    assert 0.0 < unrelated < 0.1
    assert empty == 0.0
    assert (a, b, c) == tuple(pytest.approx(math.exp(x)) for x in (-0.2, -0.25, -0.5))
    assert d == pytest.approx(0.2**0.25)
    assert short == pytest.approx(expected_bleu("x y z", "x"))


def test_random_texts_agree_with_the_definition(spark):
    rng = random.Random(5)
    vocabulary = ["the", "cat", "Sat", "on", ",", "straße", "über", "x1", "-", "мат"]
    pairs = [
        tuple(" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(2)) for _ in range(300)
    ]
    # Long texts share more grams than are looked up one by one.
    numbers = [f"n{i}" for i in range(150)]
    for _ in range(20):
        reference = rng.choices(numbers, k=rng.randint(100, 600))
        start = rng.randint(0, 50)
        pairs.append((" ".join(reference), " ".join(reference[start:] + rng.choices(numbers, k=50))))
    for got, pair in zip(scores(spark, pairs), pairs):
        assert got == pytest.approx(expected_bleu(*pair), abs=1e-12)


def test_a_missing_side_has_no_score(spark):
    assert scores(spark, [(None, "a"), ("a", None)]) == [None, None]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pairs_side_by_side_do_not_mix(monkeypatch, piece):
    monkeypatch.setattr(bleu, "PIECE", piece)
    rng = random.Random(piece)
    sides = [[rng.choice([None, rng.choices("abc", k=rng.randint(0, 12))]) if i % 9 == 0 else rng.choices("abc", k=rng.randint(0, 12)) for i in range(200)] for _ in "rc"]
    got = bleu._matcher()(*[pa.array([["x"], *side], pa.list_(pa.string())).slice(1) for side in sides]).to_pylist()
    for found, r, c in zip(got, *sides, strict=True):
        grams = [[Counter(zip(*((side or [])[k:] for k in range(n)))) for side in (r, c)] for n in (1, 2, 3, 4)]
        assert found == [(a & b).total() for a, b in grams]
    assert bleu._matcher()(*[pa.array([], pa.list_(pa.string()))] * 2).to_pylist() == []
