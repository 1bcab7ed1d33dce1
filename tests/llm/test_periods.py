"""Periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest

from answerlab.llm import periods
from answerlab.llm import words as W


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=6, times=4):
    """(start, length, period) by comparing every word with the one q before."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(least, times * q):
                    found.setdefault((i, length), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def planted(doc_id, text):
    words = cut(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g = h // 10
        a, n = g % len(words), len(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, words):
    runs = plain_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)]
    return (doc_id, len(words), len(runs), *told, *digest)


def rows_with_runs():
    chance = random.Random(9)
    rows = cases.documents()
    rows += [(100 + i, " ".join(chance.choices("ab", [i % 5 + 1, 1], k=80)), "en", "s", 1) for i in range(40)]
    rows += [(200 + i, "x y " + f"{cases.prose(i, i)} " * 9 + "z", "en", "s", 1) for i in range(1, 30)]
    rows += [(300, "a b a b a b a", "en", "s", 1), (301, "a b " * 4, "en", "s", 1), (302, "a " * 5, "en", "s", 1)]
    rows += [(303, "a " * 6, "en", "s", 1), (304, "c " + "a a b " * 5 + "a a a a a a b", "en", "s", 1)]
    # Ids that the plant changes.
    rows += [(i, cases.prose(i, 40 + i % 90), "en", "s", 1) for i in range(1000, 1100)]
    return rows


def test_query_equals_plain(spark):
    rows = rows_with_runs()
    found = periods.digest_runs(periods.plant_periods(cases.frame(spark, rows)))
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 10
    assert cases.rows_of(found) == sorted((expected(r[0], planted(r[0], r[1])) for r in rows), key=repr)


def test_operator_equals_plain(spark):
    rows = rows_with_runs()
    found = periods.digest_runs(cases.frame(spark, rows))
    assert cases.rows_of(found) == sorted((expected(r[0], cut(r[1])) for r in rows), key=repr)


@pytest.mark.parametrize("times", [3, 4, 6])
def test_runs_of_any_texts(times):
    chance = random.Random(times)
    for letters in (1, 2, 3, 5):
        texts = ["".join(chance.choices("abcde"[:letters], k=chance.randint(0, 70))) for _ in range(60)]
        texts += [chance.choice(texts)[:9] * 5 for _ in range(30)]
        words = W.split_words(W.texts_of(pa.array([" ".join(t) for t in texts])))
        owner, start, size, period = periods.runs_of(words.hashes, words.owners, 6, times)
        for i, text in enumerate(texts):
            own = owner == i
            rows = zip((start[own] - words.first[i]).tolist(), size[own].tolist(), period[own].tolist(), strict=True)
            assert sorted(rows) == plain_runs(list(text), 6, times)
    with pytest.raises(ValueError, match="three"):
        periods.runs_of(np.zeros(0, np.uint64), np.zeros(0, np.int64), 6, 2)


def test_long_period_and_long_text(spark):
    words = [f"w{i}" for i in range(70_001)]
    rows = [(1, " ".join(words * 4 + words[:5]), "en", "s", 1), (2, "ha " * 500_000, "en", "s", 1)]
    found = {r.doc_id: r for r in periods.find_runs(cases.frame(spark, rows)).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 4 * 70_001 + 5, 70_001)]
    assert found[1].collapsed_text == " ".join(words)
    assert ([tuple(r) for r in found[2].runs], found[2].collapsed_text) == ([(0, 500_000, 1)], "ha")


def test_empty_table_and_kept_columns(spark):
    assert periods.digest_runs(periods.plant_periods(cases.frame(spark, []))).collect() == []
    frame = cases.frame(spark, rows_with_runs()[:5])
    assert periods.find_runs(frame, ["row", "doc_id", "source"]).columns[:3] == ["row", "doc_id", "source"]
    with pytest.raises(ValueError, match="results"):
        periods.find_runs(frame.withColumnRenamed("row", "runs"), ["runs"])
