"""Repeated strings against plain Python."""

import hashlib
from collections import Counter

import cases
import numpy as np
import pytest

from answerlab.llm import suffixes
from answerlab.llm import words as W

LENGTH = suffixes.LENGTH


def removed(rows):
    """Per row the runs of bytes that repeated strings cover."""
    data = [(row[1] or "").encode() for row in rows]
    times = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - LENGTH + 1):
            if times[d[i : i + LENGTH]] > 1:
                covered[i : i + LENGTH] = True
        out.append(covered)
    return out


def digests(rows):
    out = []
    for row, covered in zip(rows, removed(rows), strict=True):
        data = np.frombuffer((row[1] or "").encode(), np.uint8)
        runs = int((covered[1:] & ~covered[:-1]).sum() + (covered[0] if len(covered) else 0))
        out.append((row[0], len(data), int(covered.sum()), runs, hashlib.sha256(data[~covered].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def rows_with_repeats():
    a, b, c = (cases.prose(i, 90) for i in (70, 71, 72))
    rows = cases.documents()
    rows += [(40, a + b[:150], "en", "s", 1), (41, "é" + b[:150] + a[100:380], "en", "s", 1)]
    rows += [(42, c + " " + c, "en", "s", 1), (43, "xyz" * 300, "en", "s", 1), (44, "y" * 199, "en", "s", 1)]
    rows += [(45, a[:199], "en", "s", 1), (46, "é" * 150, "en", "s", 1), (47, "è" + "é" * 120, "en", "s", 1)]
    # One border passage with many different texts on either side.
    rows += [(60 + i, cases.prose(300 + i, 30) + b[:260] + cases.prose(400 + i, 30), "en", "s", 1) for i in range(12)]
    return rows


@pytest.mark.parametrize("hot", [suffixes.HOT, 1, 0])
def test_equals_plain(spark, hot):
    """Whether anchors are gathered in buckets or dealt window by window."""
    rows = rows_with_repeats()
    assert cases.rows_of(suffixes.digest_repeats(cases.frame(spark, rows), hot=hot)) == digests(rows)


def test_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_WINDOWS", 50)
    rows = rows_with_repeats()
    assert cases.rows_of(suffixes.digest_repeats(cases.frame(spark, rows))) == digests(rows)


def test_remove_repeats(spark):
    rows = rows_with_repeats()
    frame = cases.frame(spark, rows)
    cleaned = suffixes.remove_repeats(frame, n_chars="n_chars")
    assert cleaned.columns == frame.columns
    expected = []
    for row, covered in zip(rows, removed(rows), strict=True):
        data = (row[1] or "").encode()
        at, text = 0, ""
        for letter in row[1] or "":
            size = len(letter.encode())
            # A character goes only with all of its bytes.
            text += "" if covered[at : at + size].all() else letter
            at += size
        assert at == len(data)
        expected.append((row[0], row[1] if row[1] is None else text, *row[2:4], row[4] if row[1] is None else len(text)))
    found = [tuple(row)[:5] for row in cleaned.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    other = suffixes.remove_repeats(frame.withColumnsRenamed({"row": "_text", "a": "_spans"}), n_chars="n_chars")
    assert sorted((tuple(row)[:5] for row in other.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert suffixes.digest_repeats(cases.frame(spark, [])).collect() == []


def test_sliding_minima():
    values = np.random.default_rng(2).integers(0, 99, 57).astype(np.uint64)
    for width in (1, 5, 57, 58):
        assert suffixes.sliding_minima(values, width).tolist() == [min(values[i : i + width]) for i in range(57 - width + 1)]


def test_contexts_hold_every_window_once():
    texts = [cases.prose(3, 200), "", "é" * 120, "a" * 1000, "short"]
    import pyarrow as pa

    found = W.texts_of(pa.array(texts))
    owners, starts, windows, _, _ = suffixes.contexts_of(found)
    held = sorted((o, s + k) for o, s, n in zip(owners, starts, windows, strict=True) for k in range(n))
    assert held == [(i, p) for i, t in enumerate(texts) for p in range(len(t.encode()) - LENGTH + 1)]
