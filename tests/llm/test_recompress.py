"""Removed copies of passages against plain Python."""

import hashlib
import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest

from answerlab.llm import recompress
from answerlab.llm import words as W

WINDOW = recompress.WINDOW


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(rows, window=WINDOW):
    """Per row (id, words, words removed, words kept)."""
    lowest = {}
    order = [float("inf") if row[0] is None else row[0] for row in rows]
    texts = [cut(row[1]) for row in rows]
    for own, words in zip(order, texts, strict=True):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            lowest[key] = min(lowest.get(key, own), own)
    out = []
    for row, own, words in zip(rows, order, texts, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if lowest[tuple(words[i : i + window])] < own:
                gone.update(range(i, i + window))
        out.append((row[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def digests(rows):
    made = [(i, n, r, hashlib.sha256(t.encode()).hexdigest()) for i, n, r, t in kept(rows)]
    return sorted(made, key=repr)


def rows_with_copies():
    rows = cases.documents()
    a, b = cases.prose(80, 120).split(), cases.prose(81, 40).split()
    # A shared passage at a border, in the middle, of exactly a window and one word less; runs and periods.
    rows += [(200, " ".join(a), "en", "s", 1), (199, " ".join(b + a[40:70]), "en", "s", 1)]
    rows += [(201, " ".join(b[:20] + a[:13]), "en", "s", 1), (202, " ".join(a[100:112] + b[5:9]), "en", "s", 1)]
    rows += [(203, "ha " * 40, "en", "s", 1), (204, "x " + "ha " * 12 + "y", "en", "s", 1)]
    rows += [(205, "x " + "ha " * 13 + "y", "en", "s", 1), (206, "a b " * 30, "en", "s", 1), (207, "b a " * 9, "en", "s", 1)]
    rows += [(208, "p p q q q " * 12, "en", "s", 1), (209, "q q p p q " * 3, "en", "s", 1)]
    rows += [(210, " ".join(a) + " " + " ".join(a), "en", "s", 1), (-3, " ".join(a[50:90]), "en", "s", 1)]
    # One passage with very many texts around it.
    rows += [(300 + i, cases.prose(500 + i, 5 + i % 7) + " " + " ".join(a[20:50]), "en", "hot", 1) for i in range(25)]
    return rows


@pytest.mark.parametrize("buckets", [None, 3])
def test_equals_plain(spark, buckets):
    rows = rows_with_copies()
    found = recompress.digest_copies(cases.frame(spark, rows), buckets=buckets)
    assert cases.rows_of(found) == digests(rows)


def test_few_words_many_repeats(spark):
    """Texts over three words: all windows are full of runs, and most are shared."""
    chance = random.Random(5)
    rows = [(i // 2, " ".join(chance.choices("abc", [6, 2, 1], k=chance.randint(0, 60))), "en", "s", 1) for i in range(120)]
    assert cases.rows_of(recompress.digest_copies(cases.frame(spark, rows))) == digests(rows)


def test_texts(spark):
    rows = rows_with_copies()
    found = recompress.remove_copies(cases.frame(spark, rows))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=repr) == sorted(kept(rows), key=repr)


def test_empty_table(spark):
    assert recompress.digest_copies(cases.frame(spark, [])).collect() == []


def test_very_long_text(spark):
    """A text of 8 MB, and its middle as another document."""
    words = [f"w{i * 7919 % 100003}x{i}" for i in range(600_000)]
    rows = [(2, " ".join(words[1000:1400]), "en", "s", 1), (1, " ".join(words), "en", "s", 1)]
    found = {r.doc_id: (r.n_words, r.n_removed) for r in recompress.remove_copies(cases.frame(spark, rows)).collect()}
    assert found == {1: (600_000, 0), 2: (400, 400)}


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_equal_windows_have_equal_anchors(levels):
    """At the same place in the window, whatever stands around it."""
    chance = random.Random(levels)
    texts = []
    for size in (2, 3, 30, 3000):
        shared = [f"v{chance.randrange(size)}" for _ in range(60)]
        for _ in range(30):
            around = [f"v{chance.randrange(size)}" for _ in range(40)]
            at = chance.randrange(40)
            texts.append(" ".join(around[:at] + shared[chance.randrange(20) : 40 + chance.randrange(20)] + around[at:]))
    words = W.split_words(W.texts_of(pa.array(texts)))
    anchors, _, text, starts, counts, hashes = recompress.contexts_of(words, WINDOW, levels)
    assert counts.max() <= WINDOW and counts.sum() == len(hashes) == np.maximum(words.counts - WINDOW + 1, 0).sum()
    known = {}
    flat = [t.split() for t in texts]
    for anchor, own, start, count in zip(anchors.tolist(), text.tolist(), starts.tolist(), counts.tolist(), strict=True):
        for i in range(start, start + count):
            assert known.setdefault(tuple(flat[own][i : i + WINDOW]), anchor) == anchor


def test_hot_passage_is_a_row_a_batch(spark):
    """Copies within a batch are solved there."""
    passage = cases.prose(90, 200)
    texts = W.texts_of(pa.array([passage] * 500))
    ids = np.arange(500, dtype=np.int64)
    rows = pa.Table.from_batches(recompress._deal(ids, ids * 0, texts, 64, WINDOW)).to_pylist()
    open_ = [r for r in rows if not r["solved"]]
    windows = len(passage.split()) - WINDOW + 1
    unpacked = [recompress._unpacked(pa.Codec("zstd").decompress(r["data"], r["size"], asbytes=True)) for r in open_]
    assert sum(int(u[4].sum()) for u in unpacked) == windows
    assert {int(i) for u in unpacked for i in u[1]} == {0}
