"""The n-gram join against all pairs of documents."""

import re
import tracemalloc

import cases
import numpy as np
import pytest

from answerlab.llm import graphs, jaccard, words
from answerlab.session import BATCH_BYTES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows):
    sets = [shingles(row[1]) for row in rows]
    linked = [
        [j for j in range(len(rows)) if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        for i in range(len(rows))
    ]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(linked):
            low = min([group[i], *[group[j] for j in others]])
            changed |= low != group[i]
            group[i] = low
    names = {}
    for i, row in enumerate(rows):
        held = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        names[i] = min(held) if held else None
    return sorted([(row[0], names[i], len(linked[i])) for i, row in enumerate(rows)], key=repr), group


def test_equals_all_pairs(spark):
    rows = cases.documents()
    assert cases.rows_of(jaccard.join_near(cases.frame(spark))) == brute(rows)[0]


def test_large_groups_go_through_tiles(spark, monkeypatch):
    """Buckets beyond the limit are split or tiled; the result does not change."""
    monkeypatch.setattr(jaccard, "LIMIT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "DEPTH", 2)
    base = cases.prose(1, 150).split(" ")
    rows = []
    for i in range(40):
        words = list(base)
        words[i] = f"w{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(100 + i, "a line that all share\n" + cases.prose(200 + i, 60), "en", "s", 1) for i in range(30)]
    assert cases.rows_of(jaccard.join_near(cases.frame(spark, rows))) == brute(rows)[0]


def test_keep_one(spark):
    rows = cases.documents()
    frame = cases.frame(spark)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    group = brute(rows)[1]
    assert kept.count() == len(set(group))
    texts = [row["text"] for row in kept.collect()]
    assert texts.count(rows[6][1]) == 1 and len([t for t in texts if not (t or "").strip()]) == 3


def test_empty_table(spark):
    assert jaccard.join_near(cases.frame(spark, [])).collect() == []


def test_runs_follow_recall():
    assert jaccard.runs_for(0.9, 1) < jaccard.runs_for(0.9, 6) < jaccard.runs_for(0.9999, 6)


def test_columns_of_any_name(spark):
    frame = cases.frame(spark).withColumnsRenamed({"row": "_row", "a": "_root", "b": "_key", "n": "_n"})
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(set(brute(cases.documents())[1]))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (5, 5)], "a long, b long")
    found = {row["node"]: row["root"] for row in graphs.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_shingles_of_a_batch_take_bounded_memory():
    """What a worker holds besides the result does not follow the bytes it is given."""
    text = cases.prose(7, 40_000).encode()
    data = np.frombuffer(text * 48, np.uint8)
    texts = words.Texts(data, np.arange(49) * len(text))
    tracemalloc.start()
    hashes, offsets = jaccard.shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = jaccard.shingle_sets(words.Texts(data[: len(text)], np.array([0, len(text)])))[0]
    assert np.array_equal(hashes, np.tile(alone, 48)) and np.array_equal(offsets, np.arange(49) * len(alone))
    assert len(data) > 10 << 20 and peak < 8 * len(data)


def test_passes_over_texts_get_arrow_batches_of_few_bytes(spark, monkeypatch):
    limits, write = [], jaccard.materialise

    def spy(frame):
        limits.append((frame.columns, spark.conf.get(BATCH_BYTES)))
        return write(frame)

    monkeypatch.setattr(jaccard, "materialise", spy)
    before = spark.conf.get(BATCH_BYTES)
    jaccard.join_near(cases.frame(spark))
    small = [columns for columns, limit in limits if limit == str(2 * jaccard.BATCH)]
    assert any("_sig" in columns for columns in small) and ["a", "b", "links"] in small
    assert spark.conf.get(BATCH_BYTES) == before
