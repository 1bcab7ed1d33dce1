"""Decontamination against comparing every window with every window."""

import random
import re

import cases
import pytest

from answerlab.llm import leaks


def tokens(text):
    return re.sub(r"[^a-zà-ÿ0-9\x20\x09-\x0D]+", "", (text or "").lower()).split()


def plain(docs, items):
    found = {}
    for doc_id, text, *_ in docs:
        d = tokens(text)
        for item_id, item in items:
            b = tokens(item)
            if len(b) < leaks.MIN_TOKENS:
                continue
            size = min(leaks.WINDOW, len(b))
            for s in range(len(b) - size + 1):
                for at in range(len(d) - size + 1):
                    equal = sum(x == y for x, y in zip(b[s : s + size], d[at : at + size], strict=True))
                    if equal >= size - size * 3 // 16:
                        found[doc_id, item_id] = max(equal, found.get((doc_id, item_id), 0))
    return sorted(((*k, v) for k, v in found.items()), key=repr)


def changed(words, places):
    return [f"other{p}" if p in places else w for p, w in enumerate(words)]


def material():
    chance = random.Random(4)
    items = [(i, cases.prose(500 + i, size)) for i, size in enumerate((40, 16, 15, 12, 11, 3, 25))]
    items += [(None, cases.prose(600, 30)), (7, None), (8, ""), (9, items[0][1]), (0, items[0][1])]
    docs = cases.documents()
    docs = [d for d in docs if d[0] != 9]
    for number in range(60):
        item = tokens(items[chance.choice([0, 1, 2, 3, 4, 6, 7])][1])
        places = set(chance.sample(range(len(item)), min(len(item), chance.randint(0, 5))))
        inside = " ".join(changed(item, places))
        docs.append((200 + number, f"{cases.prose(number, 12)} {inside.upper()}! {cases.prose(900 + number, 12)}", "en", "s", 1))
    docs.append((None, items[0][1], "en", "s", 1))
    docs.append((400, items[0][1] + " " + items[0][1], "en", "s", 1))
    docs.append((401, " ".join(items[0][1].split()[:15]), "en", "s", 1))
    return docs, items


@pytest.mark.parametrize("limit", [leaks.BROADCAST_BYTES, 4000])
def test_equals_plain(spark, limit):
    """In one pass, and in blocks of items that each fit the broadcast."""
    docs, items = material()
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    found = leaks.find_leaks(cases.frame(spark, docs), bench, broadcast_bytes=limit)
    expected = plain(docs, items)
    assert len(expected) > 30
    assert cases.rows_of(found) == expected


def test_drop_leaks(spark):
    docs, items = material()
    frame = cases.frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    leaked = {row[0] for row in plain(docs, items)}
    kept = leaks.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert cases.rows_of(kept.select("doc_id", "text")) == sorted([d[:2] for d in docs if d[0] not in leaked], key=repr)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.find_leaks(cases.frame(spark), bench).collect() == []
    full = spark.createDataFrame([(1, cases.prose(1, 30))], "item_id bigint, text string")
    assert leaks.find_leaks(cases.frame(spark, []), full).collect() == []
    assert leaks.drop_leaks(cases.frame(spark), bench).count() == len(cases.documents())


def test_masks_meet_all_substitutions():
    from itertools import combinations

    for size in range(leaks.MIN_TOKENS, leaks.WINDOW + 1):
        for wrong in combinations(range(size), size * 3 // 16):
            assert any(
                not any(at + step in wrong for step in mask)
                for mask in leaks.MASKS
                for at in range(size - leaks.SPAN + 1)
            )
