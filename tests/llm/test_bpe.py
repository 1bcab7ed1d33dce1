"""BPE against the tokenizers library."""

import hashlib

import cases
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from answerlab.llm import bpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
OWN = bpe.Bpe(VOCABULARY)
LIBRARY = Tokenizer.from_file(VOCABULARY)
LIBRARY.no_truncation()
LIBRARY.no_padding()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "ΑΣ ΣΑΣ", "İ ẞ ǅ", "e\u0301 é", "<|endoftext|>a<|startoftext|>", "'LL 'ſ don't", "日本 😀", "a" * 3000])
def test_chosen_texts(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        ":\u209d",
        "a\u088fb 1\u088f2",
        "\u1c89a \ua7cb \U00010d50:",
        ":\U00016ea0: a\U0003d000b",
        "e\u07fd\u0323\u0301x",
        "e\u1dfa\u0323 a😀b 1😀:",
        ":\U00011de1 \U0001ccf0\U0001ccf1",
    ],
)
def test_characters_of_any_unicode_version(text):
    """Letters, lower case, numbers and order of marks that Python, its pattern library and the library differ in."""
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_merge_takes_lowest_rank_then_leftmost():
    pair = lambda a, b: a << 32 | b
    ranks, made = {pair(1, 2): 1, pair(2, 3): 0, pair(1, 1): 2}, [23, 12, 11]
    assert bpe.merge([1, 2, 3], ranks, made) == [1, 23]
    assert bpe.merge([1, 1, 1], ranks, made) == [11, 1]
    assert bpe.merge([], ranks, made) == []


def test_table(spark):
    rows = cases.documents()
    expected = []
    for row in rows:
        ids = LIBRARY.encode(row[1] or "", add_special_tokens=False).ids
        shown, decoded = " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append((row[0], len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (shown, decoded))))
    frame = cases.frame(spark)
    assert cases.rows_of(bpe.digest_documents(frame, VOCABULARY)) == sorted(expected, key=repr)
    kept = bpe.encode_documents(frame, VOCABULARY, keep=frame.columns)
    assert kept.columns == [*frame.columns, "ids"]
    found = {row["text"]: row["ids"] for row in kept.collect()}
    assert all(found[row[1]] == LIBRARY.encode(row[1] or "", add_special_tokens=False).ids for row in rows)


def test_empty_and_clashing(spark):
    assert bpe.digest_documents(cases.frame(spark, []), VOCABULARY).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        bpe.digest_documents(cases.frame(spark).withColumnRenamed("row", "n_tokens"), VOCABULARY, ["n_tokens"])
