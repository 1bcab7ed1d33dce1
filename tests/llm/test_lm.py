"""The language model: the base score by brute force, probabilities that sum to one, better than the base."""

import math
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlab.llm import lm
from answerlab.llm import words as W
from answerlab.session import BATCH_BYTES


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def base(rows, held):
    counts = Counter(t for row in rows if not held(row) for t in tokens(row[1]))
    total, words = sum(counts.values()), len(counts)
    out = []
    for row in rows:
        own = tokens(row[1])
        score = sum(math.log10((counts[t] + 1) / (total + words + 1)) for t in own)
        out.append((row[0], held(row), len(own), sum(counts[t] > 0 for t in own), total, round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("common", [lm.COMMON, 20, 0])
def test_base_score(spark, monkeypatch, common):
    """Whatever share of the words is joined instead of broadcast."""
    monkeypatch.setattr(lm, "COMMON", common)
    rows = cases.documents()
    docs = cases.frame(spark).withColumn("learn", F.col("source") != "hot")
    found = lm.score_documents(docs, "learn").withColumn("base_score", F.round("base_score", 6)).drop("score")
    expected = base(rows, lambda row: row[3] == "hot" or row[3] is None)
    assert cases.rows_of(found) == expected


def test_words_without_training(spark):
    found = lm.score_documents(cases.frame(spark).withColumn("learn", F.lit(False)), "learn").collect()
    assert all(row["n_known"] == 0 and row["train_tokens"] == 0 and row["base_score"] == 0 for row in found)
    assert all(math.isfinite(row["score"]) for row in found)
    assert lm.score_documents(cases.frame(spark, []).withColumn("learn", F.lit(True)), "learn").collect() == []


def vocabulary_of(spark, rows):
    docs = cases.frame(spark, rows).withColumns({"_text": F.col("text"), "learn": F.lit(True)})
    counts = lm.materialise(lm.count_words(docs, "_text", "learn"))
    return counts, lm.read_vocabulary(counts)


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_word_probabilities_sum_to_one(scale):
    """Over all numbers of all classes, also where scores are large."""
    random = np.random.default_rng(1)
    first = np.array([0, 1, 2, 5, 6, 10])
    model = lm.LogBilinear.fresh(first, np.full(10, 0.1))
    model.table[:] = random.normal(0, scale, model.table.shape)
    context = np.repeat(random.integers(0, 11, (1, lm.CONTEXT)), 10, axis=0)
    logs = model.log_probabilities(np.arange(10), context)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_fresh_model_is_the_unigram_distribution():
    first, shares = np.array([0, 1, 4]), np.array([0.4, 0.3, 0.2, 0.1])
    model = lm.LogBilinear.fresh(first, shares)
    model.table[: model.words + 1] = 0
    logs = model.log_probabilities(np.arange(4), np.zeros((4, lm.CONTEXT), int))
    assert np.allclose(np.exp(logs), shares, atol=1e-6)


def test_open_vocabulary_has_probability_one(spark, monkeypatch):
    """Known words and one unknown word of each class: what the counts within a number add is one."""
    monkeypatch.setattr(lm, "OWN_CLASSES", 5)
    monkeypatch.setattr(lm, "ENDING_CLASSES", 4)
    monkeypatch.setattr(lm, "GROUP_CLASSES", 7)
    counts, vocabulary = vocabulary_of(spark, [(i, cases.prose(i, 300), None, "s", 1) for i in range(20)])
    words = counts.toPandas()
    hashes = words["hash"].to_numpy(np.int64).view(np.uint64)
    numbers, found, common = lm.look_up(vocabulary, hashes, words["ending"].to_numpy(np.int64))
    assert common.all() and np.array_equal(found, words["c"])
    shares = np.bincount(numbers, 10 ** (np.log10(found + 1.0) - vocabulary.spread[numbers]), vocabulary.size)
    unknown = np.zeros(vocabulary.size)
    unknown[-5:] = 10 ** -vocabulary.spread[-5:]
    assert np.allclose(shares + unknown, 1)
    assert np.bincount(numbers, found, vocabulary.size).tolist() == vocabulary.word_tokens.tolist()
    own = found >= lm.own_count(vocabulary.tokens)
    assert len(vocabulary.first) == 5 + 7 + 5 + 1 and np.ptp(np.diff(vocabulary.first)[5:12]) <= 1
    assert 5 < own.sum() < len(own) and len(set(numbers[own])) == own.sum()


def test_vectors_follow_the_corpus():
    """The share of the tokens that earns a word vectors falls as the corpus grows."""
    shares = [lm.own_count(10**n) / 10**n for n in range(6, 14)]
    assert shares == sorted(shares, reverse=True) and shares[-1] < shares[0] / 50


def test_contexts_stop_at_texts():
    found = lm.contexts(np.array([1, 2, 3, 4]), np.array([0, 2, 4]), 9)
    assert found.tolist() == [[9, 9, 9], [1, 9, 9], [9, 9, 9], [3, 9, 9]]


def test_learns_which_word_follows():
    """Words of one class that follow each other in turn, which no count tells."""
    first, shares = np.array([0, 1, 5]), np.full(5, 0.2)
    model = lm.LogBilinear.fresh(first, shares)
    words = np.tile(np.arange(5), 20_000)
    around = lm.contexts(words, np.array([0, len(words)]), 5)
    model.train(words, around, lm.RATE, np.random.default_rng(1))
    assert model.log_probabilities(words[-1000:], around[-1000:]).mean() > np.log(0.8)


def test_learns_the_language_of_a_text(spark):
    """Words of one language follow each other, which counts alone do not tell."""
    rows = [(i, cases.prose(i, 400, "en" if i % 2 else "de"), None, "s", 1) for i in range(240)]
    docs = cases.frame(spark, rows).withColumn("learn", F.col("doc_id") % 7 != 2)
    sums = lm.score_documents(docs, "learn").groupBy("held_out").agg(F.sum("score") - F.sum("base_score"))
    assert all(gain > 0 for _, gain in sums.collect())


def test_model_does_not_depend_on_partitions(spark, monkeypatch):
    """Several shards, copies of one row in all of them: equal parameters, and scores up to 32-bit products."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1500)
    rows = [(i, cases.prose(i, 150), None, "s", 1) for i in range(60)] + [(7, "the same row", None, "s", 1)] * 300
    rows.append((99, cases.prose(99, 3000), None, "s", 1))
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumn("learn", F.col("doc_id") % 5 != 2)
    models, scores = [], []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *given: models.append(fit(*given)) or models[-1])
    for parts in (1, 7):
        scored = lm.score_documents(docs.repartition(parts, F.rand(parts)), "learn")
        scores.append(sorted((r["doc_id"], r["score"]) for r in scored.collect()))
    assert np.array_equal(models[0].table, models[1].table)
    assert np.allclose(scores[0], scores[1], rtol=0, atol=1e-4)


def test_copies_are_dealt_over_all_shards(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 300)
    rows = [(7, "the same row", None, "s", 1)] * 2000
    docs = cases.frame(spark, rows).withColumn("learn", F.lit(True))
    dealt, shards = lm.dealt_units(docs, "text", "learn", "doc_id", vocabulary_of(spark, rows)[1])
    sizes = [r["count"] for r in dealt.groupBy("round", "shard").count().collect()]
    assert shards > 4 and len(sizes) == lm.ROUNDS * shards and sum(sizes) == 2000 and max(sizes) < 2000 / len(sizes) * 2


def test_slices_do_not_change_contexts(monkeypatch):
    """A shard laid out in slices is trained on the same tokens and contexts as at once."""
    pieces = [np.arange(n, dtype="<u4").tobytes() for n in (5, 0, 1, 700, 2, 64, 130)]
    seen = {}
    for size in (2, 1000):
        monkeypatch.setattr(lm, "BATCH", 32)
        monkeypatch.setattr(lm, "SLICE", size)
        calls = []

        class Listener:
            def train(self, units, context, *rest, calls=calls):
                calls.append(np.column_stack([units, context]))

        lm._learn_shard(Listener(), pieces, 999, 0.1, None)
        seen[size] = np.concatenate(calls)
    assert np.array_equal(seen[2], seen[1000])


def test_tokens_of_a_piece():
    import pyarrow as pa

    hashes, endings, first = lm.tokens_of(W.texts_of(pa.array(["A b", None, "a"])))
    assert first.tolist() == [0, 3, 4, 6] and hashes[0] == hashes[4] and endings[2] == -1


def test_tokens_are_not_sorted_by_wide_keys(spark, monkeypatch):
    """Tokens are told apart by hash tables and ordered by counting, not by comparing 64-bit values."""
    rows = [(i, cases.prose(i, 300), None, "s", 1) for i in range(20)]
    _, vocabulary = vocabulary_of(spark, rows)
    model = lm.LogBilinear.fresh(vocabulary.first, vocabulary.shares)
    argsort = np.argsort

    def narrow(values, **given):
        assert values.dtype.itemsize <= 2 or len(values) < 1000
        return argsort(values, **given)

    monkeypatch.setattr(np, "argsort", narrow)
    monkeypatch.setattr(np, "unique", None)
    sums = lm._score(model, vocabulary, W.texts_of(lm.pa.array([row[1] for row in rows])))[0]
    assert sums["n_common"].tolist() == sums["n_tokens"].tolist() and sums["n_tokens"].sum() > 5000


def test_texts_come_in_batches_of_few_bytes(spark, monkeypatch):
    limits, write = [], lm.materialise

    def spy(frame):
        limits.append(spark.conf.get(BATCH_BYTES))
        return write(frame)

    monkeypatch.setattr(lm, "materialise", spy)
    before = spark.conf.get(BATCH_BYTES)
    lm.score_documents(cases.frame(spark).withColumn("learn", F.lit(True)), "learn")
    assert limits == [str(lm.TEXT_BYTES)] * 3 and spark.conf.get(BATCH_BYTES) == before


@pytest.mark.parametrize(("pieces", "most"), [(100, 1), (100, 150), (1 << 20, 1 << 19)])
def test_counts_of_pieces_are_summed(spark, monkeypatch, pieces, most):
    monkeypatch.setattr(lm, "TEXT_BYTES", pieces)
    monkeypatch.setattr(lm, "COUNTED", most)
    rows = [(i, cases.prose(i, 200), None, "s", 1) for i in range(30)] + [(99, None, None, "s", 1)]
    docs = cases.frame(spark, rows).coalesce(1).withColumn("learn", F.lit(True))
    found = lm.count_words(docs, "text", "learn").collect()
    expected = Counter(t for row in rows for t in tokens(row[1]))
    assert sorted(row["c"] for row in found) == sorted(expected.values())


@pytest.mark.parametrize("scale", [0.5, 2.0, 3.0, 4.0, 6.0])
def test_probabilities_agree_with_a_plain_sum(scale):
    """Also where scores are about as large as 32-bit numbers hold without taking off the largest."""
    random = np.random.default_rng(2)
    first = np.array([0, 1, 2, 40, 41, 300])
    model = lm.LogBilinear.fresh(first, np.full(300, 1 / 300))
    model.table[:] = random.normal(0, scale, model.table.shape)
    words, context = random.integers(0, 300, 3000), random.integers(0, 301, (3000, lm.CONTEXT))
    table = model.table.astype(float)
    hidden = np.ones((len(words), lm.DIMENSION + 1))
    hidden[:, :-1] = sum(table[context[:, p], :-1] * table[model.place_row + p, :-1] for p in range(lm.CONTEXT))
    expected = np.zeros(len(words))
    for i, word in enumerate(words):
        number = model.class_of[word]
        low, high = model.word_row + first[number], model.word_row + first[number + 1]
        for rows, chosen in ((table[model.class_row : model.word_row], number), (table[low:high], word - first[number])):
            scores = rows @ hidden[i]
            expected[i] += scores[chosen] - np.logaddexp.reduce(scores)
    assert np.allclose(model.log_probabilities(words, context), expected, rtol=1e-4, atol=1e-4)


def test_a_training_step_follows_the_gradient():
    """One batch against plain sums of every token's changes, with words in classes of several and alone."""
    random = np.random.default_rng(3)
    first = np.array([0, 1, 2, 6, 7, 12])
    shares = random.random(12) / 6
    model = lm.LogBilinear.fresh(first, shares)
    table, classes = model.table.astype(float), model.class_of
    words, context = random.integers(0, 12, 500), random.integers(0, 13, (500, lm.CONTEXT))
    model.train(words, context, lm.RATE, np.random.default_rng(4))

    draws = np.random.default_rng(4)
    noise = np.searchsorted(np.cumsum(model.class_shares), draws.random(lm.NOISE)).clip(0, 4)
    many = np.diff(first)[classes[words]] > 1
    inner = iter(draws.random((many.sum(), lm.WORD_NOISE)))
    change = np.zeros_like(table)
    places = table[model.place_row :, :-1]
    for word, around in zip(words, context, strict=True):
        number = classes[word]
        hidden = np.append((table[around, :-1] * places).sum(axis=0), 1.0)
        labels = [(model.class_row + number, 1, model.class_shares[number] * lm.NOISE)]
        labels += [(model.class_row + n, 0, model.class_shares[n] * lm.NOISE) for n in noise]
        if first[number + 1] - first[number] > 1:
            within = np.cumsum(model.within[first[number] : first[number + 1]])
            others = first[number] + np.searchsorted(within, next(inner)).clip(0, len(within) - 1)
            labels.append((model.word_row + word, 1, model.within[word] * lm.WORD_NOISE))
            labels += [(model.word_row + w, 0, model.within[w] * lm.WORD_NOISE) for w in others]
        back = np.zeros_like(hidden)
        for row, label, often in labels:
            miss = label - 1 / (1 + np.exp(np.log(often) - table[row] @ hidden))
            change[row] += miss * hidden
            back += miss * table[row]
        for place, row in enumerate(around):
            change[row, :-1] += back[:-1] * places[place]
            change[model.place_row + place, :-1] += back[:-1] * table[row, :-1]
    expected = table + lm.RATE * change / np.sqrt(lm.FIRST_ROOT**2 + change**2)
    assert np.allclose(model.table, expected, atol=1e-5)
