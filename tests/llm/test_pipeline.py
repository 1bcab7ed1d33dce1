"""The pipeline against plain Python, stage by stage."""

from dataclasses import replace
from math import log2

import cases
import corpus_pipeline
import numpy as np
import test_bpe
import test_jaccard
import test_leaks
import test_quality
import test_suffixes

from answerlab.llm import quality
from answerlab.session import BATCH_BYTES

ITEM = cases.prose(800, 40)


def good(row, bands=None):
    found = test_quality.plain(row[1])
    if bands is not None:
        band = bands.get(row[2], quality.DEFAULT_BAND)
        # Ends are measures of some text, which may come out here with another last bit.
        moved = {"min_chars": -1e-9, "min_entropy": -1e-9, "max_chars": 1e-9, "max_fallback": 1e-9}
        band = replace(band, **{n: getattr(band, n) + by for n, by in moved.items() if hasattr(band, n)})
        measures = (found[name] for name in ("chars_per_token", "fallback_share", "token_entropy", "n_tokens"))
        return not found["base_failed"] and bool(band.holds(*(np.array([m]) for m in measures), np.array([32_000]))[0])
    band = quality.BANDS.get(row[2], quality.DEFAULT_BAND)
    possible = log2(max(2, min(found["n_tokens"], 32_000)))
    return (
        not found["base_failed"]
        and band.min_chars <= found["chars_per_token"] <= band.max_chars
        and found["fallback_share"] <= band.max_fallback
        and found["token_entropy"] >= band.min_spread * possible
    )


def plain(rows, bands=None):
    rows = [row for row in rows if good(row, bands)]
    groups = test_jaccard.brute(rows)[1]
    first = {}
    for index in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        first.setdefault(groups[index], index)
    rows = [rows[i] for i in sorted(first.values())]
    cleaned = []
    for row, covered in zip(rows, test_suffixes.removed(rows), strict=True):
        at, text = 0, ""
        for letter in row[1]:
            size = len(letter.encode())
            text += "" if covered[at : at + size].all() else letter
            at += size
        cleaned.append((row[0], text, row[2], row[3], len(text)))
    leaked = {row[0] for row in test_leaks.plain(cleaned, [(1, ITEM)])}
    return sorted(((*r, test_bpe.OWN.encode(r[1])) for r in cleaned if r[0] not in leaked), key=repr)


def test_run(spark, tmp_path):
    rows = cases.documents()
    rows += [(500, cases.prose(1, 50) + " " + ITEM, "en", "s", 1), (501, cases.prose(2, 300), "en", "s", 1)]
    rows += [(502, "# $ % " * 40 + cases.prose(5, 10), "en", "s", 1), (503, cases.prose(2, 300) + " more", "en", "s", 1)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    expected = plain(rows)
    assert cases.rows_of(result) == expected
    kept = {row[0] for row in expected}
    assert 500 not in kept and 2 not in kept and {501, 30, 33} <= kept and 503 not in kept


def test_run_with_labels_and_columns_of_any_name(spark, tmp_path):
    """Bands learned from labels; extra columns with the names that stages use themselves."""
    labelled, marks = test_quality.labelled()
    rows = cases.documents() + labelled[::3] + [(500, cases.prose(1, 50) + " " + ITEM, "en", "s", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    extra = ["_extra", "_text", "_row", "_id", "_lang", "ids", "kept", "n_words", "pieces", "_key", "_spans", "_leaked", "c0"]
    docs.withColumns({name: docs["doc_id"] for name in extra}).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra, "ids_"]
    bands = quality.learn_bands(docs, labels, test_quality.VOCABULARY)
    assert isinstance(bands["en"], quality.LearnedBand)
    expected = plain(rows, bands)
    found = result.collect()
    assert sorted(((*row[:5], row["ids_"]) for row in found), key=repr) == expected
    assert all(row[name] == row["doc_id"] for row in found for name in extra)
    assert 150 < len(expected) < 250


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], cases.SCHEMA)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
        assert docs.collect() == []
    assert "ids" in corpus_pipeline.encoded(spark, docs, str(tmp_path)).columns


def test_arrow_batches_are_of_few_bytes_when_the_caller_writes(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cases.frame(spark).select(*cases.frame(spark).columns[:5]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(BATCH_BYTES)
    try:
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.repeated_strings, corpus_pipeline.encoded):
            spark.conf.set(BATCH_BYTES, "32m")
            stage(spark, docs, str(tmp_path))
            assert spark.conf.get(BATCH_BYTES) == str(corpus_pipeline.BATCH)
        spark.conf.set(BATCH_BYTES, "32m")
        corpus_pipeline.run(spark, str(tmp_path))
        assert spark.conf.get(BATCH_BYTES) == "32m"
    finally:
        spark.conf.set(BATCH_BYTES, before)
