import hashlib

import pytest
from pyspark.sql import functions as F

from answerlab.jobs import review as job
from answerlab.operators import review, sampling
from answerlab.plans import ranks, skew
from bindings import queries


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, f"question {i}", "big" if i % 3 else ("small" if i % 2 else " mid")) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, question string, category string").repartition(5)


def expected_sample(rows, size, skip, seed):
    groups = {}
    for row in sorted(rows):
        groups.setdefault(row[1], []).append(row[0])
    order = lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i)
    return {i for ids in groups.values() for i in sorted(ids[skip:], key=order)[:size]}


@pytest.mark.parametrize("skip", [0, 10])
@pytest.mark.parametrize("salted", [False, True])
def test_sample_matches_brute_force(questions, monkeypatch, skip, salted):
    if salted:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
        real = sampling.measure_groups
        monkeypatch.setattr(sampling, "measure_groups", lambda rows, key: real(rows, key, 30))
    rows = [(r.id, r.category) for r in questions.collect()]
    got = sampling.stratified_sample(questions, 20, skip, seed=3).collect()
    assert {r.id for r in got} == expected_sample(rows, 20, skip, 3)
    assert len(got) == 60 and {r.question for r in got} == {f"question {r.id}" for r in got}


def test_sample_depends_on_seed_only(questions):
    ids = [sorted(r.id for r in sampling.stratified_sample(q, 5, 2, s).collect())
           for q, s in ((questions, 1), (questions.repartition(3), 1), (questions, 2))]
    assert ids[0] == ids[1] != ids[2]


def test_large_samples_and_skips(questions):
    rows = [(r.id, r.category) for r in questions.collect()]
    for size, skip in ((150, 80), (1, 599), (1000, 0), (3, 95)):
        got = sampling.stratified_sample(questions, size, skip, seed=3).collect()
        assert {r.id for r in got} == expected_sample(rows, size, skip, 3)
        for category in {r.category for r in got}:
            drawn = sorted((r for r in got if r.category == category), key=lambda r: r.draw)
            assert [r.draw for r in drawn] == list(range(1, len(drawn) + 1))
            keys = [hashlib.md5(f"3|{r.id}".encode()).hexdigest() for r in drawn]
            assert keys == sorted(keys)


def test_ranks_of_texts(spark):
    frame = spark.createDataFrame([("a", f"k{i:03d}") for i in range(300)] + [(None, "z")], "g string, x string")
    found = ranks.values_at_ranks(frame, "g", "x", F.array(F.lit(0), F.lit(250), F.col("total") - 1, F.lit(9999)))
    assert {(r.g, r["rank"], r.x, r.total) for r in found.collect()} == {
        ("a", 0, "k000", 300), ("a", 250, "k250", 300), ("a", 299, "k299", 300), (None, 0, "z", 1)
    }


def test_sample_checks(questions):
    with pytest.raises(ValueError, match="'small' has 90"):
        sampling.check_sample(questions, 91, 10)
    with pytest.raises(ValueError, match="unknown category: 'none'"):
        sampling.check_sample(questions, 1, 0, only="none")
    with pytest.raises(ValueError, match="positive"):
        sampling.check_sample(questions, 0, 0)
    with pytest.raises(ValueError, match="positive"):
        sampling.check_sample(questions, 1, -1)
    sampling.check_sample(questions, 91, 10, only="big")


def test_review_job(spark, questions, tmp_path):
    sample = job.draw(questions, 5, 2, seed=1, category="small")
    ids = sorted(r.id for r in sample.collect())
    assert len(ids) == 5
    decisions = spark.createDataFrame([(ids[0], "remove"), (ids[1], "keep")], "id bigint, decision string")
    summary = job.finish(questions, sample, decisions, str(tmp_path / "out"), []).first()
    assert (summary.reviewed, summary.removed, summary.pending, summary.remaining) == (5, 1, 3, 599)
    saved = {r.id: r.decision for r in spark.read.parquet(str(tmp_path / "out/decisions")).collect()}
    assert saved == {ids[0]: "remove", ids[1]: "keep", **{i: "pending" for i in ids[2:]}}
    left = spark.read.parquet(str(tmp_path / "out/filtered"))
    assert left.columns == questions.columns and left.count() == 599
    assert left.where(left.id == ids[0]).isEmpty()


def test_counts_leave_out_blank_categories(spark):
    frame = spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "category string")
    assert [tuple(r) for r in sampling.category_counts(frame).collect()] == [("a", 2)]
    assert review.PENDING == "pending"


def test_draw_rejects_blank_values(spark):
    frame = spark.createDataFrame([(1, "q", " ")], "id int, question string, category string")
    with pytest.raises(ValueError, match="'category' is empty"):
        job.draw(frame, 1, 0)


def test_query_draws_from_all_questions(spark, tmp_path):
    rows = [(i, f"text {i}", "web" if i % 2 else "book") for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.stratified_sample(spark, str(tmp_path)).collect()
    assert {r.id for r in got} == expected_sample([(i, c) for i, _, c in rows], queries.SAMPLE, queries.SKIP, queries.SEED)
    assert sorted((r.category, r.draw) for r in got) == [(c, d) for c in ("book", "web") for d in range(1, queries.SAMPLE + 1)]
