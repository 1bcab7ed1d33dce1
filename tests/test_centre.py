import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlab.functions import vectors as vec
from answerlab.operators import centre
from answerlab.plans import skew
from bindings import queries


def expected_centre(answers):
    """Plain NumPy on one question: (kept, cosines to the centre, distances)."""
    mean = answers.mean(axis=0)
    distances = np.linalg.norm(answers - mean, axis=1)
    kept = distances <= (distances.mean() + distances.std()) * (1 + 1e-9)
    middle = answers[kept].mean(axis=0)
    cosines = answers @ middle / (np.linalg.norm(answers, axis=1) * np.linalg.norm(middle))
    return kept, cosines, distances


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {q: rng.normal(size=(n, 5)) + 0.7 for q, n in ((1, 19), (2, 300), (3, 4), (4, 1), *((q, 2) for q in range(5, 60)))}


def frame_of(spark, groups):
    rows = [(q, p, f"answer {p}", v.tolist()) for q, m in groups.items() for p, v in enumerate(m)]
    return spark.createDataFrame(rows, "question_id bigint, position int, response string, v array<double>")


@pytest.mark.parametrize("path", ["broadcast", "plain join", "salted join"])
def test_centre_on_every_join_path(spark, groups, monkeypatch, path):
    if path != "broadcast":
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    frame = frame_of(spark, groups)
    sizes = skew.measure_groups(frame, "question_id", 20 if path == "salted join" else 10**6)
    measured = centre.with_centre(frame, sizes=sizes)
    assert set(measured.columns) == {*frame.columns, "dist", "kept", "centre", "cos"}
    assert measured.count() == sum(map(len, groups.values()))
    for row in centre.centre_metrics(measured, "response").collect():
        kept, cosines, distances = expected_centre(groups[row.question_id])
        assert cosines[row.center_position] == pytest.approx(cosines.max(), rel=1e-12)
        assert row.center_response == f"answer {row.center_position}"
        assert row.center_similarity_mean == pytest.approx(cosines.mean())
        assert row.clean_to_center_similarity == pytest.approx(cosines[0])
        assert row.cluster_dispersion == pytest.approx(distances[kept].mean())
        assert row.answers == len(distances)


def test_answers_without_a_vector_do_not_count(spark, groups):
    frame = frame_of(spark, {1: groups[1]})
    gaps = frame.unionByName(frame.where("position < 3").selectExpr("question_id", "-position - 1 AS position", "response", "cast(null as array<double>) AS v"))
    row = centre.centre_metrics(centre.with_centre(gaps), "response").first()
    kept, cosines, _ = expected_centre(groups[1])
    assert row.answers == len(cosines) and row.center_similarity_mean == pytest.approx(cosines.mean())
    assert row.clean_to_center_similarity is None
    nothing = centre.centre_metrics(centre.with_centre(gaps.where("v is null")), "response").first()
    assert (nothing.answers, nothing.center_response, nothing.center_position) == (0, None, None)


def test_a_tie_goes_to_the_lowest_position(spark):
    frame = frame_of(spark, {1: np.array([[1.0, 0.0]] * 3)})
    row = centre.centre_metrics(centre.with_centre(frame)).first()
    assert (row.center_position, row.cluster_dispersion) == (0, 0.0)


def test_defaults_for_questions_without_answers(spark, groups):
    metrics = centre.centre_metrics(centre.with_centre(frame_of(spark, groups)), "response")
    questions = spark.createDataFrame([(1, None), (999, None)], "question_id bigint, score double")
    rows = {r.question_id: r for r in centre.with_defaults(questions, metrics, ["score"]).collect()}
    assert rows[1].score is None and rows[1].center_response
    assert (rows[999].score, rows[999].center_response, rows[999].answers) == (1.0, None, 0)
    assert rows[999].center_similarity_mean == rows[999].clean_to_center_similarity == rows[999].cluster_dispersion == 0.0


def test_vector_functions(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [
        ([1.0, 0.0], [0.6, 0.8], 0.6, 0.6),
        ([0.0, 0.0], [1.0, 1.0], 0.0, None),
        ([1.0, nan], [1.0, 0.0], None, None),
        ([1.0, inf], [1.0, 0.0], None, None),
        ([1.0], [1.0, 0.0], None, None),
    ]
    frame = spark.createDataFrame([p[:2] for p in pairs], "a array<double>, b array<double>")
    rows = frame.select(
        vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.semantic_similarity(F.col("a"), F.col("b")).alias("s")
    ).collect()
    for row, (_, _, cosine, semantic) in zip(rows, pairs):
        if cosine is not None:
            assert row.c == pytest.approx(cosine)
        assert row.s is None if semantic is None else row.s == pytest.approx(semantic)


def test_vector_faults(spark):
    nan, inf = float("nan"), float("inf")
    cases = [([1.0, 2.0], None), ([], "wrong shape"), ([1.0], "wrong shape"), ([nan, 1.0], "not finite"),
             ([-inf, 1.0], "not finite"), ([0.0, 0.0], "invalid norm"), (None, "wrong shape")]
    frame = spark.createDataFrame([(c[0],) for c in cases], "v array<double>")
    got = [r.f for r in frame.select(vec.vector_fault(F.col("v"), 2).alias("f")).collect()]
    assert got == [c[1] for c in cases]


def test_probabilities_and_score(spark):
    frame = spark.createDataFrame([([1.0, 3.0, 2.0],)], "l array<double>")
    total = sum(map(math.exp, (1, 3, 2)))
    row = frame.select(
        vec.softmax(F.col("l")).alias("p"),
        vec.factual_score(F.col("l")).alias("f"),
        vec.hallucination_score(F.lit(0.5), vec.factual_score(F.col("l"))).alias("h"),
        vec.best_class(F.col("l")).alias("i"),
        vec.best_class(F.col("l"), F.array(*map(F.lit, "abc"))).alias("name"),
        vec.class_scores(F.col("l"), F.array(*map(F.lit, "abc"))).alias("all"),
    ).first()
    assert row.p == pytest.approx([math.exp(x) / total for x in (1, 3, 2)])
    assert row.f == pytest.approx(math.exp(3) / total)
    assert row.h == pytest.approx(0.5 * (1 - row.f))
    assert (row.i, row.name) == (1, "b")
    assert [(s.label, s.score) for s in row.all] == [("b", 3.0), ("c", 2.0), ("a", 1.0)]


def test_best_class_query_ranks_every_class(spark, tmp_path):
    scores = [[float((7 * i + 5 * r) % 64) for i in range(64)] for r in range(3)] + [[1.0] * 64]
    rows = [(i, 0, s) for i, s in enumerate(scores)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for row in queries.best_class(spark, str(tmp_path)).collect():
        own = scores[row.position]
        order = sorted(range(64), key=lambda i: (-own[i], i))
        assert (row.best_class, row.score, row.last_score) == (f"class {order[0]}", max(own), min(own))
        assert row.ranking == ",".join(f"class {i}" for i in order)
