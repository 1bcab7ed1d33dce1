import pytest
from pyspark.sql import functions as F

from answerlab.operators import inference
from answerlab.plans import skew


def calls_factory(folder):
    """A model that notes every call in a file, so that calls can be counted."""

    def make():
        import os
        import uuid

        def call(prompts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(prompts))
            return [prompt.upper() for prompt in prompts]

        return call

    return make


def test_equal_inputs_are_sent_once_and_results_are_not_made_again(spark, tmp_path):
    rows = [(i, f"prompt {i % 5}") for i in range(100)] + [(100, None)]
    frame = spark.createDataFrame(rows, "id int, prompt string").repartition(4)
    answered = inference.generate_answers(frame, calls_factory(str(tmp_path)), batch_size=2, tasks=2)
    for _ in range(2):
        got = {r.id: r.response for r in answered.collect()}
        assert got == {i: p and p.upper() for i, p in rows}
    sent = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")]
    assert sorted(sent) == [f"prompt {i}" for i in range(5)]


def test_hot_input_is_salted(spark, tmp_path, monkeypatch):
    real = inference.summarise_counts
    monkeypatch.setattr(inference, "summarise_counts", lambda counts, key: real(counts, key, 10))
    frame = spark.createDataFrame([(i, "hot" if i % 2 else f"p{i}") for i in range(200)], "id int, prompt string")
    answered = inference.generate_answers(frame, calls_factory(str(tmp_path))).collect()
    assert {r.id: r.response for r in answered} == {i: "HOT" if i % 2 else f"P{i}" for i in range(200)}
    assert "_salt" not in answered[0].asDict()


def test_rows_without_input_do_not_share_a_join_key(spark):
    frame = spark.createDataFrame([(i, None if i else "x") for i in range(50)], "id int, prompt string")
    called = inference.call_distinct(frame, ["prompt"], lambda: lambda prompts: prompts, "string")
    joined = inference.put_back(frame, ["prompt"], called, "response")
    assert {r.id: r.response for r in joined.collect()} == {i: None if i else "x" for i in range(50)}
    keys = [c for c in joined._jdf.queryExecution().optimizedPlan().toString().split("\n") if "xxhash64" in c]
    assert keys, "rows without input need a key of their own"


def test_failures_stay_in_their_row(spark):
    def make():
        def call(prompts):
            if "bad" in prompts:
                raise RuntimeError("model says no")
            return [p + "!" for p in prompts]

        return call

    frame = spark.createDataFrame([("a",), ("bad",), ("b",)], "prompt string")
    rows = {r.prompt: r for r in inference.generate_answers(frame, make, tasks=1).collect()}
    assert (rows["a"].response, rows["b"].response, rows["bad"].response) == ("a!", "b!", None)
    assert rows["bad"].response_error == "RuntimeError: model says no" and rows["a"].response_error is None


def test_wrong_number_of_results_fails(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="1 results for 2 inputs"):
        inference.generate_answers(frame, lambda: lambda prompts: ["x"], tasks=1).collect()


def test_pair_scores_keep_direction(spark):
    frame = spark.createDataFrame([(1, "label", "answer"), (2, "clean answer", "x")], "id int, reference string, candidate string")
    make = lambda: lambda refs, cands: [float(len(r) - len(c)) for r, c in zip(refs, cands)]
    got = {r.id: r.gap for r in inference.score_pairs(frame, make, "gap").collect()}
    assert got == {1: -1.0, 2: 11.0}


def test_texts_that_join_alike_stay_apart(spark):
    frame = spark.createDataFrame([("ab", "c"), ("a", "bc")], "reference string, candidate string")
    assert frame.select(inference.input_id(["reference", "candidate"]).alias("i")).distinct().count() == 2


def test_embedding_cleans_text_and_marks_faults(spark):
    def make():
        return lambda values: [[0.0, 0.0] if v == "zero" else [float(len(v)), 1.0] for v in values]

    frame = spark.createDataFrame([("a\x00b",), (" ",), ("zero",)], "text string")
    rows = {r.text: r for r in inference.embed_texts(frame, make).collect()}
    assert rows["a\x00b"].v == [3.0, 1.0] and rows[" "].v == [16.0, 1.0]
    assert rows["zero"].v_fault == "invalid norm" and rows[" "].v_fault is None


def test_back_translation(spark):
    def make():
        def call(prompts):
            out = []
            for prompt in prompts:
                task, sentence = prompt.split("\n\n", 1)
                if sentence == "fails":
                    raise RuntimeError("no")
                out.append(f" <{task}>{sentence} ")
            return out

        return call

    frame = spark.createDataFrame([("hello",), ("",), ("fails",), (None,)], "text string")
    rows = {r.text: r.text_edited for r in inference.translate_back(frame, make, "there", "back").collect()}
    assert rows == {"hello": "<back><there>hello", "": "", "fails": "", None: ""}


def test_batch_size_is_checked(spark):
    frame = spark.createDataFrame([("a",)], "prompt string")
    with pytest.raises(ValueError, match="batch_size"):
        inference.generate_answers(frame, lambda: None, batch_size=0)


def test_broadcast_limit_is_a_size_check(spark):
    frame = spark.createDataFrame([(i,) for i in range(100)], "k int")
    sizes = skew.measure_groups(frame, "k")
    assert skew.fits_broadcast(sizes, 100) and not skew.fits_broadcast(sizes, 2**20)
    assert not skew.fits_broadcast(sizes, None)
    assert frame.select(F.lit(1)).count() == 100


def test_packing_stays_within_the_budget():
    sizes = sorted([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 500, 3, 3, 3, 3])
    for budget in (1, 10, 40, 120, 1000):
        for batch_size in (1, 4, 32):
            ends, done = inference.packed(sizes, batch_size, budget)
            assert done == len(sizes) and ends == sorted(set(ends))
            for a, b in zip([0, *ends], ends, strict=False):
                assert b - a == 1 or (b - a <= batch_size and (b - a) * sizes[b - 1] <= budget)
                # No batch could take the next input too.
                assert b == len(sizes) or b - a == batch_size or (b - a + 1) * sizes[b] > budget
            open_ends, held = inference.packed(sizes, batch_size, budget, last=False)
            assert open_ends == ends[:-1] and held == (ends[-2] if len(ends) > 1 else 0)


def test_batches_by_length_over_all_rows_of_a_task(spark, tmp_path):
    texts = [f"{i:04d}" + "x" * (i * 37 % 901) for i in range(700)]
    frame = spark.createDataFrame([(t,) for t in texts], "prompt string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        answered = inference.generate_answers(frame, calls_factory(str(tmp_path)), tasks=2, token_budget=1000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert {r.prompt: r.response for r in answered} == {t: t.upper() for t in texts}
    batches = [f.read_text().split("\n") for f in tmp_path.iterdir()]
    assert sorted(t for batch in batches for t in batch) == sorted(texts)
    for batch in batches:
        assert len(batch) <= 32 and (len(batch) == 1 or len(batch) * max(-(-len(t) // 4) for t in batch) <= 1000)
    # Padded, the texts take little more than they are; in any order they took about twice as much.
    padded = sum(len(batch) * max(map(len, batch)) for batch in batches)
    assert padded <= 1.25 * sum(map(len, texts)) and len(batches) <= 1.5 * sum(map(len, texts)) / 4000 + 700 / 32


def test_a_bad_input_costs_few_calls(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        def call(prompts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(prompts))
            if "p13" in prompts:
                raise RuntimeError("no")
            return prompts

        return call

    frame = spark.createDataFrame([(f"p{i:02d}",) for i in range(32)], "prompt string")
    rows = {r.prompt: r for r in inference.generate_answers(frame, make, tasks=1).collect()}
    assert [p for p, r in rows.items() if r.response is None] == ["p13"] and rows["p13"].response_error == "RuntimeError: no"
    assert len(list(tmp_path.iterdir())) == 1 + 2 * 5


def test_a_run_goes_on_where_the_last_one_died(spark, tmp_path):
    calls, journal = tmp_path / "calls", inference.Journal(str(tmp_path / "journal"), "fake@1", slice_inputs=25)
    calls.mkdir()
    folder, alive = str(calls), str(tmp_path / "alive")

    def make():
        import os
        import uuid

        def call(prompts):
            # The worker dies at about half of all inputs.
            done = sum(len(open(os.path.join(folder, f)).read().split("\n")) for f in os.listdir(folder))
            if done >= 100 and not os.path.exists(alive):
                os._exit(1)
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(prompts))
            return [p.upper() for p in prompts]

        return call

    def sent():
        return [line for f in calls.iterdir() for line in f.read_text().split("\n")]

    texts = [f"prompt {i}" for i in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "prompt string")
    with pytest.raises(Exception):  # noqa: B017 - of Spark
        inference.generate_answers(frame, make, journal=journal, batch_size=5, tasks=2)
    kept = {r["result"] for r in spark.read.parquet(journal.folder).collect()}
    assert 50 <= len(kept) < 150
    (tmp_path / "alive").touch()
    answered = inference.generate_answers(frame, make, journal=journal, batch_size=5, tasks=2)
    assert {r.prompt: r.response for r in answered.collect()} == {t: t.upper() for t in texts}
    again = [t for t in set(sent()) if sent().count(t) > 1]
    # What was kept was not called again; of the slice that died, at most that slice.
    assert not {t.upper() for t in again} & kept and len(again) <= 50
    count = len(sent())
    # A third run, and one of fewer inputs in another table, call nothing.
    for rows in (frame, frame.where("prompt LIKE '%7'")):
        assert inference.generate_answers(rows, make, journal=journal).where("response IS NULL").count() == 0
    assert len(sent()) == count


def test_failed_calls_are_sent_again_and_models_kept_apart(spark, tmp_path):
    journal = inference.Journal(str(tmp_path / "journal"), "m1")
    frame = spark.createDataFrame([("a",), ("bad",), ("b",), (None,)], "prompt string")

    def failing():
        def call(prompts):
            if "bad" in prompts:
                raise RuntimeError("no")
            return [p + "1" for p in prompts]

        return call

    rows = {r.prompt: r for r in inference.generate_answers(frame, failing, journal=journal).collect()}
    assert rows["bad"].response_error == "RuntimeError: no" and rows["a"].response == "a1" and rows[None].response is None
    second = inference.generate_answers(frame, lambda: lambda prompts: [p + "2" for p in prompts], journal=journal)
    assert {r.prompt: (r.response, r.response_error) for r in second.collect()} == {
        "a": ("a1", None), "b": ("b1", None), "bad": ("bad2", None), None: (None, None)
    }
    other = inference.Journal(str(tmp_path / "journal"), "m2")
    third = inference.generate_answers(frame, lambda: lambda prompts: [p + "3" for p in prompts], journal=other)
    assert {r.response for r in third.collect()} == {"a3", "b3", "bad3", None}
    with pytest.raises(ValueError, match="name"):
        inference.generate_answers(frame, failing, journal=inference.Journal(str(tmp_path), "a/b"))


def test_pairs_with_a_common_first_text_are_sent_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        def call(references, candidates):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(f"{r}|{c}" for r, c in zip(references, candidates)))
            return [float(len(r) * 1000 + len(c)) for r, c in zip(references, candidates)]

        return call

    monkeypatch.setattr(inference, "ROWS_TOGETHER", 20)
    # One reference of most rows, half of them the same pair, few of another one, and missing sides.
    rows = [(i, "hot" if i < 300 else f"r{i // 4}", "same" if i % 2 else "x" * (i % 90 + 1)) for i in range(400)]
    rows += [(400 + i, None if i % 2 else "hot", "same" if i % 2 else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, reference string, candidate string").repartition(5)
    for tasks in (None, 3):
        for f in tmp_path.iterdir():
            f.write_text("")
        scored = inference.score_pairs(frame, make, "gap", tasks=tasks).collect()
        assert {r.id: r.gap for r in scored} == {i: float(len(r) * 1000 + len(c)) if r and c else None for i, r, c in rows}
        sent = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n") if line]
        assert sorted(sent) == sorted({f"{r}|{c}" for _, r, c in rows if r and c})
        called = inference.call_distinct(frame, ["reference", "candidate"], make, "double", tasks=tasks)
        counts = [r.rows for r in called.collect()]
        assert max(counts) == 150 and sum(counts) == 400


def test_results_of_many_calls_go_out_together():
    import pandas as pd

    def make():
        return lambda texts: [f"<{text}>" for text in texts]

    for count in (0, 1, 700, 5000):
        frame = pd.DataFrame({"_input_id": [f"i{i}" for i in range(count)], "rows": 1, "t": [f"t{i}" for i in range(count)], "_tokens": 1})
        out = list(inference._caller(make, ["t"], 32, 1000)(iter([frame[: count // 3], frame[count // 3 :]])))
        assert [r for f in out for r in f["result"]] == [f"<t{i}>" for i in range(count)]
        assert [i for f in out for i in f["_input_id"]] == [f"i{i}" for i in range(count)]
        assert len(out) <= 3 + count // inference.RESULTS
