import pytest
from pyspark.sql import functions as F

from answerlab.operators import validate
from answerlab.sources import sinks, tables


def test_questions_from_csv_with_mark_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes(b'\xef\xbb\xbfid,question,category\n0,"Say ""hi"",\nplease",N/A\n1,plain,\n')
    rows = tables.read_questions(spark, str(path), "csv").orderBy("id").collect()
    assert [(r.question, r.category) for r in rows] == [('Say "hi",\nplease', "N/A"), ("plain", None)]
    keyed = tables.read_questions(spark, str(path), "csv", key="row").orderBy("row").collect()
    assert [(r.row, r.id) for r in keyed] == [(0, "0"), (1, "1")]


def test_missing_columns_and_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,question\n1,x\n")
    with pytest.raises(ValueError, match="missing required column.*category"):
        tables.read_questions(spark, str(tmp_path / "a.csv"), "csv")
    (tmp_path / "b.csv").write_text("LLM_response,center_response,label_gt\n")
    with pytest.raises(ValueError, match="no data rows"):
        tables.read_responses(spark, str(tmp_path / "b.csv"), "csv")
    with pytest.raises(ValueError, match="center_response, label_gt"):
        validate.require_columns(spark.createDataFrame([(1,)], "LLM_response int"), tables.RESPONSE_COLUMNS)


def test_responses_from_csv_and_parquet(spark, tmp_path):
    values = ["['a', '', None, ' b ']", "", "('x',)", "[1, 2.5, float]", "['\\x85', 'é']"]
    frame = spark.createDataFrame(
        [(i, v, "c", "N/A") for i, v in enumerate(values) if "float" not in v],
        "id int, LLM_response string, center_response string, label_gt string",
    )
    out = sinks.write_table(frame.coalesce(1), str(tmp_path / "in"), [], format="csv")
    many = sinks.write_table(frame.repartition(3, "id"), str(tmp_path / "many"), [], format="csv")
    assert sorted(r.question_id for r in tables.read_responses(spark, many, "csv").collect()) == [0, 1, 2, 3]
    assert tables.read_responses(spark, many, "csv", key="id").count() == 4
    read = tables.read_responses(spark, out, "csv")
    assert "question_id" in read.columns
    got = {r.id: (r.responses, r.label_gt) for r in read.collect()}
    assert got == {"0": (["a", None, None, " b "], "N/A"), "1": ([], "N/A"), "2": (["x"], "N/A"), "4": ([None, "é"], "N/A")}
    nested = read.withColumnRenamed("responses", "LLM_response")
    sinks.write_table(nested, str(tmp_path / "pq"), [])
    again = tables.read_responses(spark, str(tmp_path / "pq"))
    assert {r.id: r.responses for r in again.collect()} == {k: v[0] for k, v in got.items()}


@pytest.mark.parametrize("value, message", [("[1, ", "not a valid list"), ("'text'", "not a list"), ("[['x']]", "must be text")])
def test_bad_lists_name_the_value(spark, value, message):
    frame = spark.createDataFrame([(value,)], "x string")
    with pytest.raises(Exception, match=f"row 7: .*{message}"):
        frame.select(tables.decode_list(F.col("x"), F.lit(7))).collect()


def test_python_literals(spark):
    import ast

    literals = [
        "['it\\'s', \"a \\\"b\\\" 'c'\", '']",
        "['back\\\\', '\\\\n', '\\n\\t\\r', \"\\x41\\u00e9\\U0001f600\\101\\0\"]",
        "( 'a' , None,\n \"[x, 'y']\" , )",
        "[]",
        "()",
        "['a, b', '), (', '#']",
        "[ None ]",
        "['" + "long \\n \\' text " * 3000 + "']",
        repr([f"item {i}" for i in range(2000)]),
    ]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(literals)], "i int, x string")
    rows = frame.select("i", tables.decode_list(F.col("x")).alias("r")).collect()
    assert {r.i: r.r for r in rows} == {i: list(ast.literal_eval(v)) for i, v in enumerate(literals)}
    for bad in ("['a',,]", "[,]", "['a'", "('x')", "a", "['a']]", "[b'x']", "[x]", "{'a': 1}"):
        with pytest.raises(Exception, match="list"):
            spark.createDataFrame([(bad,)], "x string").select(tables.decode_list(F.col("x"))).collect()


def test_named_data_sets(spark, tmp_path):
    frame = spark.createDataFrame([("q1", "test"), ("q2", "train")], "question string, split string")
    frame.write.parquet(str(tmp_path / "gsm"))
    (tmp_path / "plain.csv").write_text("question,category\nq,c\n")
    catalog = {
        "openai/gsm8k": tables.Dataset(str(tmp_path / "gsm")),
        "imdb": tables.Dataset(str(tmp_path / "plain.csv")),
    }
    assert [r.question for r in tables.read_dataset(spark, " OpenAI/GSM8K ", catalog).collect()] == ["q1"]
    with pytest.raises(ValueError, match="missing required column.*split"):
        tables.read_dataset(spark, "imdb", catalog)
    unsplit = {"own": tables.Dataset(str(tmp_path / "plain.csv"))}
    assert tables.read_dataset(spark, "own", unsplit).first().category == "c"
    with pytest.raises(ValueError, match="unknown data set 'other'"):
        tables.read_dataset(spark, "other", catalog)


def test_results_never_overwrite(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.5, "keep")], "id int, bleu double, extra string")
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    frame.write.parquet(source)
    for output in (source, f"file:{source}/", source + "/part", str(tmp_path), f"file://{source}"):
        with pytest.raises(ValueError, match="cannot overwrite"):
            sinks.write_scored(frame, ["bleu"], output, [source])
    sinks.write_scored(frame, ["bleu"], out, [source])
    assert (tmp_path / "out" / "_SUCCESS").exists()
    assert spark.read.parquet(out).columns == ["id", "extra", "bleu"]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_scored(frame, ["bleu"], out, [source])


def test_position_summary_file(spark, tmp_path):
    summary = spark.createDataFrame([(1, "P1", 0.25), (0, "C", 0.5), (None, "Center", None)], "position int, response_position string, mean_bleu double")
    out = sinks.write_position_summary(summary, str(tmp_path / "positions"), [])
    assert out.endswith("positions.csv")
    (part,) = [p for p in (tmp_path / "positions.csv").iterdir() if p.name.startswith("part-")]
    assert part.read_text().split("\n")[:4] == ["response_position,mean_bleu", "C,0.5", "P1,0.25", "Center,"]
    with pytest.raises(ValueError, match="csv"):
        sinks.write_position_summary(summary, str(tmp_path / "x.parquet"), [])


def test_parquet_to_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nover lines', None), (2, "é", "N/A")]
    spark.createDataFrame(rows, "id int, t string, n string").write.parquet(str(tmp_path / "p"))
    out = sinks.parquet_to_csv(spark, str(tmp_path / "p"), str(tmp_path / "c"))
    back = tables.read_table(spark, out, "csv").collect()
    assert sorted((int(r.id), r.t, r.n) for r in back) == rows


def test_score_count_check(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b")], "q int, comparison string")
    keys = ["q", "comparison"]
    validate.require_one_score_per_pair(pairs, pairs, keys)
    for wrong in (pairs.limit(1), pairs.union(pairs.limit(1)), pairs.withColumn("q", F.lit(2))):
        with pytest.raises(ValueError, match="scores for 2 pairs"):
            validate.require_one_score_per_pair(wrong, pairs, keys)


def test_category_checks(spark):
    frame = spark.createDataFrame([(1, "4. Obscure"), (2, "I have no answer")], "id int, label_gt string")
    assert validate.uses_categories(frame, "mbzuai") and not validate.uses_categories(frame, "imdb")
    assert not validate.uses_categories(frame)
    with pytest.raises(ValueError, match="row 2: invalid category 'I have no answer'"):
        validate.require_categories(frame, "id")
    validate.require_categories(frame.where("id = 1"), "id")
    named = frame.withColumn("dataset_name", F.lit(" MBZUAI"))
    assert validate.uses_categories(named)
    assert not validate.uses_categories(named.withColumn("dataset_name", F.when(F.col("id") == 1, "mbzuai").otherwise("x")))
