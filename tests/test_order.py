"""Row numbers in file order, and tables without a key."""

import csv

import pytest
from pyspark.sql import functions as F

from answerlab.operators.sampling import stratified_sample
from answerlab.sources import sinks, tables
from answerlab.sources.order import number_rows


def numbered(frame, **options):
    return [(r.x, r.n) for r in number_rows(frame, "n", **options).orderBy("n").collect()]


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_parquet_of_any_parts(spark, tmp_path, parts, bound):
    rows = [(i * 7919 % 1000, f"t{i}") for i in range(1000)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "x int, t string").repartition(parts).write.parquet(path)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    expected = [r.x for file in files for r in spark.read.parquet(str(file)).collect()]
    # Also where files are cut into splits of a few bytes.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert numbered(spark.read.parquet(path), broadcast_bytes=bound) == list(zip(expected, range(1000), strict=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_text_files_and_quoted_line_breaks(spark, tmp_path):
    for part in range(5):
        (tmp_path / "lines").mkdir(exist_ok=True)
        (tmp_path / "lines" / f"p{part}.csv").write_text("x\n" + "".join(f"{part * 1000 + i}\n" for i in range(300 * part)))
    (tmp_path / "lines" / "empty.csv").write_text("x\n")
    expected = [(p * 1000 + i, 0) for p in range(5) for i in range(300 * p)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        found = numbered(spark.read.csv(str(tmp_path / "lines"), header=True, schema="x int"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(x, n) for n, (x, _) in enumerate(expected)]
    for part in range(3):
        with open(tmp_path / f"q{part}.csv", "w", newline="") as out:
            csv.writer(out).writerows([["x", "t"], *[[part * 10 + i, "two\nlines, \"quoted\""] for i in range(4)]])
    table = tables.read_table(spark, str(tmp_path / "q*.csv"), "csv")
    assert numbered(table) == [(str(p * 10 + i), 4 * p + i) for p in range(3) for i in range(4)]


def test_questions_of_many_parts_without_a_key(spark, tmp_path):
    rows = [(f"q{i}", f"c{i % 3}") for i in range(300)]
    path = str(tmp_path / "q")
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, category string")
    frame.repartitionByRange(9, "i").sortWithinPartitions("i").drop("i").write.parquet(path)
    questions = tables.read_questions(spark, path)
    assert sorted((r.id, r.question) for r in questions.collect()) == [(i, f"q{i}") for i in range(300)]
    # Skipping the first rows of each category needs their order.
    sample = stratified_sample(questions, sample_size=10, skip=85, seed=1, key="id", category="category")
    picked = [r.id for r in sample.collect()]
    assert len(picked) == 30 and min(picked) >= 255
    with pytest.raises(ValueError, match="needs a column 'id'"):
        tables.with_key(frame.where("i > 3").groupBy("question").agg(F.max("category")), "id")


def test_csv_has_the_rows_number(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "x int, t string")
    frame.repartition(4).write.parquet(str(tmp_path / "p"))
    out = sinks.parquet_to_csv(spark, str(tmp_path / "p"), str(tmp_path / "c"))
    table = tables.read_table(spark, out, "csv")
    assert table.columns == ["index", "x", "t"]
    source = number_rows(spark.read.parquet(str(tmp_path / "p")), "index")
    assert sorted((int(r["index"]), int(r["x"])) for r in table.collect()) == sorted((r["index"], r["x"]) for r in source.collect())
    with pytest.raises(ValueError, match="has a column"):
        sinks.parquet_to_csv(spark, out.replace("/c", "/p"), str(tmp_path / "d"), index="x")


def test_only_another_format_is_read_as_csv(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("question,category\nq,c\n")
    frame = spark.createDataFrame([("q", "c")], "question string, category string").coalesce(1)
    frame.write.parquet(str(tmp_path / "broken"))
    damaged = next((tmp_path / "broken").glob("*.parquet"))
    damaged.write_bytes(damaged.read_bytes()[:-40] + b"x" * 36 + b"PAR1")
    next((tmp_path / "broken").glob(".*.parquet.crc")).unlink()
    catalog = {name: tables.Dataset(str(tmp_path / name)) for name in ("plain.csv", "broken", "missing")}
    assert tables.read_dataset(spark, "plain.csv", catalog).count() == 1
    for name in ("broken", "missing"):
        with pytest.raises(Exception):  # noqa: B017 - Spark's own, of several classes
            tables.read_dataset(spark, name, catalog)
