"""The test tables seen as questions, answers, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerlab.functions import text, vectors as vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """For work that is heavy per row: rows are few bytes, so deal them out to all cores.

    A table of many files is read by all cores as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if len(frame.inputFiles()) >= 2 * cores else frame.repartition(cores)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: (id, question, category)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("source").alias("category")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: every turn as a text (question_id, text)."""
    return spread(
        table(spark, sf_dir, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("question_id"), "text"
        )
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: the turns after the first are answers, a few of them blank."""
    turns = table(spark, sf_dir, "conversations").where("turn >= 1")
    return spread(turns).select(
        F.col("conv_id").alias("question_id"),
        (F.col("turn") - 1).cast("int").alias("position"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 != 0, F.col("text")).otherwise(" ").alias("response"),
    )


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: label is turn 0, clean answer turn 1, centre answer the last turn; a few of both are missing."""
    answer = F.col("turn") >= 1
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("question_id"))
        .agg(
            F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("label_gt"),
            F.max(F.when((F.col("turn") == 1) & (F.col("conv_id") % 13 != 5), F.col("text"))).alias("clean_response"),
            F.max_by("text", F.when(answer & (F.col("conv_id") % 17 != 3), F.col("turn"))).alias("center_response"),
        )
    )


CATEGORISED_SQL = """
CASE turn % 3 WHEN 0 THEN 'nonsense: ' || text WHEN 1 THEN '2) OBSCURE ' || text ELSE text END
"""


def categorised_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """conversations: answers with gaps, at position 1 for all, and questions with numbered categories."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.where("turn >= 1 and turn <> 2 and (conv_id + turn) % 3 <> 0").select(
        F.col("conv_id").alias("question_id"),
        (F.col("turn") - 1).cast("int").alias("position"),
        F.expr(CATEGORISED_SQL).alias("response"),
    )
    questions = turns.groupBy(F.col("conv_id").alias("question_id")).agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("label_gt"),
        F.max_by(F.expr(CATEGORISED_SQL), "turn").alias("center_response"),
    )
    category = F.when(F.col("question_id") % 2 == 0, "4. Nonsense").otherwise(" (1) obscure")
    return spread(rows), questions.withColumn("category", category)


def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the lines of a text as an answer list."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", F.split("text", "\n", -1).alias("responses"))


def as_literal(values: Column) -> Column:
    """An array of texts as a Python literal: quotes in turn, backslashes and tabs escaped, blanks as None."""

    def written(value: Column, place: Column) -> Column:
        kept = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
        single = F.concat(F.lit("'"), F.replace(kept, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), F.replace(F.replace(kept, F.lit('"'), F.lit('\\"')), F.lit("é"), F.lit("\\xe9")), F.lit('"'))
        return F.when(value == "", "None").when(place % 2 == 0, single).otherwise(double)

    return F.concat(F.lit("["), F.array_join(F.transform(values, written), ", "), F.lit("]"))


def line_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: lines as answers, the first line with text as label and the last one as centre."""
    with_text = F.filter("responses", lambda line: ~text.is_blank(line))
    lists = line_lists(spark, sf_dir).select("doc_id", "responses", with_text.alias("lines"))
    return lists.where(F.exists("responses", lambda line: ~text.is_blank(line))).select(
        F.col("doc_id").alias("question_id"),
        "responses",
        F.get("lines", F.lit(0)).alias("label_gt"),
        F.element_at("lines", -1).alias("center_response"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: (question_id, position, v); positions are vec_ids, the lowest one is clean."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("question_id"),
        F.col("vec_id").alias("position"),
        vec.as_vector(F.col("embedding")).alias("v"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: (metric, value)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")


# Answer and label texts made from events, for Spark and for the oracle.
ANSWER_SQL = """
CASE WHEN event_id % 8 = 6 THEN '  ' ELSE
CASE event_id % 8
  WHEN 0 THEN '(1) Did_not_Happen, says ' || event_type
  WHEN 1 THEN ' *7: Far_Future* / ' || event_type
  WHEN 2 THEN 'nonsense; see ' || props
  WHEN 3 THEN '`NONSENSE` of kind ' || event_type
  WHEN 4 THEN event_type || ' is obscure'
  WHEN 5 THEN 'nonsensegroup ' || event_type
  ELSE 'obscure' END ||
CASE user_id % 5
  WHEN 0 THEN ' TRUE.'
  WHEN 1 THEN ' (false)'
  WHEN 2 THEN ' untrue'
  WHEN 3 THEN ' True or False'
  ELSE '' END END
"""
LABEL_SQL = """
CASE event_id % 5
  WHEN 0 THEN 'did_not_happen'
  WHEN 1 THEN ' (2) Far_Future'
  WHEN 2 THEN 'NONSENSE'
  WHEN 3 THEN '4. obscure '
  ELSE 'ordinary  answer' END
"""


def option_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: (event_id, answer, label)."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr(ANSWER_SQL).alias("answer"), F.expr(LABEL_SQL).alias("label")
    )
