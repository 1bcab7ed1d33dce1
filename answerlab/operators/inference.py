"""Model calls over distinct inputs, with the model given by the caller.

A model is a factory without arguments that returns a function from lists of inputs to a
list of results. It is called on the executor, once per task, so heavy imports and model
loading stay off the driver. Equal inputs are sent once, results are written to a table
before anything reads them (a second use calls nothing again), and they are joined back
by a digest of the input.

A task sends its inputs by length, in batches that stay within a budget of tokens when every input is padded to the
longest one. A batch that fails is halved until the inputs that fail are alone. With a :class:`Journal` results
outlive the application: they are written slice by slice, and what is there is never called again.
"""

from __future__ import annotations

import functools
import operator
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import text
from answerlab.functions.vectors import vector_fault
from answerlab.plans.skew import attach, measure_groups, salt, summarise_counts
from answerlab.session import COALESCE, arrow_batches, materialise, settings

# Fixed value: most inputs per model call.
BATCH_SIZE = 32
#: Most tokens per model call, padding included, and characters to a token.
TOKEN_BUDGET = 16_384
CHARS_PER_TOKEN = 4
#: Results that a task hands over together, at least.
RESULTS = 512
#: Rows with the same first input that are kept together on their way to the model, and bytes of a batch that goes to Python.
ROWS_TOGETHER = 20_000
BATCH_BYTES = 4 << 20
_ID, _SIZE, _FIRST, _ROW = "_input_id", "_tokens", "_first", "_row"


@dataclass(frozen=True)
class Journal:
    """Where the results of a model are kept for later runs, in a folder that all runs share.

    ``model`` names all that decides a result: the model, its version and its settings. A job that dies loses
    the slice it was at, of about ``slice_inputs`` inputs.
    """

    path: str
    model: str
    slice_inputs: int = 100_000

    @property
    def folder(self) -> str:
        if not re.fullmatch(r"[\w.@+-]+", self.model):
            raise ValueError(f"a model's name has letters, digits and . @ + - _ only, not {self.model!r}")
        return f"{self.path.rstrip('/')}/{self.model}"


def _packer() -> Callable:
    # Made here, so that it travels to workers whole.
    def packed(sizes: list[int], batch_size: int, budget: int, last: bool = True) -> tuple[list[int], int]:
        """(ends of the batches, inputs in them) for inputs by rising size; without ``last`` the open batch waits.

        A batch of n inputs takes n times its largest size; an input beyond the budget is a batch of its own.
        """
        ends, begin = [], 0
        for index, size in enumerate(sizes):
            count = index - begin + 1
            if count > 1 and (count > batch_size or count * size > budget):
                ends.append(index)
                begin = index
        if last and begin < len(sizes):
            ends.append(len(sizes))
        return ends, ends[-1] if ends else 0

    return packed


packed = _packer()


def _caller(make: Callable, inputs: list[str], batch_size: int, budget: int):
    packed, most = _packer(), RESULTS

    def results(call, columns):
        """(answer, error) of every input; a batch that fails is tried again by halves."""
        count = len(columns[0])
        try:
            answers = list(call(*columns))
        except Exception as failure:  # noqa: BLE001 - the text of any failure goes into the row
            if count == 1:
                return [(None, f"{type(failure).__name__}: {failure}")]
            half = count // 2
            return results(call, [c[:half] for c in columns]) + results(call, [c[half:] for c in columns])
        if len(answers) != count:
            wrong = f"the model returned {len(answers)} results for {count} input{'s' if count > 1 else ''}"
            if count == 1:
                return [(None, f"ValueError: {wrong}")]
            raise ValueError(wrong)
        return [(answer, None) for answer in answers]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, held = None, None

        def table(ids, rows, pairs):
            return pd.DataFrame(
                {
                    "_input_id": ids,
                    "rows": rows,
                    "result": pd.Series([answer for answer, _ in pairs], dtype=object),
                    "error": pd.Series([error for _, error in pairs], dtype=object),
                }
            )

        def sent(frame, last):
            nonlocal call
            ends, done = packed(frame["_tokens"].tolist(), batch_size, budget, last)
            texts = [frame[name].tolist() for name in inputs]
            ids, rows = frame["_input_id"].tolist(), frame["rows"].tolist()
            # A frame for every call would cost more than a quick model: results of several calls go out together.
            begin, pairs = 0, []
            for start, end in zip([0, *ends], ends, strict=False):
                call = call or make()
                pairs += results(call, [column[start:end] for column in texts])
                if end - begin >= most:
                    yield table(ids[begin:end], rows[begin:end], pairs)
                    begin, pairs = end, []
            if pairs:
                yield table(ids[begin:done], rows[begin:done], pairs)
            return frame.iloc[done:]

        for frame in batches:
            # The open batch goes on with the next rows.
            held = frame if held is None or held.empty else pd.concat([held, frame], ignore_index=True)
            held = yield from sent(held, False)
        if held is not None and not held.empty:
            yield from sent(held, True)

    return run


def input_id(inputs: list[str]) -> Column:
    """A digest of the input texts, null where one is; lengths keep neighbouring texts apart."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in inputs]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def call_distinct(
    rows: DataFrame,
    inputs: list[str],
    make: Callable,
    result_type: str,
    batch_size: int = BATCH_SIZE,
    tasks: int | None = None,
    token_budget: int = TOKEN_BUDGET,
    journal: Journal | None = None,
) -> DataFrame:
    """A written table with one row per distinct input: its digest, how many rows have it, result, error.

    ``tasks`` is the number of tasks that call the model, so it bounds the calls at one time. With a journal only
    inputs that it holds no result of are sent; inputs that failed are sent again.
    """
    if batch_size < 1 or token_budget < 1:
        raise ValueError("batch_size and token_budget must be at least 1")
    known = rows.where(functools.reduce(operator.and_, [F.col(name).isNotNull() for name in inputs]))
    known = known.select(input_id(inputs).alias(_ID), *inputs)
    spark = rows.sparkSession
    # Inputs are few bytes and much work, so their number of tasks does not follow their size.
    parts = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def called(part: DataFrame) -> DataFrame:
        size = F.ceil(sum((F.length(name) for name in inputs), F.lit(0)) / CHARS_PER_TOKEN)
        dealt = part.withColumn(_SIZE, F.greatest(size, F.lit(1)))
        return dealt.sortWithinPartitions(_SIZE, _ID).mapInPandas(
            _caller(make, inputs, batch_size, token_budget), f"{_ID} binary, rows bigint, result {result_type}, error string"
        )

    with arrow_batches(spark, BATCH_BYTES):
        if journal is not None:
            distinct = materialise(_distinct(known, inputs))
            return _journaled(distinct, lambda part: called(part.repartition(parts)), result_type, journal)
        if len(inputs) > 1:
            return materialise(called(_distinct_together(known, inputs, parts)))
        if tasks:
            return materialise(called(_distinct(known, inputs).repartition(parts)))
        # What is reduced is dealt by its digests already: sent on as it is, the texts are shuffled once.
        with settings(spark, {COALESCE: "false"}):
            return materialise(called(_distinct(known, inputs)))


def _distinct(known: DataFrame, inputs: list[str], *together: str) -> DataFrame:
    """The distinct inputs with their rows. Equal inputs are reduced before and after the shuffle, and counted on the way."""
    firsts = [F.first(name).alias(name) for name in inputs]
    return known.groupBy(*together, _ID).agg(*firsts, F.count(F.lit(1)).alias("rows"))


def _distinct_together(known: DataFrame, inputs: list[str], parts: int) -> DataFrame:
    """The same in ``parts`` partitions, with the inputs that have the first text in common beside each other.

    So a text that is compared with many others lies in the shuffle once after the other, which compresses to little
    more than one, where the rows dealt by digests of the whole input would each carry it. A first text of very many
    rows is reduced like any input and dealt over several partitions.
    """
    # Only a place to meet: inputs are told apart by their digests.
    known = known.withColumn(_FIRST, F.xxhash64(inputs[0]))
    sizes = measure_groups(known, _FIRST, ROWS_TOGETHER)
    rows, group = known.withColumn("rows", F.lit(1).cast("bigint")), [_FIRST]
    if sizes.has_large:
        group = [_FIRST, "_salt"]
        large = F.broadcast(sizes.large())
        share = F.pmod(F.xxhash64(_ID), F.col("salts")).cast("int")
        hot = known.join(large, _FIRST).withColumn("_salt", share)
        rows = rows.join(large, _FIRST, "left_anti").withColumn("_salt", F.lit(0))
        rows = rows.unionByName(_distinct(hot, inputs, *group))
    firsts = [F.first(name).alias(name) for name in inputs]
    return rows.repartition(parts, *group).groupBy(*group, _ID).agg(*firsts, F.sum("rows").alias("rows")).drop(*group)


def _journaled(distinct: DataFrame, called: Callable, result_type: str, journal: Journal) -> DataFrame:
    """Results of the distinct inputs from the journal, after what it lacks was called slice by slice."""
    spark, run = distinct.sparkSession, uuid.uuid4().hex
    # In the folder the digests are hexadecimal.
    schema = f"{_ID} string, result {result_type}, error string, run string"

    def held() -> DataFrame:
        return spark.read.schema(schema).parquet(journal.folder).withColumn(_ID, F.unhex(_ID))

    try:
        missing = distinct.join(held().where("error IS NULL"), _ID, "left_anti")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = distinct
    missing = materialise(missing)
    slices = max(1, -(-missing.count() // journal.slice_inputs))
    for number in range(slices):
        part = missing if slices == 1 else missing.where(F.pmod(F.xxhash64(_ID), F.lit(slices)) == number)
        # Spark puts the files of a job in place when all of them are whole.
        results = called(part).select(F.lower(F.hex(_ID)).alias(_ID), "result", "error", F.lit(run).alias("run"))
        results.write.mode("append").parquet(journal.folder)
    # A result of any run, and else the failure of this one; two runs at once may both have a result.
    usable = held().where((F.col("error").isNull()) | (F.col("run") == run)).join(distinct, _ID)
    best = F.max_by(F.struct("rows", "result", "error"), F.struct(F.col("error").isNull(), "run")).alias("best")
    return materialise(usable.groupBy(_ID).agg(best).select(_ID, "best.*"))


def identified(rows: DataFrame, ids: dict[str, list[str]]) -> DataFrame:
    """Add the digests that ``ids`` names of their inputs, for :func:`put_back_by`, and a hash of the row."""
    row_hash = F.xxhash64(*[F.col(c) for c in rows.columns if _hashable(rows, c)])
    # Rows without an input match nothing; an id of their own keeps them from piling up in one task.
    no_input = F.concat(F.lit("-"), row_hash.cast("string")).cast("binary")
    return rows.withColumns({name: F.coalesce(input_id(inputs), no_input) for name, inputs in ids.items()} | {_ROW: row_hash})


def put_back_by(rows: DataFrame, name: str, called: DataFrame, result: str) -> DataFrame:
    """Add ``result`` and ``<result>_error`` to rows of :func:`identified` by a digest they have.

    The digests and the hash were made before, so texts that nothing reads afterwards are not shuffled.
    """
    called = called.withColumnRenamed(_ID, name)
    sizes = summarise_counts(called.select(name, "rows"), name)
    results = called.select(name, F.col("result").alias(result), F.col("error").alias(f"{result}_error"))
    # Rows with the same input differ in their other columns, such as question and position.
    spread = salt(rows, sizes, F.col(_ROW))
    return attach(spread, results, sizes, how="left").drop("_salt")


def put_back(rows: DataFrame, inputs: list[str], called: DataFrame, result: str) -> DataFrame:
    """Add ``result`` and ``<result>_error`` from a table of :func:`call_distinct`, by input."""
    return put_back_by(identified(rows, {_ID: inputs}), _ID, called, result).drop(_ID, _ROW)


def call_model(rows: DataFrame, inputs: list[str], make: Callable, result_type: str, result: str, **options) -> DataFrame:
    """Add ``result`` and ``<result>_error``; rows with a null input get null in both. Options of :func:`call_distinct`."""
    called = call_distinct(rows, inputs, make, result_type, **options)
    return put_back(rows, inputs, called, result)


def _hashable(rows: DataFrame, column: str) -> bool:
    kind = rows.schema[column].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind


def generate_answers(prompts: DataFrame, make: Callable, **options) -> DataFrame:
    """Add ``response`` for every ``prompt``."""
    return call_model(prompts, ["prompt"], make, "string", "response", **options)


def translate_back(sentences: DataFrame, make: Callable, there: str, back: str, **options) -> DataFrame:
    """Noise by translating there and back: ``text_edited``, "" for blank input or a failed call."""

    def asked(frame: DataFrame, task: str, source: str) -> DataFrame:
        prompt = F.when(F.coalesce(F.col(source), F.lit("")) != "", F.concat(F.lit(task + "\n\n"), source))
        answered = generate_answers(frame.withColumn("prompt", prompt), make, **options)
        answer = F.coalesce(text.strip(F.col("response")), F.lit(""))
        return answered.withColumn("text_edited", answer).drop("prompt", "response", "response_error")

    return asked(asked(sentences, there, "text"), back, "text_edited")


def embed_texts(rows: DataFrame, make: Callable, column: str = "text", **options) -> DataFrame:
    """Add vector ``v`` of the cleaned text, and ``v_fault`` naming an unusable vector."""
    cleaned = rows.withColumn("_embedded", text.embedding_text(F.col(column)))
    embedded = call_model(cleaned, ["_embedded"], make, "array<double>", "v", **options)
    return embedded.withColumn("v_fault", vector_fault(F.col("v"))).drop("_embedded")


def score_pairs(pairs: DataFrame, make: Callable, metric: str, **options) -> DataFrame:
    """Add a metric of (reference, candidate); call once per metric so one model is loaded at a time."""
    return call_model(pairs, ["reference", "candidate"], make, "double", metric, **options)
