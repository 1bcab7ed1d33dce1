"""One query per operator, over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from answerlab.functions import spans, text, vectors as vec
from answerlab.jobs import analysis, generate as gen, review as review_job
from answerlab.operators import (
    centre,
    ensemble,
    inference,
    noise,
    pairs,
    review,
    sampling,
    stats,
    thesaurus,
    validate,
)
from answerlab.operators.bleu import with_bleu
from answerlab.operators.hallucination import HallucinationModels
from answerlab.plans.skew import attach, measure_groups, salt
from answerlab.session import materialise, shared_folder
from answerlab.sources import sinks, versions
from answerlab.sources.order import number_rows
from answerlab.sources.tables import decode_list, read_table
from bindings import standins, views

METRICS = ["click", "view", "purchase", "signup", "error", "refund"]
SAMPLE, SKIP, SEED = 20, 10, 7
LARGE_SAMPLE, LARGE_SKIP = 1200, 1100


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
    )


def long_ints(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in frame.dtypes])


def finished(frame: DataFrame) -> DataFrame:
    return long_ints(rounded(frame))


# --- sources -------------------------------------------------------------------------


def src_questions(spark, sf):
    return views.questions(spark, sf)


def src_responses(spark, sf):
    answers = views.answers(spark, sf)
    labels = views.answered_questions(spark, sf).select("question_id", "label_gt")
    sizes = measure_groups(answers, "question_id")
    return long_ints(attach(salt(answers, sizes, F.col("position")), labels, sizes).drop("_salt"))


def decode_lists(spark, sf):
    lists = views.line_lists(spark, sf).withColumn("serialised", views.as_literal(F.col("responses")))
    decoded = lists.select("doc_id", pairs.blanks_to_null(decode_list(F.col("serialised"), F.col("doc_id"))).alias("r"))
    return long_ints(
        decoded.select(
            "doc_id",
            F.size("r").alias("answers"),
            F.size(F.filter("r", lambda x: x.isNull())).alias("blanks"),
            F.md5(F.array_join("r", "|", "<null>")).alias("digest"),
        )
    )


def decoded_literals(spark, sf):
    """Every document in five spellings of a literal, with the private characters that some readers hold escapes by."""
    whole = F.concat(F.col("text"), F.lit("\ue000\ue001\ue002\ue003"))
    escaped = whole
    for meant, spelling in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(meant), F.lit(spelling))
    tripled = F.replace(F.replace(whole, F.lit("\\"), F.lit("\\134")), F.lit('"'), F.lit("\\x22"))
    raw = F.regexp_replace(F.col("text"), r"['\\\r\n]", " ")
    half = F.floor(F.length("text") / 2).cast("int")
    left = F.replace(F.replace(F.left("text", half), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\u000a"))
    parts = ["[u'", escaped, "', None,\n\"\"\"", tripled, "\"\"\" , r'", raw, "', '", F.replace(left, F.lit("'"), F.lit("\\'"))]
    parts += ["' # halves, ]\n '\\N{LATIN SMALL LETTER A}\\\n\\d', 1_0]"]
    serialised = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    items = views.spread(views.table(spark, sf, "documents")).select("doc_id", decode_list(serialised, F.col("doc_id")).alias("r"))
    digests = [F.md5(F.get("r", F.lit(i))).alias(f"digest{i}") for i in (0, 2, 3, 4)]
    return long_ints(items.select("doc_id", F.size("r").alias("items"), F.get("r", F.lit(1)).isNull().alias("is_null"), *digests, F.get("r", F.lit(5)).alias("number")))


def _scratch(spark, name):
    """A new place in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def file_numbers(spark, sf):
    """documents as a table of many files without a key: numbers in file order, and what is left after skipping some."""
    path = _scratch(spark, "unkeyed")
    views.table(spark, sf, "documents").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    numbered = number_rows(spark.read.parquet(path), "row_number")
    return numbered.select("doc_id", "row_number", F.length("text").cast("bigint").alias("chars")).where("row_number >= 30")


def versioned_results(spark, sf):
    """The answers as a table, replaced by one made from it with a metric, then read by the pointer."""
    path = _scratch(spark, "versions")
    first = versions.replace_table(views.answers(spark, sf), path)
    scored = versions.read_current(spark, path).withColumn("chars", F.length("response").cast("bigint"))
    versions.replace_table(scored.where("position < 5"), path, expected=first)
    rows = versions.read_current(spark, path)
    return long_ints(rows.withColumn("version", F.lit(versions.current_version(spark, path))))


def run_summary(spark, sf):
    scored = _defaults(spark, sf).join(
        _medians(spark, sf).withColumnRenamed("question_id", "id"), F.col("question_id") == F.col("id"), "left"
    )
    return finished(
        stats.run_summary(
            scored,
            ["median_cosine", *SCORES, "center_similarity_mean"],
            ["accuracy_clean_vs_label"],
        )
    )


# --- projections and checks ----------------------------------------------------------


def first_response(spark, sf):
    return views.line_lists(spark, sf).select(
        "doc_id", pairs.first_response(F.col("responses")).alias("first_response")
    )


def blank_labels(spark, sf):
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label_gt"))
    documents = views.table(spark, sf, "documents").select("doc_id")
    return validate.blank_values(documents.join(labels, "doc_id", "left"), "label_gt", "doc_id")


def invalid_categories(spark, sf):
    return validate.invalid_categories(views.option_answers(spark, sf), "label", "event_id")


def bad_embeddings(spark, sf):
    broken = views.vectors(spark, sf).withColumn(
        "v",
        F.when(F.col("position") % 50 == 7, F.transform("v", lambda x: F.lit(0.0)))
        .when(F.col("position") % 50 == 13, F.transform("v", lambda x: F.lit(float("nan"))))
        .when(F.col("position") % 50 == 21, F.concat("v", F.array(F.lit(1.0))))
        .when(F.col("position") % 50 == 34, F.transform("v", lambda x: F.lit(float("-inf"))))
        .otherwise(F.col("v")),
    )
    return validate.vector_faults(broken, "position", dimension=64)


def skipped_rows(spark, sf):
    report = pairs.unavailable_report(views.answered_questions(spark, sf))
    return report.withColumn("empty_columns", F.array_join("empty_columns", ", "))


# --- joins ---------------------------------------------------------------------------


def comparison_pairs(spark, sf):
    return pairs.comparison_pairs(views.answered_questions(spark, sf))


def required_columns(spark, sf):
    """What a question table would need, held against two tables."""
    told = [
        validate.column_report(views.table(spark, sf, name), {"question", "category", "text", "lang", "turn"}).withColumn("source", F.lit(name))
        for name in ("documents", "conversations")
    ]
    return told[0].unionByName(told[1])


def score_faults(spark, sf):
    """Turns as pairs; some have no score and some two."""
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn")
    scores = turns.where("(conv_id + turn) % 7 <> 0")
    scores = scores.unionByName(scores.where("(conv_id + turn) % 5 = 0"))
    return long_ints(validate.score_faults(scores, turns, ["conv_id", "turn"]))


def category_datasets(spark, sf):
    """Names of data sets as people write them, and whether answers of them are judged by category."""
    name = F.expr("""CASE doc_id % 6 WHEN 0 THEN '  MBZUAI ' WHEN 1 THEN 'mbzuai/LaMini-Hallucination\\n' WHEN 2 THEN 'mbzuai2'
        WHEN 3 THEN lang WHEN 4 THEN source END""")
    return views.table(spark, sf, "documents").select("doc_id", text.is_category_dataset(name).alias("judged"))


def scored_rows(spark, sf):
    """Every question with its three comparisons: BLEU in the row, model scores put back by key."""
    questions = views.answered_questions(spark, sf)
    scored = questions
    for name, reference, candidate in pairs.COMPARISONS:
        scored = with_bleu(scored, f"bleu_{name}", reference, candidate)
    scores = inference.score_pairs(pairs.comparison_pairs(questions), standins.word_overlap(), "word_overlap")
    scattered = pairs.scatter_scores(scored, scores, ["word_overlap"])
    return finished(scattered.drop("label_gt", "clean_response", "center_response"))


def _review(spark, sf):
    """(sample, decisions): the sample is drawn once, from the two columns it needs, and written."""
    drawn = sampling.stratified_sample(views.questions(spark, sf).select("id", "category"), SAMPLE, SKIP, SEED)
    sample = materialise(drawn)
    labels = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "remove").otherwise("keep").alias("decision")
    )
    return sample, sample.select("id").join(labels, "id")


def review_decisions(spark, sf):
    return review.with_decisions(*_review(spark, sf)).select("id", "category", "decision")


def review_filtered(spark, sf):
    return review.keep_unremoved(views.questions(spark, sf), _review(spark, sf)[1])


def written_review(spark, sf):
    """The review job's files, read back: decisions, and whether the question is in the filtered copy."""
    sample, decisions = _review(spark, sf)
    path = _scratch(spark, "review")
    review_job.finish(views.questions(spark, sf), sample, decisions, path, [f"{sf}/documents.parquet"])
    left = spark.read.parquet(f"{path}/filtered").select("id", F.lit(True).alias("kept"))
    told = spark.read.parquet(f"{path}/decisions").select("id", "category", "decision")
    return told.join(left, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


# --- aggregations --------------------------------------------------------------------


def robust_centre(spark, sf):
    measured = centre.with_centre(views.vectors(spark, sf))
    return finished(measured.select("question_id", "position", "dist", "kept", "cos"))


def _centre(spark, sf):
    return centre.centre_metrics(centre.with_centre(views.vectors(spark, sf)))


def centre_response(spark, sf):
    return _centre(spark, sf).select("question_id", "center_position", "center_response")


def centre_consistency(spark, sf):
    return finished(
        _centre(spark, sf).select(
            "question_id", "center_similarity_mean", "clean_to_center_similarity", "cluster_dispersion"
        )
    )


SCORES = [
    "hallucination_score_clean_vs_label",
    "hallucination_score_center_vs_label",
    "hallucination_score_center_vs_clean",
]


def _defaults(spark, sf):
    """Benchmark items as questions; most have no vectors, and some no label."""
    items = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    labels = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("question_id"), F.col("quality").cast("double").alias("quality")
    )
    metrics = _centre(spark, sf)
    supported = F.col("quality") / 2
    scores = {
        SCORES[0]: vec.hallucination_score(F.col("clean_to_center_similarity"), supported),
        SCORES[1]: vec.hallucination_score(F.col("center_similarity_mean"), supported),
        SCORES[2]: vec.hallucination_score(F.col("clean_to_center_similarity"), F.lit(0.25)),
    }
    known = items.join(labels, "question_id", "left")
    scored = known.join(
        metrics.select("question_id", "clean_to_center_similarity", "center_similarity_mean"), "question_id", "left"
    )
    scored = scored.select(
        "question_id", F.col("quality").alias("accuracy_clean_vs_label"), *[c.alias(n) for n, c in scores.items()]
    )
    return centre.with_defaults(scored, metrics, SCORES)


def centre_defaults(spark, sf):
    return finished(_defaults(spark, sf).drop("accuracy_clean_vs_label", "center_response"))


def _against_clean(spark, sf):
    """Every vector with the clean vector of its question."""
    rows = views.vectors(spark, sf)
    clean = rows.groupBy("question_id").agg(F.min_by("v", "position").alias("clean"))
    sizes = measure_groups(rows, "question_id")
    return attach(salt(rows, sizes, F.col("position")), clean, sizes).drop("_salt")


def _medians(spark, sf):
    cosines = _against_clean(spark, sf).select("question_id", vec.cosine(F.col("v"), F.col("clean")).alias("cos"))
    return centre.median_similarity(cosines)


def median_cosine(spark, sf):
    return finished(_medians(spark, sf))


def bleu_pairs(spark, sf):
    rows = src_responses(spark, sf).where(~text.is_blank(F.col("response")))
    pair = rows.select(
        "question_id", "position", F.col("label_gt").alias("reference"), F.col("response").alias("candidate")
    )
    return finished(with_bleu(pair).select("question_id", "position", "bleu"))


def kl_confidence(spark, sf):
    rows = views.table(spark, sf, "events").select(
        F.col("event_type").alias("grp"),
        (F.hour("ts") % 3).alias("model"),
        (F.col("user_id") % 4).alias("class"),
        F.col("value").alias("prob"),
    )
    return finished(ensemble.kl_confidence(rows, [0, 1, 2, 3]))


def metric_stats(spark, sf):
    value = (
        F.when(F.col("event_id") % 50 == 0, "inf")
        .when(F.col("event_id") % 50 == 1, "n/a")
        .when(F.col("event_id") % 50 == 2, "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    events = views.table(spark, sf, "events")
    wide = events.select(*[F.when(F.col("event_type") == m, value).alias(m) for m in METRICS])
    return finished(stats.metric_statistics(wide, METRICS))


def _token_overlap(reference, candidate):
    mine, theirs = F.array_distinct(text.tokens(candidate)), F.array_distinct(text.tokens(reference))
    return F.try_divide(2.0 * F.size(F.array_intersect(mine, theirs)), F.size(mine) + F.size(theirs))


def position_metrics(spark, sf):
    scorers = analysis.Scorers({}, {"token_overlap": _token_overlap})
    means = analysis.analyze_long_positions(
        views.answers(spark, sf), views.answered_questions(spark, sf), scorers, true_false=True
    )
    return finished(means)


def written_positions(spark, sf):
    """The position summary as the CSV file it is written to, read back."""
    path = _scratch(spark, "positions")
    written = sinks.write_position_summary(position_metrics(spark, sf), path, [f"{sf}/conversations.parquet"])
    kinds = [(name, kind) for name, kind in position_metrics(spark, sf).dtypes if name != "position"]
    table = read_table(spark, written, "csv")
    return table.select(*[F.col(name).cast(kind) for name, kind in kinds])


def _judges():
    return analysis.Scorers({}, {}, HallucinationModels(standins.encoder(), standins.logits()))


def analyzed_rows(spark, sf):
    """The row job on answer lists."""
    scored, names = analysis.analyze_rows(views.line_responses(spark, sf), _judges(), true_false=True)
    return finished(scored.select("question_id", *names))


def analyzed_positions(spark, sf):
    """The position job on answer lists."""
    return finished(analysis.analyze_positions(views.line_responses(spark, sf), _judges(), true_false=True))


def gapped_positions(spark, sf):
    """The position job on long answers with missing positions, numbered labels and category accuracy."""
    answers, questions = views.categorised_answers(spark, sf)
    return finished(analysis.analyze_long_positions(answers, questions, dataset_name="mbzuai"))


def boxplot_stats(spark, sf):
    return finished(stats.box_plot_statistics(views.scores(spark, sf), METRICS))


def category_counts(spark, sf):
    return sampling.category_counts(views.questions(spark, sf))


def review_summary(spark, sf):
    sample, decisions = _review(spark, sf)
    filtered = review.keep_unremoved(views.questions(spark, sf).select("id"), decisions)
    return review.review_summary(review.with_decisions(sample, decisions), filtered)


def accuracy_summary(spark, sf):
    rows = views.option_answers(spark, sf)
    scored = rows.select(
        text.category_accuracy(text.normalize_category(F.col("label")), F.col("answer")).alias("category_accuracy"),
        text.boolean_accuracy(F.col("label"), F.col("answer")).alias("boolean_accuracy"),
    )
    return finished(stats.accuracy_summary(scored, ["category_accuracy", "boolean_accuracy"]))


# --- sampling ------------------------------------------------------------------------


def stratified_sample(spark, sf):
    questions = views.questions(spark, sf).select("id", "category")
    return long_ints(sampling.stratified_sample(questions, SAMPLE, SKIP, SEED).select("id", "category", "draw"))


def stratified_sample_events(spark, sf):
    events = views.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"))
    return long_ints(sampling.stratified_sample(events, SAMPLE, SKIP, SEED))


def stratified_sample_large(spark, sf):
    events = views.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"))
    return long_ints(sampling.stratified_sample(events, LARGE_SAMPLE, LARGE_SKIP, SEED))


def sample_shortfall(spark, sf):
    return long_ints(sampling.sample_shortfall(views.questions(spark, sf), 45, SKIP))


# --- functions -----------------------------------------------------------------------


def token_counts(spark, sf):
    questions = views.spread(views.questions(spark, sf).select("id", "question"))
    tokens = questions.select("id", text.tokens(F.col("question")).alias("t"))
    return long_ints(
        tokens.select("id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))
    )


def normalized_categories(spark, sf):
    rows = views.option_answers(spark, sf)
    return rows.select("event_id", text.normalize_category(F.col("label")).alias("category"))


def extracted_category(spark, sf):
    rows = views.option_answers(spark, sf)
    return rows.select("event_id", text.extract_category(F.col("answer")).alias("category"))


def category_accuracy(spark, sf):
    category = text.normalize_category(F.col("label"))
    return views.option_answers(spark, sf).select(
        "event_id", text.category_accuracy(category, F.col("answer")).alias("accuracy")
    )


def boolean_accuracy(spark, sf):
    return views.option_answers(spark, sf).select(
        "event_id", text.boolean_accuracy(F.col("label"), F.col("answer")).alias("accuracy")
    )


TEMPLATE = "Answer by True or False. Question: [DOCUMENT]\nAgain: [DOCUMENT]"


def rendered_prompts(spark, sf):
    return views.texts(spark, sf).select(
        "question_id", text.render_prompt(TEMPLATE, F.col("text")).alias("prompt")
    )


def embedding_text(spark, sf):
    return views.option_answers(spark, sf).select(
        "event_id", text.embedding_text(F.col("answer")).alias("embedding_text")
    )


def cosine_pairs(spark, sf):
    rows = _against_clean(spark, sf)
    return finished(
        rows.select(
            "question_id",
            "position",
            vec.cosine(F.col("v"), F.col("clean")).alias("cosine"),
            vec.semantic_similarity(F.col("v"), F.col("clean")).alias("semantic_similarity"),
        )
    )


def factual_score(spark, sf):
    rows = views.vectors(spark, sf)
    return finished(
        rows.select(
            "position",
            vec.factual_score(F.col("v")).alias("factual_score"),
            F.array_max(vec.softmax(F.col("v"))).alias("top_probability"),
        )
    )


def hallucination_score(spark, sf):
    semantic = vec.semantic_similarity(F.col("clean"), F.col("v"))
    score = vec.hallucination_score(semantic, vec.factual_score(F.col("v")))
    return finished(_against_clean(spark, sf).select("question_id", "position", score.alias("hallucination_score")))


def message_span(spark, sf):
    def token(name):
        return F.struct(F.lit(name).alias("token"), F.lit(None).cast("double").alias("logprob"))

    words = F.transform(
        F.split("text", " ", -1),
        lambda w: F.struct(w.alias("token"), (F.length(w) / F.lit(-10.0)).alias("logprob")),
    )
    opened = F.concat(
        F.array(token("<|start|>"), token("<|message|>")), words, F.array(token("<|end|>"), token("<|message|>"))
    )
    content = (
        F.when(F.col("role") == "assistant", F.concat(opened, words, F.array(token("<|return|>"), token("rest"))))
        .when(F.col("role") == "system", F.concat(opened, words))
        .otherwise(words)
    )
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", content.alias("content"))
    span = rows.select("conv_id", "turn", spans.message_span(F.col("content")).alias("span"))
    total = lambda field: F.aggregate("span", F.lit(0.0), lambda acc, x: acc + x[field])
    return finished(
        span.select(
            "conv_id",
            "turn",
            F.size("span").alias("tokens"),
            total("logprob").alias("logprob"),
            total("probability").alias("probability"),
            F.md5(F.array_join(F.transform("span", lambda x: x["token"]), " ")).alias("digest"),
        )
    )


def _classes():
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("class "), i.cast("string")))


def best_class(spark, sf):
    """The best class of a row with its score, and all classes, best first, with the last one's score."""
    listed = views.vectors(spark, sf).select("position", "v", vec.class_scores(F.col("v"), _classes()).alias("scores"))
    return finished(
        listed.select(
            "position",
            vec.best_class(F.col("v"), _classes()).alias("best_class"),
            F.array_max("v").alias("score"),
            F.array_join(F.transform("scores", lambda s: s["label"]), ",").alias("ranking"),
            F.element_at("scores", -1)["score"].alias("last_score"),
        )
    )


def class_ranking(spark, sf):
    """All classes of a row, best first."""
    listed = views.vectors(spark, sf).select("position", vec.class_scores(F.col("v"), _classes()).alias("scores"))
    ranking = F.array_join(F.transform("scores", lambda s: s["label"]), ",").alias("ranking")
    return finished(listed.select("position", ranking, F.element_at("scores", -1)["score"].alias("last_score")))


def synonym_table(spark, sf):
    rows = views.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("word"), "role", text.words(F.col("text")).alias("words")
    )
    even = F.filter("words", lambda w: F.length(w) % 2 == 0)
    odd = F.filter("words", lambda w: F.length(w) % 2 == 1)
    meta = F.to_json(F.struct(F.array(even).alias("syns")))
    sense = F.to_json(
        F.struct(F.array(F.transform(odd, lambda w: F.struct(w.alias("wd")))).alias("syn_list"))
    )
    answer = F.concat(
        F.lit('[{"meta":'), meta, F.lit(',"def":[{"sseq":[[["pseq",[]],["sense",'), sense, F.lit("]]]}]}]")
    )
    payload = F.when(F.col("role") == "assistant", answer).otherwise(F.to_json("words"))
    found = thesaurus.synonym_table(rows.select("word", payload.alias("payload")))
    return long_ints(
        found.select("word", F.size("synonyms").alias("n"), F.array_join("synonyms", ",").alias("synonyms"))
    )


# --- generation ----------------------------------------------------------------------


def variant_fanout(spark, sf):
    rows = noise.fan_out(views.questions(spark, sf).select("id", F.length("question").alias("chars")))
    return long_ints(rows)


def typo_variants(spark, sf):
    return long_ints(noise.typo_variants(views.texts(spark, sf)))


def compounded_typos(spark, sf):
    """Typos whose edits act one after the other."""
    return long_ints(noise.typo_variants(views.texts(spark, sf), compounding=True, variants=6))


def _lexicon(spark, sf):
    words = views.table(spark, sf, "benchmark").select(F.explode(text.words(F.lower("text"))).alias("word"))
    return words.distinct().select(
        "word",
        F.when(F.length("word") >= 4, "VERB").otherwise("NOUN").alias("pos"),
        F.array(F.reverse("word"), F.concat("word", F.lit("ing"))).alias("synonyms"),
    )


def synonym_variants(spark, sf):
    return long_ints(noise.synonym_variants(views.texts(spark, sf), _lexicon(spark, sf)))


def synonym_substrings(spark, sf):
    """Picked words replaced wherever their letters stand."""
    return long_ints(noise.synonym_variants(views.texts(spark, sf), _lexicon(spark, sf), whole_words=False))


def batch_generate(spark, sf):
    questions = views.spread(views.questions(spark, sf).select("id", "question"))
    prompts = questions.select("id", text.render_prompt(TEMPLATE, F.col("question")).alias("prompt"))
    return inference.generate_answers(prompts, standins.answers()).drop("prompt")


def back_translation(spark, sf):
    there, back = "Translate to Arabic:", "Translate to English:"
    return inference.translate_back(views.texts(spark, sf), standins.reverser(), there, back).drop("text")


def journaled_calls(spark, sf):
    """Every turn sent to a model with a journal, a part of them in an earlier run; and how often each input was sent."""
    rows = views.texts(spark, sf).withColumnRenamed("text", "prompt")
    journal = inference.Journal(_scratch(spark, "journal"), "stand-in@1")
    inference.generate_answers(rows.where(F.length("prompt") % 3 == 0), standins.answers(), journal=journal)
    answered = inference.generate_answers(rows, standins.answers(), journal=journal, token_budget=2000).drop("prompt")
    sent = spark.read.parquet(journal.folder).groupBy(F.col("result").alias("response")).agg(F.count(F.lit(1)).alias("sent"))
    return answered.join(sent, "response").select("question_id", "response", "response_error", "sent")


def batch_embed(spark, sf):
    rows = views.spread(views.questions(spark, sf).select("id", "question"))
    embedded = inference.embed_texts(rows, standins.encoder(), "question")
    return finished(embedded.select("id", "v_fault", F.posexplode("v").alias("dim", "value")))


def batch_pair_scores(spark, sf):
    scored = inference.score_pairs(
        pairs.comparison_pairs(views.answered_questions(spark, sf)), standins.word_overlap(), "word_overlap"
    )
    return finished(scored.drop("reference", "candidate"))


def _items(spark, sf):
    """Benchmark items as questions; some have no label."""
    label = F.when(F.col("item_id") % 7 == 3, None).when(F.col("item_id") % 2 == 0, "far_future").otherwise("factual")
    return views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), label.alias("category")
    )


def generated_answers(spark, sf):
    """The whole generation job over the benchmark questions, with stand-in models of which one fails at times."""
    models = gen.Models(standins.answers(failing=5), standins.encoder(), standins.logits())
    _, scored = gen.generate(_items(spark, sf), models, TEMPLATE)
    return finished(scored)


def generated_and_analyzed(spark, sf):
    """Generation and then the row job on what it made."""
    models = gen.Models(standins.answers(failing=5), standins.encoder(), standins.logits())
    items = _items(spark, sf).where("category is not null")
    table = gen.answer_table(*gen.generate(items, models, TEMPLATE))
    table = table.select("question_id", "responses", "center_response", "label_gt")
    scored, names = analysis.analyze_rows(table, true_false=True)
    return finished(scored.select("question_id", F.size("responses").alias("responses"), *names))


QUERIES = {
    query.__name__: query
    for query in (
        src_questions,
        src_responses,
        decode_lists,
        decoded_literals,
        file_numbers,
        versioned_results,
        run_summary,
        first_response,
        blank_labels,
        invalid_categories,
        bad_embeddings,
        skipped_rows,
        comparison_pairs,
        scored_rows,
        review_decisions,
        review_filtered,
        written_review,
        written_positions,
        required_columns,
        score_faults,
        category_datasets,
        robust_centre,
        centre_response,
        centre_consistency,
        centre_defaults,
        median_cosine,
        bleu_pairs,
        kl_confidence,
        metric_stats,
        position_metrics,
        analyzed_rows,
        analyzed_positions,
        gapped_positions,
        boxplot_stats,
        category_counts,
        review_summary,
        accuracy_summary,
        stratified_sample,
        stratified_sample_events,
        stratified_sample_large,
        sample_shortfall,
        token_counts,
        normalized_categories,
        extracted_category,
        category_accuracy,
        boolean_accuracy,
        rendered_prompts,
        embedding_text,
        cosine_pairs,
        factual_score,
        hallucination_score,
        message_span,
        best_class,
        class_ranking,
        synonym_table,
        variant_fanout,
        typo_variants,
        compounded_typos,
        synonym_variants,
        synonym_substrings,
        batch_generate,
        back_translation,
        journaled_calls,
        batch_embed,
        batch_pair_scores,
        generated_answers,
        generated_and_analyzed,
    )
}
