"""The same results in DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from answerlab.functions.text import WHITESPACE
from bindings.queries import LARGE_SAMPLE, LARGE_SKIP, METRICS, SAMPLE, SEED, SKIP, TEMPLATE
from bindings.views import ANSWER_SQL, CATEGORISED_SQL, LABEL_SQL

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {quoted(WHITESPACE)})"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[{WORD}]+|[^{WORD}{SPACE}]')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[{WORD}]+')"


def category(x: str) -> str:
    collapsed = f"regexp_replace({fold(strip(x))}, '[{SPACE}]+', ' ', 'g')"
    return rf"regexp_replace({collapsed}, '^\(?\p{{Nd}}+\)?[.:)\-]?[{SPACE}]*', '')"


def extracted(x: str) -> str:
    decoration = f"[{SPACE}*_''\"`]*"
    pattern = (
        rf"(?i)^{decoration}(?:\(?\p{{Nd}}+\)?[.:)\-]?[{SPACE}]*)?{decoration}"
        rf"(did_not_happen|far_future|nonsense|obscure)(?:[^{WORD}]|$)"
    )
    return f"nullif(lower(regexp_extract({x}, '{pattern}', 1)), '')"


FOUR = "('did_not_happen', 'far_future', 'nonsense', 'obscure')"


def category_hit(label: str, answer: str) -> str:
    hit = f"coalesce({extracted(answer)} = {category(label)}, false)"
    return f"CASE WHEN {blank(answer)} THEN NULL ELSE CAST({hit} AS DOUBLE) END"


def boolean_hit(label: str, answer: str) -> str:
    joined = f"regexp_replace({fold(strip(label))}, '[{SPACE}]+', '_', 'g')"
    said = words(fold(answer))
    yes, no = f"list_contains({said}, 'true')", f"list_contains({said}, 'false')"
    right = f"CASE WHEN {joined} IN {FOUR} THEN {yes} AND NOT {no} ELSE {no} AND NOT {yes} END"
    return f"CASE WHEN {blank(answer)} THEN NULL ELSE CAST({right} AS DOUBLE) END"


ANSWERS = """
answers AS (
  SELECT conv_id AS question_id, turn - 1 AS position,
         CASE WHEN (conv_id + turn) % 11 <> 0 THEN text ELSE ' ' END AS response
  FROM conversations WHERE turn >= 1)"""
ANSWERED = """
answered AS (
  SELECT conv_id AS question_id,
         max(text) FILTER (turn = 0) AS label_gt,
         max(text) FILTER (turn = 1 AND conv_id % 13 <> 5) AS clean_response,
         arg_max(text, turn) FILTER (turn >= 1 AND conv_id % 17 <> 3) AS center_response
  FROM conversations GROUP BY conv_id)"""
PAIRS = f"""
pairs AS (
  SELECT question_id, comparison, reference, candidate FROM (
    SELECT question_id, 'clean_vs_label' AS comparison, label_gt AS reference, clean_response AS candidate FROM answered
    UNION ALL SELECT question_id, 'center_vs_label', label_gt, center_response FROM answered
    UNION ALL SELECT question_id, 'center_vs_clean', clean_response, center_response FROM answered)
  WHERE NOT {blank("reference")} AND NOT {blank("candidate")})"""


def bleu(source: str, key: str) -> str:
    """CTEs ending in ``bleu(key.., bleu)`` for a relation with key columns, reference and candidate."""
    grams = " UNION ALL ".join(
        f"SELECT {key}, {n} AS n, side, array_to_string(t[i:i + {n - 1}], ' ') AS gram"
        f" FROM (SELECT {key}, side, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM sides)"
        for n in range(1, 5)
    )
    return f"""
tok AS (SELECT {key}, {tokens("reference")} AS r, {tokens("candidate")} AS c FROM {source}),
sides AS (SELECT {key}, 'c' AS side, c AS t FROM tok UNION ALL SELECT {key}, 'r', r FROM tok),
grams AS ({grams}),
counted AS (
  SELECT {key}, n, gram, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r
  FROM grams GROUP BY {key}, n, gram),
matched AS (SELECT {key}, n, sum(least(c, r)) AS hits FROM counted GROUP BY {key}, n),
orders AS (SELECT {key}, len(c) AS nc, len(r) AS nr, unnest([1, 2, 3, 4]) AS n FROM tok),
logs AS (
  SELECT {key}, nc, nr,
         sum(0.25::DOUBLE * ln((CASE WHEN coalesce(hits, 0) > 0 THEN hits::DOUBLE ELSE 0.1::DOUBLE END)
             / greatest(1, nc - n + 1))) AS total
  FROM orders LEFT JOIN matched USING ({key}, n) GROUP BY {key}, nc, nr),
bleu AS (
  SELECT {key},
         CASE WHEN nc = 0 OR nr = 0 THEN 0.0::DOUBLE
              ELSE (CASE WHEN nc > nr THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - nr::DOUBLE / nc) END) * exp(total) END AS bleu
  FROM logs)"""


VECTORS = "e AS (SELECT label::BIGINT AS question_id, vec_id AS position, embedding::DOUBLE[] AS v FROM embeddings)"
MEASURED = """
x AS (SELECT question_id, position, unnest(v) AS val, generate_subscripts(v, 1) AS d FROM e),
m AS (SELECT question_id, d, avg(val) AS mean FROM x GROUP BY ALL),
dist AS (
  SELECT x.question_id, x.position, sqrt(sum((val - mean) * (val - mean))) AS dist
  FROM x JOIN m USING (question_id, d) GROUP BY ALL),
lim AS (SELECT question_id, (avg(dist) + stddev_pop(dist)) * (1 + 1e-9::DOUBLE) AS lim FROM dist GROUP BY question_id),
k AS (SELECT question_id, position, dist, dist <= lim AS kept FROM dist JOIN lim USING (question_id)),
c AS (
  SELECT x.question_id, x.d, avg(val) AS centre FROM x JOIN k USING (question_id, position)
  WHERE kept GROUP BY ALL),
s AS (
  SELECT x.question_id, x.position,
         sum(val * centre) / (sqrt(sum(val * val)) * sqrt(sum(centre * centre))) AS cos
  FROM x JOIN c USING (question_id, d) GROUP BY ALL),
measured AS (SELECT * FROM k JOIN s USING (question_id, position)),
metrics AS (
  SELECT question_id, arg_max(position, (cos, -position)) AS center_position,
         avg(cos) AS center_similarity_mean, arg_min(cos, position) AS clean_to_center_similarity,
         avg(dist) FILTER (kept) AS cluster_dispersion, count(*) AS answers
  FROM measured GROUP BY question_id)"""
CENTRE = f"{VECTORS}, {MEASURED}"
AGAINST_CLEAN = """
e AS (SELECT label::BIGINT AS question_id, vec_id AS position, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT question_id, arg_min(v, position) AS clean FROM e GROUP BY question_id),
a AS (SELECT question_id, position, v, clean,
        list_dot_product(v, clean) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(clean, clean))) AS cos,
        greatest(exp(v[2]), exp(v[3])) / list_sum(list_transform(v, lambda t: exp(t))) AS fact
      FROM e JOIN f USING (question_id))"""
MEDIANS = "medians AS (SELECT question_id, median(cos) AS median_cosine FROM a GROUP BY question_id)"
DEFAULTS = """
items AS (
  SELECT item_id AS question_id, quality::DOUBLE AS quality FROM benchmark LEFT JOIN labels ON doc_id = item_id),
defaults AS (
  SELECT question_id, quality,
    CASE WHEN answers IS NULL THEN 1.0 ELSE clean_to_center_similarity * (1 - quality / 2) END AS h1,
    CASE WHEN answers IS NULL THEN 1.0 ELSE center_similarity_mean * (1 - quality / 2) END AS h2,
    CASE WHEN answers IS NULL THEN 1.0 ELSE clean_to_center_similarity * 0.75::DOUBLE END AS h3,
    center_position, coalesce(center_similarity_mean, 0.0) AS center_similarity_mean,
    coalesce(clean_to_center_similarity, 0.0) AS clean_to_center_similarity,
    coalesce(cluster_dispersion, 0.0) AS cluster_dispersion, coalesce(answers, 0) AS answers
  FROM items LEFT JOIN metrics USING (question_id))"""
QUESTIONS = "questions AS (SELECT doc_id AS id, text AS question, source AS category FROM documents)"


def sample(source: str, size: int = SAMPLE, skip: int = SKIP) -> str:
    return f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS place FROM {source}),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}|' || id), id) AS draw
  FROM placed WHERE place > {skip}),
sampled AS (SELECT id, category, draw FROM drawn WHERE draw <= {size})"""


REVIEWED = """
decided AS (
  SELECT id, category, CASE WHEN quality = 0 THEN 'remove' WHEN quality IS NOT NULL THEN 'keep' ELSE 'pending' END AS decision
  FROM sampled LEFT JOIN labels ON doc_id = id)"""
OPTIONS = f"options AS (SELECT event_id, {ANSWER_SQL} AS answer, {LABEL_SQL} AS label FROM events)"
TEXTS = "texts AS (SELECT conv_id || '-' || turn AS question_id, text FROM conversations)"
LINES = "lines AS (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents)"
NAMES = "names AS (SELECT unnest([" + ", ".join(quoted(m) for m in METRICS) + "]) AS metric, unnest(range(0, 6)) AS metric_order)"
PRIME = 2147483647

# From texts (question_id, text) to variants (question_id, position, text_edited).
TYPOS = rf"""
split AS (SELECT question_id, string_split(text, '') AS chars FROM texts),
ch AS (SELECT question_id, unnest(chars) AS c, generate_subscripts(chars, 1) - 1 AS i FROM split),
f AS (
  SELECT *, regexp_matches(c, '^\p{{L}}$') AS letter,
         sum(regexp_matches(c, '^\p{{Nd}}$')::INT) OVER (PARTITION BY question_id ORDER BY i) AS part FROM ch),
n AS (SELECT question_id, floor(0.09::DOUBLE * count(*) FILTER (letter))::BIGINT AS edits FROM f GROUP BY question_id),
v AS (
  SELECT question_id, position, md5('42|' || question_id || '|' || position) AS h
  FROM texts CROSS JOIN (SELECT unnest(range(1, 19)) AS position)),
co AS (
  SELECT question_id, position, ('0x' || h[1:7])::BIGINT AS a, ('0x' || h[8:14])::BIGINT AS b,
         ('0x' || h[15:21])::BIGINT AS k FROM v),
hashed AS (
  SELECT question_id, position, i, part, ((a * i % {PRIME} + b) * i % {PRIME} + k) % {PRIME} AS h
  FROM f JOIN co USING (question_id) WHERE letter),
back AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, position, part ORDER BY h DESC, i DESC) AS from_end FROM hashed),
sites AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, position ORDER BY h, i) AS place FROM back WHERE from_end > 1),
flags AS (
  SELECT f.question_id, co.position, f.i, f.c, f.letter, coalesce(place <= edits, false) AS dropped, edits
  FROM f JOIN co USING (question_id) JOIN n USING (question_id)
  LEFT JOIN sites ON sites.question_id = f.question_id AND sites.position = co.position AND sites.i = f.i),
staying AS (
  SELECT question_id, position, i, edits,
         i - row_number() OVER (PARTITION BY question_id, position ORDER BY i) AS run
  FROM flags WHERE letter AND NOT dropped),
paired AS (
  SELECT *, (row_number() OVER w - 1) % 2 = 0 AND lead(i) OVER w IS NOT NULL AS leads
  FROM staying WINDOW w AS (PARTITION BY question_id, position, run ORDER BY i)),
chosen AS (
  SELECT p.question_id, p.position, p.i,
         row_number() OVER (PARTITION BY p.question_id, p.position ORDER BY h, p.i) <= p.edits AS leads
  FROM paired p JOIN hashed USING (question_id, position, i) WHERE p.leads),
firsts AS (
  SELECT flags.*, coalesce(chosen.leads, false) AS leads FROM flags LEFT JOIN chosen USING (question_id, position, i)),
moved AS (
  SELECT *, CASE WHEN leads THEN i + 1 WHEN coalesce(lag(leads) OVER w, false) THEN i - 1 ELSE i END AS place
  FROM firsts WINDOW w AS (PARTITION BY question_id, position ORDER BY i)),
variants AS (
SELECT question_id, position, string_agg(c, '' ORDER BY place) FILTER (NOT dropped) AS text_edited
FROM moved GROUP BY question_id, position
UNION ALL SELECT question_id, 0, text FROM texts)"""

SUBSTRINGS = rf"""
WITH {TEXTS},
lexicon AS (
  SELECT DISTINCT word, list_sort([reverse(word), word || 'ing']) AS synonyms
  FROM (SELECT unnest({words("lower(text)")}) AS word FROM benchmark) WHERE length(word) >= 4),
cand AS (SELECT DISTINCT question_id, unnest({words("text")}) AS token FROM texts),
drawn AS (
  SELECT question_id, token, synonyms, position, md5('42|' || question_id || '|' || position || '|' || token) AS h
  FROM cand JOIN lexicon ON lower(token) = word CROSS JOIN (SELECT unnest(range(1, 19)) AS position)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, position ORDER BY h, token) AS n FROM drawn),
few AS (
  SELECT question_id, position, token, synonyms[1 + ('0x' || md5(h || 'choice')[1:7])::BIGINT % least(2, count(*) OVER w)] AS synonym,
         n, least(2, count(*) OVER w) AS replaced
  FROM ranked WINDOW w AS (PARTITION BY question_id, position)),
picked AS (
  SELECT question_id, position, max(replaced) AS replaced, max(token) FILTER (n = 1) AS t1, max(synonym) FILTER (n = 1) AS s1,
         max(token) FILTER (n = 2) AS t2, max(synonym) FILTER (n = 2) AS s2
  FROM few WHERE n <= 2 GROUP BY question_id, position),
fanned AS (SELECT question_id, text, position FROM texts CROSS JOIN (SELECT unnest(range(0, 19)) AS position)),
once AS (
  SELECT *, CASE WHEN t1 IS NULL THEN text ELSE replace(text, t1, coalesce(s1, t1)) END AS first_done
  FROM fanned LEFT JOIN picked USING (question_id, position))
SELECT question_id, position, coalesce(replaced, 0) AS replaced,
  CASE WHEN t2 IS NULL THEN first_done ELSE replace(first_done, t2, coalesce(s2, t2)) END AS text_edited FROM once
"""

SYNONYMS = rf"""
WITH {TEXTS},
lexicon AS (
  SELECT DISTINCT word, list_sort([reverse(word), word || 'ing']) AS synonyms
  FROM (SELECT unnest({words("lower(text)")}) AS word FROM benchmark) WHERE length(word) >= 4),
cand AS (SELECT DISTINCT question_id, unnest({words("text")}) AS token FROM texts),
drawn AS (
  SELECT question_id, token, synonyms, position, md5('42|' || question_id || '|' || position || '|' || token) AS h
  FROM cand JOIN lexicon ON lower(token) = word CROSS JOIN (SELECT unnest(range(1, 19)) AS position)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, position ORDER BY h, token) AS n FROM drawn),
picked AS (
  SELECT question_id, position, count(*) AS replaced,
         map(list(token ORDER BY token),
             list(synonyms[1 + ('0x' || md5(h || 'choice')[1:7])::BIGINT % 2] ORDER BY token)) AS swaps
  FROM ranked WHERE n <= 2 GROUP BY question_id, position),
fanned AS (SELECT question_id, text, position FROM texts CROSS JOIN (SELECT unnest(range(0, 19)) AS position))
SELECT question_id, position, coalesce(replaced, 0) AS replaced,
  CASE WHEN swaps IS NULL THEN text ELSE array_to_string(list_transform(
    regexp_extract_all(text, '[{WORD}]+|[^{WORD}]+'), lambda p: coalesce(swaps[p], p)), '') END AS text_edited
FROM fanned LEFT JOIN picked USING (question_id, position)
"""

OVERLAP = """
2.0::DOUBLE * len(list_intersect(string_split(reference, ' '), string_split(candidate, ' ')))
  / (len(list_distinct(string_split(reference, ' '))) + len(list_distinct(string_split(candidate, ' '))))"""

def encoded(x: str) -> str:
    """The stand-in encoder."""
    return f"list_transform(range(0, 8), lambda d: ('0x' || md5({x})[2 * d + 1:2 * d + 2])::BIGINT / 255.0::DOUBLE)"


def cosine(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def judged(reference: str, candidate: str) -> str:
    """Hallucination score with the stand-in encoder and the stand-in logits."""
    one, two = f"exp(length({reference}) / 100.0::DOUBLE % 3)", f"exp(length({candidate}) / 100.0::DOUBLE % 3)"
    semantic = f"greatest(-1.0, least(1.0, {cosine(encoded(reference), encoded(candidate))}))"
    return f"{semantic} * (1 - greatest({two}, exp(1.0::DOUBLE)) / ({one} + {two} + exp(1.0::DOUBLE)))"


GENERATION = f"""
WITH texts AS (SELECT item_id AS question_id, text FROM benchmark), {TYPOS},
lab AS (
  SELECT item_id AS question_id,
         CASE WHEN item_id % 7 = 3 THEN NULL WHEN item_id % 2 = 0 THEN 'far_future' ELSE 'factual' END AS label_gt
  FROM benchmark),
prompts AS (
  SELECT question_id, position, replace({quoted(TEMPLATE)}, '[DOCUMENT]', text_edited) AS prompt FROM variants),
asked AS (
  SELECT question_id, position, CASE WHEN length(prompt) % 5 <> 0 THEN 'True: ' || md5(prompt) END AS response FROM prompts),
e AS (SELECT question_id, position, {encoded("response")} AS v FROM asked WHERE response IS NOT NULL), {MEASURED},
clean_sim AS (SELECT question_id, cos AS clean_cos FROM measured WHERE position = 0),
med AS (
  SELECT question_id, median({cosine("v", encoded("label_gt"))}) AS median_cosine
  FROM e JOIN lab USING (question_id) WHERE label_gt IS NOT NULL GROUP BY question_id),
t AS (
  SELECT texts.question_id, text AS sentence, label_gt, clean.response AS clean_response,
         center.response AS center_response, median_cosine, center_position, center_similarity_mean,
         CASE WHEN answers IS NULL THEN 0.0 ELSE clean_cos END AS clean_to_center_similarity,
         cluster_dispersion, coalesce(answers, 0) AS answers
  FROM texts JOIN lab USING (question_id) LEFT JOIN metrics USING (question_id) LEFT JOIN med USING (question_id)
  LEFT JOIN clean_sim USING (question_id)
  LEFT JOIN asked clean ON clean.question_id = texts.question_id AND clean.position = 0
  LEFT JOIN asked center ON center.question_id = texts.question_id AND center.position = center_position)"""


def judged_or_default(reference: str, candidate: str) -> str:
    missing = f"{reference} IS NULL OR {candidate} IS NULL"
    return f"round(CASE WHEN answers = 0 THEN 1.0 WHEN {missing} THEN NULL ELSE {judged(reference, candidate)} END, 6)"


GENERATED = f"""{GENERATION}
SELECT question_id, sentence, label_gt, clean_response, center_response, center_position, answers,
  round(median_cosine, 6) AS median_cosine, round(coalesce(center_similarity_mean, 0.0), 6) AS center_similarity_mean,
  round(clean_to_center_similarity, 6) AS clean_to_center_similarity,
  round(coalesce(cluster_dispersion, 0.0), 6) AS cluster_dispersion,
  {judged_or_default("label_gt", "clean_response")} AS hallucination_score_clean_vs_label,
  {judged_or_default("label_gt", "center_response")} AS hallucination_score_center_vs_label,
  {judged_or_default("clean_response", "center_response")} AS hallucination_score_center_vs_clean
FROM t
"""
GENERATED_AND_ANALYZED = f"""{GENERATION},
answered AS (SELECT question_id, label_gt, clean_response, center_response FROM t WHERE label_gt IS NOT NULL),
{PAIRS}, {bleu("pairs", "question_id, comparison")}
SELECT question_id, 19 AS responses,
  round(max(bleu) FILTER (comparison = 'clean_vs_label'), 6) AS bleu_clean_vs_label,
  round(max(bleu) FILTER (comparison = 'center_vs_label'), 6) AS bleu_center_vs_label,
  round(max(bleu) FILTER (comparison = 'center_vs_clean'), 6) AS bleu_center_vs_clean,
  any_value({boolean_hit("label_gt", "clean_response")}) AS accuracy_clean_vs_label,
  any_value({boolean_hit("label_gt", "center_response")}) AS accuracy_center_vs_label
FROM answered LEFT JOIN bleu USING (question_id) GROUP BY question_id
"""
LISTED = f"""
docs AS (
  SELECT doc_id AS question_id, string_split(text, chr(10)) AS r,
         list_filter(string_split(text, chr(10)), lambda x: {strip("x")} <> '') AS lines FROM documents),
listed AS (SELECT question_id, r, lines[1] AS label_gt, lines[-1] AS center_response FROM docs WHERE len(lines) > 0)"""

ORACLE = {
    "src_questions": f"WITH {QUESTIONS} SELECT id, question, category FROM questions",
    "src_responses": f"""
WITH {ANSWERS}, {ANSWERED}
SELECT question_id, position, response, label_gt FROM answers JOIN answered USING (question_id)""",
    "decode_lists": f"""
WITH {LINES}
SELECT doc_id, len(r) AS answers, len(list_filter(r, lambda x: {strip("x")} = '')) AS blanks,
  md5(array_to_string(list_transform(r, lambda x: CASE WHEN {strip("x")} = '' THEN '<null>' ELSE x END), '|')) AS digest
FROM lines""",
    "decoded_literals": r"""
WITH t AS (SELECT doc_id, text, text || chr(57344) || chr(57345) || chr(57346) || chr(57347) AS whole FROM documents)
SELECT doc_id, CAST(6 AS BIGINT) AS items, true AS is_null, md5(whole) AS digest0,
  md5(replace(replace(whole, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest2,
  md5(regexp_replace(text, '[''\\\r\n]', ' ', 'g')) AS digest3,
  md5(left(text, CAST(floor(length(text) / 2) AS INTEGER)) || 'a\d') AS digest4, '1_0' AS number
FROM t""",
    "file_numbers": """
SELECT doc_id, row_number, chars FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_number, length(text) AS chars FROM documents)
WHERE row_number >= 30""",
    "versioned_results": """
SELECT conv_id AS question_id, turn - 1 AS position, r AS response, length(r) AS chars, CAST(2 AS BIGINT) AS version
FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 11 <> 0 THEN text ELSE ' ' END AS r FROM conversations)
WHERE turn BETWEEN 1 AND 5""",
    "run_summary": f"""
WITH {CENTRE.replace("e AS (", "e0 AS (").replace("FROM e)", "FROM e0)")}, {DEFAULTS}, {AGAINST_CLEAN}, {MEDIANS},
t AS (SELECT * FROM defaults LEFT JOIN medians USING (question_id))
SELECT 'median_cosine' AS metric, round(avg(median_cosine), 6) AS mean, NULL::DOUBLE AS std FROM t
UNION ALL SELECT 'hallucination_score_clean_vs_label', round(avg(h1), 6), NULL FROM t
UNION ALL SELECT 'hallucination_score_center_vs_label', round(avg(h2), 6), NULL FROM t
UNION ALL SELECT 'hallucination_score_center_vs_clean', round(avg(h3), 6), NULL FROM t
UNION ALL SELECT 'center_similarity_mean', round(avg(center_similarity_mean), 6), NULL FROM t
UNION ALL SELECT 'accuracy_clean_vs_label', round(avg(quality), 6), round(stddev_pop(quality), 6) FROM t""",
    "first_response": f"""
WITH {LINES} SELECT doc_id, CASE WHEN {strip("r[1]")} <> '' THEN r[1] END AS first_response FROM lines""",
    "blank_labels": """
WITH bad AS (SELECT d.doc_id, quality::VARCHAR AS label_gt FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL)
SELECT doc_id, label_gt, (SELECT count(*) FROM bad) AS total_rows FROM bad""",
    "invalid_categories": f"""
WITH {OPTIONS}, bad AS (SELECT event_id, label FROM options WHERE {category("label")} NOT IN {FOUR})
SELECT event_id, label, (SELECT count(*) FROM bad) AS total_rows FROM bad""",
    "bad_embeddings": """
SELECT vec_id AS position, CASE vec_id % 50 WHEN 7 THEN 'invalid norm' WHEN 21 THEN 'wrong shape' ELSE 'not finite' END AS fault
FROM embeddings WHERE vec_id % 50 IN (7, 13, 21, 34)""",
    "skipped_rows": f"""
WITH {ANSWERED},
bad AS (
  SELECT question_id, concat_ws(', ', CASE WHEN {blank("clean_response")} THEN 'LLM_response' END,
    CASE WHEN {blank("center_response")} THEN 'center_response' END) AS empty_columns FROM answered)
SELECT question_id, empty_columns, (SELECT count(*) FROM bad WHERE empty_columns <> '') AS total_rows
FROM bad WHERE empty_columns <> ''""",
    "comparison_pairs": f"WITH {ANSWERED}, {PAIRS} SELECT * FROM pairs",
    "scored_rows": f"""
WITH {ANSWERED}, {PAIRS}, {bleu("pairs", "question_id, comparison")},
scores AS (SELECT question_id, comparison, bleu, {OVERLAP} AS overlap FROM bleu JOIN pairs USING (question_id, comparison))
SELECT question_id,
  round(max(bleu) FILTER (comparison = 'clean_vs_label'), 6) AS bleu_clean_vs_label,
  round(max(bleu) FILTER (comparison = 'center_vs_label'), 6) AS bleu_center_vs_label,
  round(max(bleu) FILTER (comparison = 'center_vs_clean'), 6) AS bleu_center_vs_clean,
  round(max(overlap) FILTER (comparison = 'clean_vs_label'), 6) AS word_overlap_clean_vs_label,
  round(max(overlap) FILTER (comparison = 'center_vs_label'), 6) AS word_overlap_center_vs_label,
  round(max(overlap) FILTER (comparison = 'center_vs_clean'), 6) AS word_overlap_center_vs_clean
FROM answered LEFT JOIN scores USING (question_id) GROUP BY question_id""",
    "review_decisions": f"""
WITH {QUESTIONS}, {sample("questions")}, {REVIEWED} SELECT id, category, decision FROM decided""",
    "review_filtered": f"""
WITH {QUESTIONS}, {sample("questions")}, {REVIEWED}
SELECT * FROM questions WHERE id NOT IN (SELECT id FROM decided WHERE decision = 'remove')""",
    "robust_centre": f"""
WITH {CENTRE} SELECT question_id, position, round(dist, 6) AS dist, kept, round(cos, 6) AS cos FROM measured""",
    "centre_response": f"""
WITH {CENTRE} SELECT question_id, center_position, center_position AS center_response FROM metrics""",
    "centre_consistency": f"""
WITH {CENTRE} SELECT question_id, round(center_similarity_mean, 6) AS center_similarity_mean,
  round(clean_to_center_similarity, 6) AS clean_to_center_similarity, round(cluster_dispersion, 6) AS cluster_dispersion
FROM metrics""",
    "centre_defaults": f"""
WITH {CENTRE}, {DEFAULTS}
SELECT question_id, round(h1, 6) AS hallucination_score_clean_vs_label, round(h2, 6) AS hallucination_score_center_vs_label,
  round(h3, 6) AS hallucination_score_center_vs_clean, center_position, round(center_similarity_mean, 6) AS center_similarity_mean,
  round(clean_to_center_similarity, 6) AS clean_to_center_similarity, round(cluster_dispersion, 6) AS cluster_dispersion, answers
FROM defaults""",
    "median_cosine": f"""
WITH {AGAINST_CLEAN}, {MEDIANS} SELECT question_id, round(median_cosine, 6) AS median_cosine FROM medians""",
    "bleu_pairs": f"""
WITH {ANSWERS}, {ANSWERED},
rows AS (
  SELECT question_id, position, label_gt AS reference, response AS candidate
  FROM answers JOIN answered USING (question_id) WHERE NOT {blank("response")}),
{bleu("rows", "question_id, position")}
SELECT question_id, position, round(bleu, 6) AS bleu FROM bleu""",
    "kl_confidence": """
WITH cells AS (
  SELECT event_type AS grp, hour(ts) % 3 AS model, user_id % 4 AS class, sum(value) AS p FROM events GROUP BY ALL),
full_grid AS (
  SELECT g.grp, g.model, c.class, coalesce(p, 0.0) AS p
  FROM (SELECT DISTINCT grp, model FROM cells) g CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS class) c
  LEFT JOIN cells USING (grp, model, class)),
scaled AS (SELECT *, p / (sum(p) OVER (PARTITION BY grp, model) + 1e-12::DOUBLE) AS q FROM full_grid),
means AS (SELECT *, avg(q) OVER (PARTITION BY grp, class) AS m FROM scaled),
clipped AS (
  SELECT *, greatest(1e-12::DOUBLE, least(1.0, q / (sum(q) OVER (PARTITION BY grp, model) + 1e-12::DOUBLE))) AS a,
         greatest(1e-12::DOUBLE, least(1.0, m / (sum(m) OVER (PARTITION BY grp, model) + 1e-12::DOUBLE))) AS b FROM means),
kl AS (SELECT grp, model, sum(a * ln(a / b)) AS kl FROM clipped GROUP BY grp, model)
SELECT grp, count(*) AS models, round(exp(-avg(kl)), 6) AS confidence FROM kl GROUP BY grp""",
    "metric_stats": f"""
WITH {NAMES},
good AS (SELECT event_type AS metric, value FROM events WHERE event_id % 50 NOT IN (0, 1, 2))
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n
FROM names LEFT JOIN good USING (metric) GROUP BY metric""",
    "position_metrics": f"""
WITH {ANSWERS}, {ANSWERED},
grid AS (SELECT unnest(range(0, (SELECT max(position) + 1 FROM answers))) AS position UNION ALL SELECT 1000000),
center AS (SELECT question_id, 1000000 AS position, center_response AS response FROM answered),
rows AS (
  SELECT question_id, position, label_gt AS reference, response AS candidate
  FROM (SELECT * FROM answers UNION ALL SELECT * FROM center) JOIN answered USING (question_id)
  WHERE NOT {blank("response")}),
{bleu("rows", "question_id, position")},
judged AS (
  SELECT question_id, position, {boolean_hit("reference", "candidate")} AS accuracy,
    2.0::DOUBLE * len(list_intersect({tokens("reference")}, {tokens("candidate")}))
      / nullif(len(list_distinct({tokens("reference")})) + len(list_distinct({tokens("candidate")})), 0) AS overlap FROM rows),
scored AS (SELECT * FROM judged JOIN bleu USING (question_id, position))
SELECT nullif(position, 1000000) AS position,
  CASE position WHEN 0 THEN 'C' WHEN 1000000 THEN 'Center' ELSE 'P' || position END AS response_position,
  round(avg(bleu), 6) AS mean_bleu, round(avg(overlap), 6) AS mean_token_overlap, round(avg(accuracy), 6) AS mean_accuracy
FROM grid LEFT JOIN scored USING (position) GROUP BY position""",
    "analyzed_rows": f"""
WITH {LISTED},
answered AS (SELECT *, CASE WHEN {strip("r[1]")} <> '' THEN r[1] END AS clean_response FROM listed),
{PAIRS}, {bleu("pairs", "question_id, comparison")},
scores AS (
  SELECT question_id, comparison, bleu, {judged("reference", "candidate")} AS h
  FROM bleu JOIN pairs USING (question_id, comparison))
SELECT question_id,
  round(max(bleu) FILTER (comparison = 'clean_vs_label'), 6) AS bleu_clean_vs_label,
  round(max(bleu) FILTER (comparison = 'center_vs_label'), 6) AS bleu_center_vs_label,
  round(max(bleu) FILTER (comparison = 'center_vs_clean'), 6) AS bleu_center_vs_clean,
  round(max(h) FILTER (comparison = 'clean_vs_label'), 6) AS hallucination_score_clean_vs_label,
  round(max(h) FILTER (comparison = 'center_vs_label'), 6) AS hallucination_score_center_vs_label,
  round(max(h) FILTER (comparison = 'center_vs_clean'), 6) AS hallucination_score_center_vs_clean,
  any_value({boolean_hit("label_gt", "clean_response")}) AS accuracy_clean_vs_label,
  any_value({boolean_hit("label_gt", "center_response")}) AS accuracy_center_vs_label
FROM answered LEFT JOIN scores USING (question_id) GROUP BY question_id""",
    "analyzed_positions": f"""
WITH {LISTED},
placed AS (
  SELECT question_id, label_gt, unnest(r) AS response, generate_subscripts(r, 1) - 1 AS position FROM listed
  UNION ALL SELECT question_id, label_gt, center_response, NULL FROM listed),
rows AS (
  SELECT question_id, coalesce(position, -1) AS position, label_gt AS reference, response AS candidate
  FROM placed WHERE NOT {blank("response")}),
{bleu("rows", "question_id, position")},
hits AS (
  SELECT question_id, position, {boolean_hit("reference", "candidate")} AS accuracy,
         {judged("reference", "candidate")} AS h FROM rows),
grid AS (SELECT DISTINCT coalesce(position, -1) AS position FROM placed)
SELECT nullif(position, -1) AS position,
  CASE position WHEN 0 THEN 'C' WHEN -1 THEN 'Center' ELSE 'P' || position END AS response_position,
  round(avg(bleu), 6) AS mean_bleu, round(avg(h), 6) AS mean_hallucination_score, round(avg(accuracy), 6) AS mean_accuracy
FROM grid LEFT JOIN (SELECT * FROM bleu JOIN hits USING (question_id, position)) USING (position) GROUP BY position""",
    "generated_answers": GENERATED,
    "generated_and_analyzed": GENERATED_AND_ANALYZED,
    "gapped_positions": f"""
WITH questions AS (
  SELECT conv_id AS question_id, max(text) FILTER (turn = 0) AS label_gt, arg_max({CATEGORISED_SQL}, turn) AS center_response
  FROM conversations GROUP BY conv_id),
placed AS (
  SELECT conv_id AS question_id, turn - 1 AS position, {CATEGORISED_SQL} AS response
  FROM conversations WHERE turn >= 1 AND turn <> 2 AND (conv_id + turn) % 3 <> 0
  UNION ALL SELECT question_id, 1000000, center_response FROM questions),
rows AS (
  SELECT question_id, position, label_gt AS reference, response AS candidate,
         CASE WHEN question_id % 2 = 0 THEN '4. Nonsense' ELSE ' (1) obscure' END AS category
  FROM placed JOIN questions USING (question_id) WHERE NOT {blank("response")}),
{bleu("rows", "question_id, position")},
hits AS (SELECT question_id, position, {category_hit("category", "candidate")} AS accuracy FROM rows),
grid AS (
  SELECT unnest(range(0, (SELECT max(position) + 1 FROM placed WHERE position < 1000000))) AS position
  UNION ALL SELECT 1000000)
SELECT nullif(position, 1000000) AS position,
  CASE position WHEN 0 THEN 'C' WHEN 1000000 THEN 'Center' ELSE 'P' || position END AS response_position,
  round(avg(bleu), 6) AS mean_bleu, round(avg(accuracy), 6) AS mean_accuracy
FROM grid LEFT JOIN (SELECT * FROM bleu JOIN hits USING (question_id, position)) USING (position) GROUP BY position""",
    "stratified_sample_large": f"""
WITH evs AS (SELECT event_id AS id, event_type AS category FROM events), {sample("evs", LARGE_SAMPLE, LARGE_SKIP)}
SELECT id, category, draw FROM sampled""",
    "boxplot_stats": f"""
WITH {NAMES},
box AS (
  SELECT event_type AS metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
fence AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS low, q3 + 1.5::DOUBLE * (q3 - q1) AS high FROM box),
stat AS (
  SELECT metric, q1, median, q3, avg(value) AS mean,
    least(any_value(q1), min(value) FILTER (value >= low)) AS whisker_low,
    greatest(any_value(q3), max(value) FILTER (value <= high)) AS whisker_high,
    count(*) FILTER (value < low OR value > high) AS outliers
  FROM events JOIN fence ON metric = event_type GROUP BY metric, q1, median, q3)
SELECT metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean,
  round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, outliers
FROM names LEFT JOIN stat USING (metric)""",
    "category_counts": f"""
WITH {QUESTIONS} SELECT category, count(*) AS questions FROM questions WHERE NOT {blank("category")} GROUP BY category""",
    "review_summary": f"""
WITH {QUESTIONS}, {sample("questions")}, {REVIEWED}
SELECT count(*) AS reviewed, count(*) FILTER (decision = 'remove') AS removed,
  count(*) FILTER (decision = 'pending') AS pending,
  (SELECT count(*) FROM questions) - count(*) FILTER (decision = 'remove') AS remaining FROM decided""",
    "accuracy_summary": f"""
WITH {OPTIONS},
t AS (SELECT {category_hit("label", "answer")} AS c, {boolean_hit("label", "answer")} AS b FROM options)
SELECT 'category_accuracy' AS metric, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM t
UNION ALL SELECT 'boolean_accuracy', round(avg(b), 6), round(stddev_pop(b), 6) FROM t""",
    "stratified_sample": f"WITH {QUESTIONS}, {sample('questions')} SELECT id, category, draw FROM sampled",
    "stratified_sample_events": f"""
WITH evs AS (SELECT event_id AS id, event_type AS category FROM events), {sample("evs")} SELECT id, category, draw FROM sampled""",
    "sample_shortfall": f"""
SELECT source AS category, greatest(0, count(*) - {SKIP}) AS eligible,
  greatest(0, 45 - greatest(0, count(*) - {SKIP})) AS shortfall
FROM documents WHERE NOT {blank("source")} GROUP BY source""",
    "token_counts": f"""
WITH t AS (SELECT doc_id AS id, {tokens("text")} AS t FROM documents)
SELECT id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM t""",
    "normalized_categories": f"WITH {OPTIONS} SELECT event_id, {category('label')} AS category FROM options",
    "extracted_category": f"WITH {OPTIONS} SELECT event_id, {extracted('answer')} AS category FROM options",
    "category_accuracy": f"WITH {OPTIONS} SELECT event_id, {category_hit('label', 'answer')} AS accuracy FROM options",
    "boolean_accuracy": f"WITH {OPTIONS} SELECT event_id, {boolean_hit('label', 'answer')} AS accuracy FROM options",
    "rendered_prompts": f"""
WITH {TEXTS} SELECT question_id, replace({quoted(TEMPLATE)}, '[DOCUMENT]', text) AS prompt FROM texts""",
    "embedding_text": f"""
WITH {OPTIONS}
SELECT event_id, coalesce(nullif({strip("replace(answer, chr(0), ' ')")}, ''), '[EMPTY RESPONSE]') AS embedding_text FROM options""",
    "cosine_pairs": f"""
WITH {AGAINST_CLEAN}
SELECT question_id, position, round(cos, 6) AS cosine, round(greatest(-1.0, least(1.0, cos)), 6) AS semantic_similarity FROM a""",
    "factual_score": """
WITH e AS (SELECT vec_id AS position, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT position, list_transform(v, lambda t: exp(t)) AS w FROM e)
SELECT position, round(greatest(w[2], w[3]) / list_sum(w), 6) AS factual_score, round(list_max(w) / list_sum(w), 6) AS top_probability
FROM p""",
    "hallucination_score": f"""
WITH {AGAINST_CLEAN}
SELECT question_id, position, round(greatest(-1.0, least(1.0, cos)) * (1 - fact), 6) AS hallucination_score FROM a""",
    "message_span": """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN []::VARCHAR[] ELSE string_split(text, ' ') END AS w FROM conversations)
SELECT conv_id, turn, len(w) AS tokens,
  round(coalesce(list_sum(list_transform(w, lambda x: length(x) / -10.0::DOUBLE)), 0), 6) AS logprob,
  round(coalesce(list_sum(list_transform(w, lambda x: exp(length(x) / -10.0::DOUBLE))), 0), 6) AS probability,
  md5(array_to_string(w, ' ')) AS digest FROM t""",
    "best_class": """
WITH e AS (SELECT vec_id AS position, embedding::DOUBLE[] AS v FROM embeddings)
SELECT position, 'class ' || (list_position(v, list_max(v)) - 1) AS best_class, round(list_max(v), 6) AS score,
  round(list_min(v), 6) AS last_score,
  (SELECT string_agg('class ' || (i - 1), ',' ORDER BY s DESC, i)
   FROM (SELECT unnest(v) AS s, generate_subscripts(v, 1) AS i)) AS ranking FROM e""",
    "class_ranking": """
WITH e AS (SELECT vec_id AS position, embedding::DOUBLE[] AS v FROM embeddings)
SELECT position, round(list_min(v), 6) AS last_score,
  (SELECT string_agg('class ' || (i - 1), ',' ORDER BY s DESC, i)
   FROM (SELECT unnest(v) AS s, generate_subscripts(v, 1) AS i)) AS ranking FROM e""",
    "written_review": f"""
WITH {QUESTIONS}, {sample("questions")}, {REVIEWED} SELECT id, category, decision, decision <> 'remove' AS kept FROM decided""",
    "required_columns": """
SELECT 'documents' AS source, n AS name, n IN ('text', 'lang') AS present,
  CASE n WHEN 'text' THEN (SELECT count(text) FROM documents) WHEN 'lang' THEN (SELECT count(lang) FROM documents) ELSE 0 END AS filled
FROM (SELECT unnest(['question', 'category', 'text', 'lang', 'turn']) AS n)
UNION ALL
SELECT 'conversations', n, n IN ('text', 'turn'),
  CASE n WHEN 'text' THEN (SELECT count(text) FROM conversations) WHEN 'turn' THEN (SELECT count(turn) FROM conversations) ELSE 0 END
FROM (SELECT unnest(['question', 'category', 'text', 'lang', 'turn']) AS n)""",
    "score_faults": """
SELECT * FROM (
  SELECT conv_id, turn, CAST(1 AS BIGINT) AS pairs, CAST(CASE WHEN (conv_id + turn) % 7 = 0 THEN 0
    WHEN (conv_id + turn) % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS scores FROM conversations) WHERE scores <> 1""",
    "category_datasets": "SELECT doc_id, doc_id % 6 < 2 AS judged FROM documents",
    "synonym_substrings": SUBSTRINGS,
    "synonym_table": f"""
WITH w AS (
  SELECT conv_id || '-' || turn AS word,
    CASE WHEN role = 'assistant' THEN list_sort(list_distinct({words("text")}))[1:10] ELSE []::VARCHAR[] END AS s
  FROM conversations)
SELECT word, len(s) AS n, array_to_string(s, ',') AS synonyms FROM w""",
    "variant_fanout": """
SELECT doc_id AS id, length(text) AS chars, position FROM documents CROSS JOIN (SELECT unnest(range(0, 19)) AS position)""",
    "typo_variants": f"WITH {TEXTS}, {TYPOS} SELECT question_id, position, text_edited FROM variants",
    "synonym_variants": SYNONYMS,
    "batch_generate": f"""
SELECT doc_id AS id, 'True: ' || md5(replace({quoted(TEMPLATE)}, '[DOCUMENT]', text)) AS response, NULL::VARCHAR AS response_error
FROM documents""",
    "journaled_calls": f"""
WITH {TEXTS} SELECT question_id, 'True: ' || md5(text) AS response, NULL::VARCHAR AS response_error, CAST(1 AS BIGINT) AS sent
FROM texts WHERE text IS NOT NULL""",
    "back_translation": f"WITH {TEXTS} SELECT question_id, {strip('text')} AS text_edited FROM texts",
    "batch_embed": f"""
WITH h AS (
  SELECT doc_id AS id, md5(coalesce(nullif({strip("replace(text, chr(0), ' ')")}, ''), '[EMPTY RESPONSE]')) AS h FROM documents)
SELECT id, NULL::VARCHAR AS v_fault, dim, round(('0x' || h[2 * dim + 1:2 * dim + 2])::BIGINT / 255.0::DOUBLE, 6) AS value
FROM h CROSS JOIN (SELECT unnest(range(0, 8)) AS dim)""",
    "batch_pair_scores": f"""
WITH {ANSWERED}, {PAIRS}
SELECT question_id, comparison, NULL::VARCHAR AS word_overlap_error,
  round({OVERLAP}, 6) AS word_overlap FROM pairs""",
}

ORACLE["written_positions"] = f"SELECT * EXCLUDE (position) FROM ({ORACLE['position_metrics']}) AS told"
