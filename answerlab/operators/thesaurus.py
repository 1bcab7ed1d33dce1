"""Synonyms out of thesaurus answers: rows ``(word, payload)`` with one JSON document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: at most this many synonyms per word.
MOST_SYNONYMS = 10
_ENTRY = "meta struct<syns: array<array<string>>>, def array<struct<sseq: array<array<array<string>>>>>"
_SENSE = "syn_list array<array<struct<wd: string>>>"


def synonyms(payload: Column, most: int = MOST_SYNONYMS) -> Column:
    """Distinct synonyms in alphabetic order, cut to ``most``; empty for a list of suggestions.

    Entries name synonyms in ``meta.syns`` and in the senses under ``def.sseq``. The items
    of ``sseq`` are mixed arrays, so they are read as JSON text first.
    """
    entries = F.from_json(payload, "array<string>")
    objects = F.filter(entries, lambda entry: F.ltrim(entry).startswith("{"))
    parsed = F.transform(objects, lambda entry: F.from_json(entry, _ENTRY))
    from_meta = F.flatten(F.flatten(F.transform(parsed, lambda e: _present(e["meta"]["syns"]))))
    items = F.flatten(
        F.flatten(
            F.transform(
                parsed,
                lambda e: F.transform(_present(e["def"]), lambda d: F.flatten(_present(d["sseq"]))),
            )
        )
    )
    senses = F.transform(
        F.filter(items, lambda item: F.get(item, F.lit(0)) == "sense"),
        lambda item: F.from_json(F.get(item, F.lit(1)), _SENSE),
    )
    words = F.flatten(F.flatten(F.transform(senses, lambda s: _present(s["syn_list"]))))
    from_senses = F.transform(words, lambda w: w["wd"])
    found = F.filter(
        F.concat(_present(from_meta), _present(from_senses)), lambda w: w.isNotNull() & (w != "")
    )
    is_answer = F.ltrim(F.get(entries, F.lit(0))).startswith("{")
    none = F.array().cast("array<string>")
    result = F.slice(F.sort_array(F.array_distinct(found)), 1, most)
    return F.when(F.coalesce(is_answer, F.lit(False)), result).otherwise(none)


def _present(array: Column) -> Column:
    return F.coalesce(array, F.array())


def synonym_table(payloads: DataFrame, most: int = MOST_SYNONYMS) -> DataFrame:
    return payloads.select("word", synonyms(F.col("payload"), most).alias("synonyms"))
