"""Periodic runs of words by a dictionary of basic factors, and the texts without their repetitions.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, TIMES * q) words, that no
neighbouring word extends keeping period q.

The dictionary of basic factors names all stretches of 1, 2, 4, ... words of a text: a stretch of 2 L words is
named by the names of its halves. Only stretches that occur again in their text keep a name; a longer one
has no chance without them. For the factors of L words, the occurrences within the next 2 L words form an
arithmetic progression: its difference, the distance to the next occurrence, is the period that place proposes.
A place in a run of period q, L / 2 < q <= L, proposes q and no less, since a shorter distance would give the
run a smaller period. So neighbouring places with one proposal are extended to one run: from the first place on,
as many words as there are places, and L + q - 1 more. A period belongs to one L, so no run is found twice.

Runs do not cross documents: one pass without a shuffle. A document's words are in memory together.

Defined results: a null or empty text has no words and no runs; repeated rows get equal results; other columns
are not read unless named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerlab.llm import words as W

LEAST = 6
TIMES = 4
BATCH = 2 << 20


def _named(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which keys occur again, name of each key: its rank among all, distance to its next place or 0)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    last = np.append(new[1:], True)
    names, gaps = np.empty(len(keys), np.int64), np.zeros(len(keys), np.int64)
    again = np.empty(len(keys), dtype=bool)
    names[order] = np.cumsum(new) - 1
    again[order] = ~(new & last)
    follows = np.flatnonzero(~last)
    gaps[order[follows]] = places[order[follows + 1]] - places[order[follows]]
    return again, names, gaps


def runs_of(symbols: np.ndarray, owners: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(owner, first symbol, length, period) of all runs, by first symbol and period.

    ``symbols`` are hashes, those of one owner next to each other; ``times`` is 3 or more.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by next occurrences")
    total = len(symbols)
    places = np.arange(total)
    keys = W.mix(symbols + owners.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again, names, gaps = _named(keys, places)
    found: list[tuple[np.ndarray, ...]] = []
    length = 1
    while True:
        places, names, gaps = places[again], names[again], gaps[again]
        if not len(places):
            break
        at = np.flatnonzero((gaps <= length) & (2 * gaps > length))
        if len(at):
            place, period = places[at], gaps[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            start, q = place[first], period[first]
            size = count + length + q - 1
            long_ = size >= np.maximum(least, times * q)
            found.append((start[long_], size[long_], q[long_]))
        # Factors of twice the length, where both halves have names.
        whole = np.full(total + length, -1, np.int64)
        whole[places] = names
        halves = whole[places + length]
        both = halves >= 0
        places, names = places[both], names[both] * np.int64(total + 1) + halves[both]
        again, names, gaps = _named(names, places)
        length *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, size, q = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.lexsort((q, start))
    return owners[start[order]], start[order], size[order], q[order]


def _found(texts: W.Texts, least: int, times: int) -> Iterator[tuple[list, np.ndarray, list[str]]]:
    """For pieces of the texts: runs of each text, words of each text, and the collapsed texts."""
    for _, piece in texts.pieces():
        words = W.split_words(piece)
        owners = words.owners
        owner, start, size, period = runs_of(words.hashes, owners, least, times)
        cover = np.zeros(len(owners) + 1, np.int32)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + size, -1)
        keep = np.cumsum(cover[:-1]) == 0
        begins = start - words.first[owner]
        bounds = np.searchsorted(owner, np.arange(len(piece) + 1))
        runs, collapsed = [], []
        for index in range(len(piece)):
            low, high = bounds[index], bounds[index + 1]
            columns = (begins[low:high].tolist(), size[low:high].tolist(), period[low:high].tolist())
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(*columns, strict=True)])
            cut = piece.data[piece.offsets[index] : piece.offsets[index + 1]].tobytes().split()
            if low < high:
                cut = compress(cut, keep[words.first[index] : words.first[index + 1]].tolist())
            collapsed.append(b" ".join(cut))
        yield runs, words.counts, collapsed


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """The columns ``keep`` of every document, n_words, its runs by start and period, and collapsed_text: the words
    joined by one space without those that a run holds after its first period."""
    keep = ["doc_id"] if keep is None else keep
    names = ["n_words", "runs", "collapsed_text"]
    if set(keep) & set(names):
        raise ValueError(f"columns to keep have the names of results: {sorted(set(keep) & set(names))}")
    read = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("_periodic_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "_periodic_text", BATCH):
            begin = 0
            for runs, counts, collapsed in _found(texts, least, times):
                part = table.slice(begin, len(runs))
                begin += len(runs)
                made = [pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield from pa.table([part.column(c) for c in keep] + made, keep + names).to_batches()

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.select(*keep).schema)
    schema = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return read.mapInArrow(run, kinds + schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared as fractions; the first one among equals; null without runs."""
    ahead = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, run: F.when(ahead(best, run), run).otherwise(best))


def digest_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, [doc_id], text).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def plant_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): the words of every text joined by one space, a tenth of the documents made periodic.

    With h the crc32 of the decimal id and g = h // 10: if h is divisible by 10, every word i >= a = g % n becomes
    word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). A null id is left as it is.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in W.batches_of(batches, "text", BATCH):
            ids, out = table.column("doc_id").to_pylist(), []
            for index, own in enumerate(ids):
                words = texts.data[texts.offsets[index] : texts.offsets[index + 1]].tobytes().split()
                h = 1 if own is None else zlib.crc32(str(own).encode())
                if h % 10 == 0 and words:
                    g = h // 10
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    words[a:] = [words[a + i % p] for i in range(len(words) - a)]
                out.append(b" ".join(words))
            column = pa.array(out, pa.binary()).cast(pa.string())
            yield from pa.table([table.column("doc_id"), column], ["doc_id", "text"]).to_batches()

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text string")


#: Every pair of equal words of a text, at most a quarter of it apart; crc32 bit by bit.
ORACLE_SQL = r"""WITH bytes AS (SELECT doc_id, text, list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT) AS b FROM documents),
     hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                       xor(list_reduce(b, lambda crc, byte: list_reduce(range(8), lambda v, bit:
                           xor(v >> 1, (v & 1) * 3988292384), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes),
     sized AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM hashed),
     planned AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
     words AS MATERIALIZED (SELECT doc_id, i, n, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
               FROM (SELECT *, unnest(range(0, n)) AS i FROM planned)),
     pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x
               JOIN words y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
     grouped AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
     stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM grouped GROUP BY doc_id, q, island
                   HAVING count(*) + q >= greatest(6, 4 * q)),
     runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
     best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) AS place FROM runs),
     lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(s::VARCHAR || ',' || l::VARCHAR || ',' || q::VARCHAR || chr(10), '' ORDER BY s, q) AS told
               FROM runs GROUP BY doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
     held AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS left_ FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(r.n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.l // b.q)::BIGINT AS exponent_milli, sha256(coalesce(r.told, '')) AS runs_sha256, sha256(coalesce(h.left_, '')) AS collapsed_sha256
FROM sized d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN lines r ON r.doc_id = d.doc_id LEFT JOIN held h ON h.doc_id = d.doc_id
"""
