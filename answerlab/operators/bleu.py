"""Sentence BLEU-4 of (reference, candidate) pairs.

Everything about a pair is in its row, so the score is a projection without a shuffle. Tokens and the score
are built-in expressions; shared grams are counted in NumPy for a batch of pairs at a time, by exact numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions import text

# Highest n-gram order and the match count used where nothing matches.
MAX_ORDER = 4
EPSILON = 0.1
#: Tokens of both sides that are compared together, so memory does not follow the size of a batch.
PIECE = 1 << 20


def _matcher():
    """Matches of every order for lists of (reference tokens, candidate tokens), all pairs of a batch side by side.

    Everything is made here, so that it travels to workers whole.
    """
    orders, piece = MAX_ORDER, PIECE

    def listed(column):
        """(values, offsets) of a list column; null is empty."""
        column = column.fill_null([]) if column.null_count else column
        offsets = column.offsets.to_numpy().astype(np.int64)
        return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]

    def matches(tokens, owners, mine, count):
        """(pairs, orders) sizes of the multiset intersections; a pair's reference and candidate each lie in order.

        Grams are numbered anew in every order, within their pair: a longer gram is the number of the shorter one and
        that of the token after it. Places whose gram the other side lacks begin no longer match and are left out.
        """
        found = np.zeros((count, orders), dtype=np.int32)
        # Where each side of each pair ends, so that no gram reaches beyond it.
        side = owners * 2 + mine
        places = np.arange(len(tokens))
        _, single = np.unique(owners * (int(tokens.max(initial=0)) + 1) + tokens, return_inverse=True)
        grams, width = single, int(single.max(initial=0)) + 1
        for order in range(orders):
            if order:
                inside = places + order < len(tokens)
                inside[inside] = side[places[inside] + order] == side[places[inside]]
                places, grams = places[inside], grams[inside]
                _, grams = np.unique(grams * width + single[places + order], return_inverse=True)
            theirs = np.bincount(grams[~mine[places]], minlength=grams.max(initial=-1) + 1)
            own = np.bincount(grams[mine[places]], minlength=len(theirs))
            shared = np.minimum(theirs, own)
            owner_of = np.zeros(len(shared), dtype=np.int64)
            owner_of[grams] = owners[places]
            found[:, order] = np.bincount(owner_of, shared, count)
            left = shared[grams] > 0
            places, grams = places[left], grams[left]
            if not len(places):
                break
        return found

    def run(references: pa.Array, candidates: pa.Array) -> pa.Array:
        (theirs, first), (own, begin) = listed(references), listed(candidates)
        both = pa.concat_arrays([theirs, own]).dictionary_encode().indices
        # A list holds no null token, so all numbers are there.
        numbers = both.to_numpy(zero_copy_only=False).astype(np.int64)
        theirs, own = numbers[: first[-1]], numbers[first[-1] :]
        out, ends, row = [], first + begin, 0
        while row < len(references):
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + piece, "right")) - 1)
            sizes = np.diff(first[row : last + 1]), np.diff(begin[row : last + 1])
            pair = np.arange(last - row)
            owners = np.concatenate([np.repeat(pair, size) for size in sizes])
            mine = np.repeat([False, True], [sizes[0].sum(), sizes[1].sum()])
            tokens = np.concatenate([theirs[first[row] : first[last]], own[begin[row] : begin[last]]])
            out.append(matches(tokens, owners, mine, last - row))
            row = last
        counts = np.concatenate(out) if out else np.zeros((0, orders), dtype=np.int32)
        return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * orders, pa.array(counts.ravel()))

    return run


def with_bleu(
    pairs: DataFrame,
    name: str = "bleu",
    reference: str = "reference",
    candidate: str = "candidate",
    tokens: dict[str, str] | None = None,
) -> DataFrame:
    """Add the score; 0.0 where either side has no token, null where either side is null.

    ``tokens`` names the columns that hold the tokens of a text already, for texts that are in several pairs.
    """
    kept = pairs.columns
    known = tokens or {}
    side = {c: F.col(known[c]) if c in known else text.tokens(F.col(c)) for c in (reference, candidate)}
    matched = pairs.withColumns({"_r1": side[reference], "_c1": side[candidate]})
    found = F.arrow_udf(_matcher(), "array<int>")(F.col("_r1"), F.col("_c1"))
    matched = matched.select(*kept, F.size("_r1").alias("_nr"), F.size("_c1").alias("_nc"), found.alias("_m"))
    logs = " + ".join(
        f"ln(if(_m[{n - 1}] > 0, double(_m[{n - 1}]), {EPSILON}D) / greatest(_nc - {n - 1}, 1))" for n in range(1, MAX_ORDER + 1)
    )
    score = F.expr(
        f"""CASE WHEN `{reference}` IS NULL OR `{candidate}` IS NULL THEN NULL
        WHEN _nc = 0 OR _nr = 0 THEN 0D
        ELSE if(_nc > _nr, 1D, exp(1D - try_divide(_nr, _nc))) * exp(({logs}) / {MAX_ORDER}) END"""
    )
    return matched.select(*kept, score.alias(name))
