"""Token streams with control marks: ``ARRAY<STRUCT<token STRING, logprob DOUBLE>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The mark that opens a message, and how every control mark begins and ends.
MESSAGE_MARK = "<|message|>"
CONTROL_OPEN, CONTROL_CLOSE = "<|", "|>"


def message_span(content: Column) -> Column:
    """Tokens after the last message mark up to the next control mark, with probabilities."""
    marks = F.filter(
        F.transform(content, lambda item, i: F.when(item["token"] == MESSAGE_MARK, i)),
        lambda i: i.isNotNull(),
    )
    tail = F.slice(content, F.coalesce(F.array_max(marks) + 2, F.size(content) + 1), F.size(content))
    # A token such as "<|>" satisfies both tests, as it would with startswith/endswith.
    stops = F.filter(
        F.transform(
            tail,
            lambda item, i: F.when(
                item["token"].startswith(CONTROL_OPEN) & item["token"].endswith(CONTROL_CLOSE), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    kept = F.slice(tail, F.lit(1), F.coalesce(F.array_min(stops), F.size(tail)))
    return F.transform(
        kept,
        lambda item: F.struct(
            item["token"].alias("token"),
            item["logprob"].alias("logprob"),
            F.exp(item["logprob"]).alias("probability"),
        ),
    )
