"""What the text operators share: the word pattern, sizes, and spans found without Python."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(r"[^ \t-\r]+")

SPANS = (
    "array<struct<start:bigint,end:bigint,hit:string,text:string,before:string,after:string>>"
)
CONTEXT = 48
# Whole texts that a Python worker gets, and makes something of, at a time.
BATCH_ROWS = 500


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra ones cannot clash."""
    return df.select(*[df[name].alias(own) for own, name in named.items()])


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: what a worker makes of a batch of texts stays small.

    Arrow keeps the memory of batches that are done, in a worker that lives on; it is given back after each.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pool.release_unused()


def word_count(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    """UTF-8 bytes of a text; none for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def matches(
    text: Column, pattern: str, when: Column | None = None, group: int = 0, across: bool = False
) -> Column:
    """All leftmost non-overlapping matches of a pattern that takes no empty string, with places.

    Places are code points, the end exclusive. The pieces between the matches give the places; ``when``
    spares texts that cannot match. A span has the whole ``hit``, ``text`` (the hit or its ``group``), and up to
    CONTEXT characters ``before`` and ``after`` it, back to the last hit and on to the next; with ``across``
    they go on over earlier hits and over the next one.
    """
    if across:
        return _matches_across(text, pattern, when)
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(
        pieces.alias("gap"),
        hits.alias("hit"),
        shown.alias("shown"),
        F.slice(pieces, 2, 2**31 - 1).alias("next"),
    )
    zipped = zipped.cast("array<struct<gap:string,hit:string,shown:string,next:string>>")
    nothing = F.array().cast(SPANS)

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            part["hit"].alias("hit"),
            part["shown"].alias("text"),
            F.right(part["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(part["next"], F.lit(CONTEXT)).alias("after"),
        )
        grown = F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))
        return F.when(part["hit"].isNull(), state).otherwise(grown)

    first = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans"))
    placed = F.aggregate(zipped, first, add, lambda state: state["spans"])
    hit = F.regexp_like(text, F.lit(pattern))
    hit = hit if when is None else when & hit
    return F.when(F.coalesce(hit, F.lit(False)), placed).otherwise(nothing)


def _matches_across(text: Column, pattern: str, when: Column | None) -> Column:
    """``matches`` whose context does not end at other hits; the last CONTEXT characters go along."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = 2**31 - 1
    zipped = F.arrays_zip(
        pieces.alias("gap"),
        hits.alias("hit"),
        F.slice(pieces, 2, rest).alias("next"),
        F.slice(hits, 2, rest).alias("next_hit"),
        F.slice(pieces, 3, rest).alias("third"),
    )
    zipped = zipped.cast("array<struct<gap:string,hit:string,next:string,next_hit:string,third:string>>")
    nothing = F.array().cast(SPANS)
    wide = F.lit(CONTEXT)

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        before = F.right(F.concat(state["tail"], F.right(part["gap"], wide)), wide)
        after = F.concat(
            *[F.coalesce(F.left(part[name], wide), F.lit("")) for name in ("next", "next_hit", "third")]
        )
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            part["hit"].alias("hit"),
            part["hit"].alias("text"),
            before.alias("before"),
            F.left(after, wide).alias("after"),
        )
        grown = F.struct(
            end.alias("at"),
            F.right(F.concat(before, F.right(part["hit"], wide)), wide).alias("tail"),
            F.concat(state["spans"], F.array(span)).alias("spans"),
        )
        return F.when(part["hit"].isNull(), state).otherwise(grown)

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), nothing.alias("spans"))
    placed = F.aggregate(zipped, first, add, lambda state: state["spans"])
    hit = F.regexp_like(text, F.lit(pattern))
    hit = hit if when is None else when & hit
    return F.when(F.coalesce(hit, F.lit(False)), placed).otherwise(nothing)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of an array of ``(kind, start, end)`` in its order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
