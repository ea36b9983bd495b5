"""Array helpers: a value computed once inside an expression, and running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths that are added up one by one; longer arrays are added up by blocks of so many.
BLOCK = 64


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` mentions it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """For each element the sum of those before it; blocks keep the work near linear."""
    none = F.array().cast("array<bigint>")

    def by_blocks(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: let(F.transform(bs, _total), lambda sums: F.flatten(F.transform(bs, lambda block, b: let(_total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(block, lambda _, i: base + _total(F.slice(block, F.lit(1), i))))))))

    return let(lengths, lambda own: F.when(F.size(own) > 0, by_blocks(own)).otherwise(none))


def match_spans(text: Column, pattern: str) -> Column:
    """``struct<s, e>`` in characters of each match of a pattern, from the gaps between the matches."""

    def spans(t: Column, found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x).cast("long"))
        own = F.transform(found, lambda x: F.length(x).cast("long"))
        ends = let(F.zip_with(gaps, own, lambda a, b: a + b), lambda both: F.zip_with(running(both), both, lambda a, b: a + b))
        return F.zip_with(ends, own, lambda e, n: F.struct((e - n).cast("int").alias("s"), e.cast("int").alias("e")))

    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda found: spans(t, found)))
