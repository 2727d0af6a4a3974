"""Matches of a regular expression with their places, by SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Matches whose places are summed at once.
CHUNK = 64


def matches(text: Column, pattern: str, group: int | None = None, likely: Column | None = None) -> Column:
    """Array of (start, end, value[, part]) of the leftmost non-overlapping matches, in code points, end exclusive.

    The text is cut at its matches; the lengths of the cuts and of the matches
    give the places, summed a chunk of matches at a time, then over the chunks, so that no long array is
    copied for every match.  A text without a match costs one search, and not that where
    ``likely``, a cheaper test that holds for every text with a match, fails.
    ``group``: a group whose text is given as ``part``.  The pattern must not match the empty string.
    """
    cuts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.arrays_zip(F.transform(F.slice(cuts, 1, F.size(whole)), lambda c: F.length(c)).alias("skip"), whole.alias("value"), parts.alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,part:string>>")

    def add(done: Column, m: Column) -> Column:  # places from a chunk's start
        end = F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(F.lit(0))
        start = end + m["skip"]
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + F.length(m["value"])).alias("end"), m["value"].alias("value"), m["part"].alias("part"))))

    def moved(chunk: Column, by: Column) -> Column:
        return F.transform(chunk, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["part"].alias("part")))

    def places(found: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(CHUNK)), lambda i: F.aggregate(F.slice(found, i + 1, CHUNK), empty, add))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string,part:string>>>").alias("done"))
        return F.aggregate(chunks, start, lambda s, c: F.struct((s["at"] + F.element_at(c, -1)["end"]).alias("at"), F.concat(s["done"], F.array(moved(c, s["at"]))).alias("done")), lambda s: F.flatten(s["done"]))

    there = text.rlike(pattern) if likely is None else likely & text.rlike(pattern)
    return F.when(there, F.transform(F.array(both), places)[0]).otherwise(empty)


def replace_matches(text: Column, pattern: str, new: Callable[[Column], Column], likely: Column) -> Column:
    """The text with every match m replaced by new(m); ``likely`` as in :func:`matches`."""
    cuts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(cuts, F.transform(whole, new), lambda c, m: F.concat(c, F.coalesce(m, F.lit(""))))
    return F.when(likely & text.rlike(pattern), F.array_join(parts, "")).otherwise(text)
