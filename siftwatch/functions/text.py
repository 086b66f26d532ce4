"""Text expressions: cleaning, tags, keyword evidence, search and display strings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

KEYWORD_POINTS = 0.15
# Beyond this many keywords one generated expression per keyword no longer pays; a lambda over an array does.
INLINE_KEYWORDS = 200


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def contains_any(text, needles: Sequence[str]) -> Column:
    c = _c(text)
    return reduce(lambda a, b: a | b, [c.contains(F.lit(n)) for n in needles], F.lit(False))


def matched_keywords(lower_text, keywords: Sequence[str]) -> Column:
    """Keywords contained in an already lowercased column, in list order; no word boundaries; NULL text has none."""
    c = _c(lower_text)
    words = [k.lower() for k in keywords]
    if not words:
        return F.array().cast("array<string>")
    if len(words) <= INLINE_KEYWORDS:
        return F.array_compact(F.array(*[F.when(c.contains(F.lit(k)), F.lit(k)) for k in words]))
    every = F.array(*[F.lit(k) for k in words])
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(every, lambda k: F.contains(c, k)))


def keyword_points(n) -> Column:
    return F.least(_c(n).cast("double") * F.lit(KEYWORD_POINTS), F.lit(1.0))


def tag_array(tags, strip_tags: bool = True) -> Column:
    parts = F.split(_c(tags), ",")
    return F.transform(parts, lambda t: strip(t)) if strip_tags else parts


def search(pattern: str, *columns: str) -> Column:
    """Case-insensitive regular expression found in any of the columns; a missing text never matches."""
    rx = F.lit("(?i)" + pattern)
    return reduce(lambda a, b: a | b, [F.coalesce(F.rlike(F.col(c), rx), F.lit(False)) for c in columns])


def head(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def clipped(text, n: int) -> Column:
    """First ``n`` characters, marked with dots only when something was cut."""
    c = _c(text)
    return F.when(F.length(c) > n, F.concat(head(c, n), F.lit("..."))).otherwise(c)
