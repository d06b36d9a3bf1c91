"""Text normalising, tokens and snippets for local retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def tokens(c: Column, least: int = 3) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: F.length(t) >= least)


def snippet(text: Column, terms: list[str], most: int = 700, before: int = 120) -> Column:
    """Around the earliest term: white space squeezed, `before` characters ahead, `most` in all, dots where cut."""
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    low = F.lower(t)
    hits = [F.expr("nullif(0, 0)")] + [F.when(F.locate(w, low) > 0, F.locate(w, low)) for w in terms]
    pos = F.coalesce(F.least(*hits) if len(hits) > 1 else hits[0], F.lit(1))
    start = F.greatest(F.lit(1), pos - before)
    body = F.substring(t, start, F.lit(most))
    return F.when(t == "", "").otherwise(F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(F.length(t) > start + most - 1, "...").otherwise("")))
