"""Text expressions: normalised keys, tokens, keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default keywords of the bug filter, in their order of precedence.
BUG_KEYWORDS = ["bug", "bugs", "buggy", "crash", "crashing", "lag", "laggy", "slow", "glitch", "error", "issue", "problem", "broken", "freeze", "frozen", "hang", "fail", "failure"]

#: White space as Python and Unicode have it, for Java's regular expressions.
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def normalize_text(text: Column, unicode_space: bool = True) -> Column:
    """Lower-cased, each run of white space one space, trimmed; null becomes empty."""
    space = UNICODE_SPACE if unicode_space else r"\s+"
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), space, " "))


def dup_key(user: Column, business: Column, text: Column, unicode_space: bool = True) -> Column:
    """``user || '||' || business || '||' || normalised text``; nulls become empty."""
    empty = F.lit("")
    return F.concat(F.coalesce(user, empty), F.lit("||"), F.coalesce(business, empty), F.lit("||"), normalize_text(text, unicode_space))


def tokens(text: Column, shortest: int = 3) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, of at least ``shortest`` characters; null for null."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t) >= shortest))


def keyword_pattern(keywords: list[str]) -> str:
    """An alternation of the escaped keywords, leftmost first; parts of words match."""
    return "|".join(re.escape(k.lower()) for k in keywords)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    return F.lower(text).rlike(keyword_pattern(keywords))


def keyword_matches(text: Column, keywords: list[str]) -> Column:
    """Sorted distinct keywords found, as an array; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({keyword_pattern(keywords)})"), F.lit(1))
    return F.array_sort(F.array_distinct(found))
