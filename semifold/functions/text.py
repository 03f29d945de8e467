"""Analysed text: lower-cased runs of letters, digits and underscores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SPLIT), lambda t: t != "")


def analyse_literal(value: object) -> list[str]:
    return [t for t in re.split(r"[^\w]+", str(value).lower()) if t]


def contains_token(c: Column, value: object) -> Column:
    """Whether the text has the token; one regular expression, so no token array is built."""
    wanted = analyse_literal(value)
    if not wanted:
        return F.lit(False)
    out = None
    for t in wanted:
        hit = F.lower(c).rlike(rf"(^|[^\p{{L}}\p{{N}}_])\Q{t}\E([^\p{{L}}\p{{N}}_]|$)")
        out = hit if out is None else out & hit
    return out


def term_frequency(c: Column, value: str) -> Column:
    """How many tokens of the text equal the value."""
    return F.size(F.filter(tokens(c), lambda t: t == value))


def field_length(c: Column) -> Column:
    return F.size(tokens(c))
