"""Relevance of text clauses, as an ordinary column.

Classic vector-space weighting: sqrt(tf) * idf^2 / sqrt(length), where idf is
1 + ln(N / (df + 1)).  N and df come from one aggregate over the index, read as
a scalar subquery, so the score is computed in the same scan as the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import analyse_literal, contains_token, field_length, term_frequency


def text_score(index_df: DataFrame, name: str, value: object) -> Column:
    out = F.lit(0.0)
    for t in analyse_literal(value):
        stats = index_df.agg(F.pow(F.lit(1.0) + F.log(F.count("*") / (F.count_if(contains_token(F.col(name), t)) + 1)), 2).alias("w"))
        tf = term_frequency(F.col(name), t)
        out = out + F.coalesce(F.sqrt(tf) * stats.scalar() / F.sqrt(F.greatest(field_length(F.col(name)), F.lit(1))), F.lit(0.0))
    return out
