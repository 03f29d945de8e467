"""Filter joins over a stream: arriving documents against a static lookup.

The lookup side is any query of the engine; the stream keeps its own watermark
and sinks.  No state is held, so this works with any output mode and trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..errors import QueryError
from ..operators.joins import check_kinds
from ..plans.dsl import parse_filter_join


def stream_semi(engine: Engine, stream: DataFrame, clause: dict) -> DataFrame:
    """clause: ``{"filterjoin": {...}}``; keeps the stream's rows whose field value is among the looked-up terms."""
    if not stream.isStreaming:
        raise QueryError("stream_semi needs a streaming frame")
    fj = parse_filter_join(clause["filterjoin"])
    keys = engine.terms_by_query(fj.path, fj.query, list(fj.indices) if fj.indices else None, list(fj.types) if fj.types else None, fj.encoding, fj.order_by, fj.limit)
    check_kinds(stream.schema[fj.field].dataType, keys.dtype)
    right = keys.df
    return stream.join(right, stream[fj.field] == right["term"], "left_semi")
