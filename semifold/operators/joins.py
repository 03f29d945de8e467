"""Semi, anti and existence joins over scalar and multi-valued keys.

Keys are never collected: a key set is a one-column DataFrame and every form is
an equi-join, so Catalyst may broadcast it, shuffle it, put a runtime Bloom
filter in front of it, and AQE may split a hot key.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedTypeError
from ..sources.catalog import IndexDef

_fresh = itertools.count()


@dataclass
class KeySet:
    """One column ``term``; may hold repeats unless ``distinct`` is set."""

    df: DataFrame
    dtype: T.DataType
    distinct: bool = False
    broadcast: bool = False

    def unique(self) -> DataFrame:
        return self.df if self.distinct else self.df.distinct()

    def right(self) -> DataFrame:
        return F.broadcast(self.df) if self.broadcast else self.df


def element(dtype: T.DataType) -> T.DataType:
    return dtype.elementType if isinstance(dtype, T.ArrayType) else dtype


def kind(dtype: T.DataType) -> str:
    dtype = element(dtype)
    if isinstance(dtype, T.IntegralType):
        return "number"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    raise UnsupportedTypeError(f"filter joins need integral, string or date keys, not {dtype.simpleString()}")


def check_kinds(left: T.DataType, right: T.DataType) -> None:
    if kind(left) != kind(right):
        raise UnsupportedTypeError(f"cannot join {left.simpleString()} with {right.simpleString()}")


def _id(idx: IndexDef) -> str:
    if idx.id_col is None:
        raise QueryError(f"index {idx.name} needs an id column for a join on a multi-valued field")
    return idx.id_col


def _matching_ids(df: DataFrame, idx: IndexDef, field: str, keys: KeySet) -> DataFrame:
    """Ids of the documents of which any value is a key: explode, semi-join, distinct."""
    k = f"__k{next(_fresh)}"
    values = df.select(_id(idx), F.explode(field).alias(k))
    right = keys.right()
    return values.join(right, values[k] == right["term"], "left_semi").select(idx.id_col).distinct()


def semi(df: DataFrame, idx: IndexDef, field: str, keys: KeySet, how: str = "left_semi") -> DataFrame:
    check_kinds(idx.types[field], keys.dtype)
    if isinstance(idx.types[field], T.ArrayType):
        return df.join(_matching_ids(df, idx, field, keys), _id(idx), how)
    right = keys.right()
    return df.join(right, df[field] == right["term"], how)


def anti(df: DataFrame, idx: IndexDef, field: str, keys: KeySet) -> DataFrame:
    """Documents without a match; one without a value never matches and so is kept."""
    return semi(df, idx, field, keys, "left_anti")


def mark(df: DataFrame, idx: IndexDef, field: str, keys: KeySet, name: str) -> DataFrame:
    """Adds a boolean column that says whether the document matches; needs distinct keys on the right."""
    check_kinds(idx.types[field], keys.dtype)
    if isinstance(idx.types[field], T.ArrayType):
        ids = _matching_ids(df, idx, field, keys).withColumn(name, F.lit(True))
        out = df.join(ids, _id(idx), "left")
    else:
        k = f"__k{next(_fresh)}"
        right = keys.unique().select(F.col("term").alias(k), F.lit(True).alias(name))
        right = F.broadcast(right) if keys.broadcast else right
        out = df.join(right, df[field] == right[k], "left").drop(k)
    return out.withColumn(name, F.coalesce(name, F.lit(False)))
