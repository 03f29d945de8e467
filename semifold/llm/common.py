"""What the operators share: scratch tables in the cluster's shared folder, and column handling.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: each executor
reads what another wrote, and a lost executor loses nothing.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (a local session) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.environ.get("SEMIFOLD_SCRATCH") or os.environ.setdefault("SEMIFOLD_SCRATCH", tempfile.mkdtemp(prefix="semifold-"))
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/semifold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame once and returns a scan of it."""
    path = fresh_dir(df.sparkSession, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Largest table that ``join_small`` broadcasts, and over how many tasks it spreads a key beyond that.
BROADCAST_KEYS, SALTS = 100_000, 64


def join_small(rows: DataFrame, table: DataFrame, on: Column, salt: Column) -> DataFrame:
    """Inner join to a table of one row per key, a key of which may hold most rows.

    The table's rows are counted: up to BROADCAST_KEYS it is broadcast; beyond
    that it is repeated once per salt and rows are dealt by key and ``salt``.
    """
    if table.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), on)
    spread = table.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt1", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return salted.join(spread, on & (F.col("__salt1") == F.col("__salt2"))).drop("__salt1", "__salt2")
