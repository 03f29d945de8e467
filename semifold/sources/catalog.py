"""Named document collections.

An index is a DataFrame plus the few facts that the query language needs and a
DataFrame does not carry: which column discriminates types, which one is a
unique id, which fields are analysed text, and how many logical shards the
``maxTermsPerShard`` limit is counted over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class IndexDef:
    name: str
    df: DataFrame
    id_col: str | None = None
    type_col: str | None = None
    order_col: str | None = None
    analyzed: frozenset[str] = frozenset()
    num_shards: int = 1
    writes: int = 0
    path: str | None = None
    types: dict[str, T.DataType] = field(init=False)

    def __post_init__(self) -> None:
        self.types = {f.name: f.dataType for f in self.df.schema.fields}
        self.order_col = self.order_col or self.id_col

    def has(self, name: str) -> bool:
        return name in self.types

    def typed(self, names: Iterable[str] | None) -> DataFrame:
        """The documents of the given types; an index without a type column has one implicit type."""
        names = list(names or ())
        if not names or self.type_col is None:
            return self.df
        return self.df.filter(F.col(self.type_col).isin(names))

    def shard(self) -> Column:
        """Logical shard of a document: a function of its id alone, so that no physical plan changes it."""
        if self.num_shards <= 1 or self.order_col is None:
            return F.lit(0)
        if isinstance(self.types[self.order_col], T.IntegralType):
            return F.pmod(F.col(self.order_col), F.lit(self.num_shards)).cast("int")
        return F.pmod(F.xxhash64(self.order_col), F.lit(self.num_shards)).cast("int")

    def order(self) -> Column:
        return F.col(self.order_col) if self.order_col else F.lit(0)

    def version(self) -> str:
        """Changes when the files (or, for an in-memory view, the registration) behind the index change.

        Of files: time, bytes and number below the root, two calls however many there are.
        """
        parts = [f"{self.name}:{self.writes}"]
        if self.path is not None:
            spark = self.df.sparkSession
            conf = spark._jsc.hadoopConfiguration()
            root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            fs = root.getFileSystem(conf)
            for st in fs.globStatus(root) or ():
                sums = fs.getContentSummary(st.getPath())
                parts.append(f"{st.getPath()}:{st.getModificationTime()}:{sums.getLength()}:{sums.getFileCount()}")
        return hashlib.sha256("|".join(parts).encode()).hexdigest()


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._indices: dict[str, IndexDef] = {}
        self._writes = 0

    def register(self, name: str, df: DataFrame, **facts) -> IndexDef:
        """Adds or replaces an index; replacing one bumps its version."""
        self._writes += 1
        facts["analyzed"] = frozenset(facts.get("analyzed", ()))
        idx = IndexDef(name, df, writes=self._writes, **facts)
        self._indices[name] = idx
        return idx

    def register_parquet(self, name: str, path: str, **facts) -> IndexDef:
        return self._from_files(name, self.spark.read.parquet(path), path, facts)

    def register_json(self, name: str, path: str, schema=None, **facts) -> IndexDef:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return self._from_files(name, reader.json(path), path, facts)

    def register_csv(self, name: str, path: str, schema=None, **facts) -> IndexDef:
        reader = self.spark.read.option("header", True)
        return self._from_files(name, (reader.schema(schema) if schema else reader).csv(path), path, facts)

    def _from_files(self, name, df, path, facts) -> IndexDef:
        facts["analyzed"] = frozenset(facts.get("analyzed", ()))
        idx = IndexDef(name, df, path=path, **facts)
        self._indices[name] = idx
        return idx

    def alias(self, name: str, of: str, condition: Column | None = None) -> IndexDef:
        """A second name for an index, optionally with a filter that every request through it gets."""
        src = self[of]
        df = src.df if condition is None else src.df.filter(condition)
        return self.register(name, df, id_col=src.id_col, type_col=src.type_col, order_col=src.order_col, analyzed=src.analyzed, num_shards=src.num_shards)

    def __getitem__(self, name: str) -> IndexDef:
        if name not in self._indices:
            raise KeyError(f"no such index: {name}")
        return self._indices[name]

    def __contains__(self, name: str) -> bool:
        return name in self._indices

    def resolve(self, names: str | Iterable[str] | None) -> list[IndexDef]:
        """The named indices, or all of them; ``*`` at the end of a name is a wildcard."""
        if names is None:
            return list(self._indices.values())
        names = [names] if isinstance(names, str) else list(names)
        if not names or names == ["_all"]:
            return list(self._indices.values())
        out: list[IndexDef] = []
        for n in names:
            hit = [i for k, i in self._indices.items() if k.startswith(n[:-1])] if n.endswith("*") else [self[n]]
            out += [i for i in hit if i not in out]
        return out

    def versions(self, names=None) -> str:
        joined = "|".join(i.version() for i in sorted(self.resolve(names), key=lambda i: i.name))
        return hashlib.sha256(joined.encode()).hexdigest()
