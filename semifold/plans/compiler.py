"""From a boolean query to one lazy DataFrame.

Join clauses that are conjuncts of the whole query become semi or anti joins.
Those below a disjunction, below the negation of a compound, or in an
aggregation become a boolean mark column.  Everything else is a predicate.
Negations are two-valued: an unknown predicate counts as false.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.scoring import text_score
from ..functions.text import contains_token
from ..operators.joins import KeySet, anti, check_kinds, mark, semi
from ..operators.terms import TermsResult, terms_by_query, validate
from ..sources.catalog import Catalog, IndexDef
from .dsl import FilterJoin, parse_filter_join, parse_terms_filter

#: More literal values than this join a broadcast table instead of an IN list; the values came in the request, so they are bounded by it.
IN_LIST = 10_000
#: Up to this many keys in all shards, a bytes-encoded key set is broadcast.
BROADCAST_KEYS = 100_000

_fresh = itertools.count()


@dataclass
class Action:
    """What one join did; counted when asked for."""

    join: FilterJoin
    to: FilterJoin | None
    indices: list[str]
    terms: TermsResult | None
    cache_hit: bool = False


@dataclass
class Compiler:
    catalog: Catalog
    cache: object = None
    max_terms: int | None = None
    actions: list[Action] = field(default_factory=list)

    # ---- key sets -------------------------------------------------------

    def keys(self, fj: FilterJoin, parent: FilterJoin | None) -> KeySet | None:
        """The lookup side; None if no index has the path, which joins nothing."""
        validate(fj.encoding, fj.limit, fj.order_by)
        indices = [i for i in self.catalog.resolve(fj.indices) if i.has(fj.path)]
        names = [i.name for i in indices]
        if not indices:
            self.actions.append(Action(fj, parent, names, None))
            return None
        for i in indices[1:]:
            check_kinds(indices[0].types[fj.path], i.types[fj.path])
        parts = [(i, self.filter(i, i.typed(fj.types), fj.query, fj), self.score(i, fj.query) if fj.order_by == "doc_score" else F.lit(1.0)) for i in indices]
        made, hit = terms_by_query(parts, fj.path, encoding=fj.encoding, limit=fj.limit, order_by=fj.order_by), False
        if self.max_terms is not None:
            made = made.capped(self.max_terms)
        if self.cache is not None:
            made, hit = self.cache.get_or_add(fj, self.catalog, made)
        self.actions.append(Action(fj, parent, names, made, hit))
        shards = sum(i.num_shards for i in indices)
        small = fj.encoding == "bytes" and fj.limit is not None and fj.limit * shards <= BROADCAST_KEYS
        return KeySet(made.df, made.dtype, made.distinct, small)

    # ---- filters --------------------------------------------------------

    def filter(self, idx: IndexDef, df: DataFrame, q, parent: FilterJoin | None = None) -> DataFrame:
        cols = df.columns
        df = self._conj(idx, df, q, parent)
        return df.select(*cols) if df.columns != cols else df

    def _conj(self, idx: IndexDef, df: DataFrame, q, parent) -> DataFrame:
        if q is None or q == {}:
            return df
        name, body = self._clause(q)
        if name == "filterjoin":
            return self._semi(idx, df, body, parent, semi)
        if name == "constant_score":
            return self._conj(idx, df, body.get("filter", body.get("query")), parent)
        if name == "filtered":
            return self._conj(idx, self._conj(idx, df, body.get("query"), parent), body.get("filter"), parent)
        if name == "function_score":
            return self._conj(idx, df, body.get("query"), parent)
        if name == "bool":
            must, should, must_not = self._bool(body)
            for x in must:
                df = self._conj(idx, df, x, parent)
            for x in must_not:
                if self._clause(x)[0] == "filterjoin":
                    df = self._semi(idx, df, self._clause(x)[1], parent, anti)
                else:
                    df, p = self.predicate(idx, df, x, parent)
                    df = df.filter(~F.coalesce(p, F.lit(False)))
            if should and not must:
                if len(should) == 1:
                    return self._conj(idx, df, should[0], parent)
                df, p = self.predicate(idx, df, {"bool": {"should": should}}, parent)
                df = df.filter(p)
            return df
        df, p = self.predicate(idx, df, q, parent)
        return df.filter(p)

    def _semi(self, idx, df, body, parent, how) -> DataFrame:
        fj = parse_filter_join(body)
        keys = self.keys(fj, parent)
        if keys is None or not idx.has(fj.field):
            return df.filter(F.lit(False)) if how is semi else df
        return how(df, idx, fj.field, keys)

    # ---- predicates -----------------------------------------------------

    def predicate(self, idx: IndexDef, df: DataFrame, q, parent=None) -> tuple[DataFrame, Column]:
        """A boolean column for the clause, on a frame that may have gained mark columns for it."""
        if q is None or q == {}:
            return df, F.lit(True)
        name, body = self._clause(q)
        if name == "match_all":
            return df, F.lit(True)
        if name == "filterjoin":
            fj = parse_filter_join(body)
            keys = self.keys(fj, parent)
            if keys is None or not idx.has(fj.field):
                return df, F.lit(False)
            col = f"_matched_{fj.name}" if fj.name else f"__fj{next(_fresh)}"
            return mark(df, idx, fj.field, keys, col), F.col(col)
        if name in ("fielddata_terms", "termsenum_terms"):
            f, values = parse_terms_filter(name, body)
            return self._literal(idx, df, f, values)
        if name in ("constant_score", "function_score"):
            return self.predicate(idx, df, body.get("filter", body.get("query")), parent)
        if name == "filtered":
            df, a = self.predicate(idx, df, body.get("query"), parent)
            df, b = self.predicate(idx, df, body.get("filter"), parent)
            return df, a & b
        if name == "bool":
            must, should, must_not = self._bool(body)
            out: Column | None = None
            for x in must:
                df, p = self.predicate(idx, df, x, parent)
                out = p if out is None else out & p
            if should and not must:
                any_: Column | None = None
                for x in should:
                    df, p = self.predicate(idx, df, x, parent)
                    p = F.coalesce(p, F.lit(False))
                    any_ = p if any_ is None else any_ | p
                out = any_
            for x in must_not:
                df, p = self.predicate(idx, df, x, parent)
                p = ~F.coalesce(p, F.lit(False))
                out = p if out is None else out & p
            return df, F.lit(True) if out is None else out
        if name in ("term", "match"):
            (f, v), = body.items()
            return df, self._term(idx, f, v.get("value", v.get("query")) if isinstance(v, dict) else v)
        if name == "terms":
            (f, vs), = ((k, v) for k, v in body.items() if not k.startswith("_"))
            if idx.has(f) and f in idx.analyzed:
                out = F.lit(False)
                for v in vs:
                    out = out | self._term(idx, f, v)
                return df, out
            return self._literal(idx, df, f, vs)
        if name == "range":
            (f, bounds), = body.items()
            return df, self._range(idx, f, bounds)
        if name == "exists":
            f = body["field"]
            return df, (F.col(f).isNotNull() if idx.has(f) else F.lit(False))
        if name in ("ids",):
            return self._literal(idx, df, idx.id_col or "", body["values"])
        raise QueryError(f"unknown query clause: {name}")

    @staticmethod
    def _clause(q) -> tuple[str, object]:
        if not isinstance(q, dict) or len(q) != 1:
            raise QueryError(f"a clause is an object with one key, not {q!r}")
        return next(iter(q.items()))

    @staticmethod
    def _bool(body: dict) -> tuple[list, list, list]:
        if extra := set(body) - {"must", "filter", "should", "must_not", "boost", "minimum_should_match", "_name"}:
            raise QueryError(f"bool does not know {sorted(extra)}")
        as_list = lambda v: [] if v is None else v if isinstance(v, list) else [v]
        return as_list(body.get("must")) + as_list(body.get("filter")), as_list(body.get("should")), as_list(body.get("must_not"))

    def _lit(self, idx: IndexDef, f: str, v) -> Column:
        """A literal in the column's type; one that does not convert is null and matches nothing."""
        t = idx.types[f]
        t = t.elementType if isinstance(t, T.ArrayType) else t
        return F.lit(v) if isinstance(t, T.StringType) and isinstance(v, str) else F.lit(str(v).lower() if isinstance(v, bool) else str(v)).try_cast(t)

    def _term(self, idx: IndexDef, f: str, v) -> Column:
        if not idx.has(f):
            return F.lit(False)
        if f in idx.analyzed:
            return contains_token(F.col(f), v)
        if isinstance(idx.types[f], T.ArrayType):
            return F.array_contains(F.col(f), self._lit(idx, f, v))
        return F.col(f) == self._lit(idx, f, v)

    def _literal(self, idx: IndexDef, df: DataFrame, f: str, values: list) -> tuple[DataFrame, Column]:
        if not idx.has(f) or not values:
            return df, F.lit(False)
        t = idx.types[f]
        if isinstance(t, T.ArrayType):
            return df, F.arrays_overlap(F.col(f), F.array(*[self._lit(idx, f, v) for v in values]))
        if len(values) <= IN_LIST:
            return df, F.col(f).isin([self._lit(idx, f, v) for v in values])
        spark = df.sparkSession
        table = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").try_cast(t).alias("term")).filter("term is not null")
        col = f"__lit{next(_fresh)}"
        return mark(df, idx, f, KeySet(table, t, broadcast=True), col), F.col(col)

    def _range(self, idx: IndexDef, f: str, bounds: dict) -> Column:
        if not idx.has(f):
            return F.lit(False)
        ops = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__", "from": "__ge__", "to": "__le__"}
        if extra := set(bounds) - set(ops) - {"format", "boost", "time_zone"}:
            raise QueryError(f"range does not know {sorted(extra)}")
        multi = isinstance(idx.types[f], T.ArrayType)

        def test(c: Column) -> Column:
            out = F.lit(True)
            for k, v in bounds.items():
                if k in ops and v is not None:
                    out = out & getattr(c, ops[k])(self._lit(idx, f, v))
            return out

        return F.exists(F.col(f), test) if multi else test(F.col(f)) & F.col(f).isNotNull()

    # ---- scores ---------------------------------------------------------

    def score(self, idx: IndexDef, q) -> Column:
        """Relevance: text terms weigh by TF-IDF, joins and other filters are constant."""
        if q is None or q == {}:
            return F.lit(1.0)
        name, body = self._clause(q)
        if name in ("term", "match"):
            (f, v), = body.items()
            v = v.get("value", v.get("query")) if isinstance(v, dict) else v
            return text_score(idx.df, f, v) if idx.has(f) and f in idx.analyzed else F.lit(1.0)
        if name == "function_score":
            fv = body.get("field_value_factor", {}).get("field")
            return F.coalesce(F.col(fv).cast("double"), F.lit(0.0)) if fv else self.score(idx, body.get("query"))
        if name == "filterjoin":
            return F.lit(parse_filter_join(body).boost)
        if name == "constant_score":
            return F.lit(float(body.get("boost", 1.0)))
        if name == "bool":
            out = F.lit(0.0)
            for kind in ("must", "should"):
                clauses = body.get(kind) or []
                for x in clauses if isinstance(clauses, list) else [clauses]:
                    out = out + self.score(idx, x)
            return out
        if name == "filtered":
            return self.score(idx, body.get("query"))
        return F.lit(1.0)
