"""Fluent builders that emit the same dictionaries a JSON body would hold."""

from __future__ import annotations


class FilterJoinBuilder:
    def __init__(self, field: str):
        self._field, self._spec = field, {}

    def _set(self, key, value) -> FilterJoinBuilder:
        self._spec[key] = value
        return self

    def indices(self, *names: str):
        return self._set("indices", list(names))

    def types(self, *names: str):
        return self._set("types", list(names))

    def path(self, name: str):
        return self._set("path", name)

    def query(self, q):
        return self._set("query", q.build() if hasattr(q, "build") else q)

    def order_by(self, how: str):
        return self._set("orderBy", how)

    def max_terms_per_shard(self, n: int):
        return self._set("maxTermsPerShard", n)

    def terms_encoding(self, name: str):
        return self._set("termsEncoding", name)

    def routing(self, value: str):
        return self._set("routing", value)

    def filter_name(self, name: str):
        return self._set("_name", name)

    def boost(self, value: float):
        return self._set("boost", value)

    def build(self) -> dict:
        return {"filterjoin": {self._field: dict(self._spec)}}


class QueryBuilders:
    filter_join = FilterJoinBuilder

    @staticmethod
    def match_all() -> dict:
        return {"match_all": {}}

    @staticmethod
    def term(field: str, value) -> dict:
        return {"term": {field: value}}

    @staticmethod
    def terms(field: str, values) -> dict:
        return {"terms": {field: list(values)}}

    @staticmethod
    def range(field: str, **bounds) -> dict:
        return {"range": {field: bounds}}

    @staticmethod
    def bool_(**clauses) -> dict:
        return {"bool": {k: [q.build() if hasattr(q, "build") else q for q in (v if isinstance(v, list) else [v])] for k, v in clauses.items()}}

    @staticmethod
    def fielddata_terms(field: str, values, cache_key: int) -> dict:
        return {"fielddata_terms": {field: {"value": list(values), "_cache_key": cache_key}}}

    @staticmethod
    def termsenum_terms(field: str, values, cache_key: int) -> dict:
        return {"termsenum_terms": {field: {"value": list(values), "_cache_key": cache_key}}}
