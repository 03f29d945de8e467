"""Request bodies: decoding, unwrapping and validation of join clauses."""

from __future__ import annotations

import base64
import copy
import json
from dataclasses import dataclass
from string import Template

from ..errors import QueryError

JOIN_KEYS = {"indices", "types", "path", "query", "orderBy", "maxTermsPerShard", "termsEncoding", "routing", "_name", "boost"}


@dataclass(frozen=True)
class FilterJoin:
    field: str
    path: str
    indices: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    query: object = None
    order_by: str | None = None
    limit: int | None = None
    encoding: str = "long"
    name: str | None = None
    boost: float = 1.0


def _names(v) -> tuple[str, ...] | None:
    if v is None or v == [] or v == "":
        return None
    return (v,) if isinstance(v, str) else tuple(v)


def parse_filter_join(body: dict) -> FilterJoin:
    if not isinstance(body, dict) or len(body) != 1:
        raise QueryError("filterjoin needs exactly one target field")
    (target, spec), = body.items()
    if not isinstance(spec, dict) or "path" not in spec:
        raise QueryError("filterjoin needs a path")
    if extra := set(spec) - JOIN_KEYS:
        raise QueryError(f"filterjoin does not know {sorted(extra)}")
    limit = spec.get("maxTermsPerShard")
    return FilterJoin(target, spec["path"], _names(spec.get("indices")), _names(spec.get("types")), spec.get("query"), spec.get("orderBy"), None if limit is None or int(limit) == -1 else int(limit), str(spec.get("termsEncoding", "long")).lower(), spec.get("_name"), float(spec.get("boost", 1.0)))


def parse_terms_filter(clause: str, body: dict) -> tuple[str, list]:
    """``fielddata_terms`` and ``termsenum_terms``: a literal key set with its cache key."""
    fields = {k: v for k, v in body.items() if k not in ("_name", "_cache_key")}
    if len(fields) != 1:
        raise QueryError(f"{clause} needs exactly one field")
    (name, spec), = fields.items()
    if not isinstance(spec, dict):
        raise QueryError(f"{clause} needs an object for its field")
    if extra := set(spec) - {"value", "_cache_key", "_name"}:
        raise QueryError(f"{clause} does not know {sorted(extra)}")
    for key in ("value", "_cache_key"):
        if key not in spec:
            raise QueryError(f"{clause} needs {key}")
    return name, list(spec["value"])


def unwrap(node):
    """Replaces each ``wrapper`` by the query it holds, so that joins in it are planned."""
    if isinstance(node, list):
        return [unwrap(x) for x in node]
    if not isinstance(node, dict):
        return node
    if set(node) == {"wrapper"}:
        raw = node["wrapper"]
        raw = raw.get("query") if isinstance(raw, dict) else raw
        try:
            text = base64.b64decode(raw, validate=True) if isinstance(raw, str) else bytes(raw)
            inner = json.loads(text)
        except (ValueError, TypeError) as e:
            raise QueryError(f"wrapper holds no query: {e}") from e
        if not isinstance(inner, dict) or not inner:
            raise QueryError("wrapper holds no query")
        first = next(iter(inner))
        return unwrap({first: inner[first]})
    return {k: unwrap(v) for k, v in node.items()}


def decode(body) -> dict:
    if body is None:
        return {}
    if isinstance(body, (str, bytes)):
        body = json.loads(body)
    if not isinstance(body, dict):
        raise QueryError("a request body is an object")
    return unwrap(copy.deepcopy(body))


def render_template(source, params: dict) -> dict:
    """``{{name}}`` placeholders filled in with JSON-escaped parameters."""

    class _T(Template):
        pattern = r"\{\{(?:(?P<escaped>\{\{)|(?P<named>[A-Za-z_]\w*)\}\}|(?P<braced>(?!))|(?P<invalid>))"

    text = source if isinstance(source, str) else json.dumps(source)
    try:
        return decode(_T(text).substitute({k: json.dumps(v)[1:-1] if isinstance(v, str) else json.dumps(v) for k, v in params.items()}))
    except (KeyError, ValueError) as e:
        raise QueryError(f"template: {e}") from e


def parse_uri(q: str) -> dict:
    """``field:value`` pairs, all of which must hold."""
    must = []
    for part in q.split(" AND "):
        name, sep, value = part.strip().partition(":")
        if not sep:
            raise QueryError(f"q needs field:value, not {part!r}")
        must.append({"match_all": {}} if (name, value) == ("*", "*") else {"term": {name: value.strip('"')}})
    return must[0] if len(must) == 1 else {"bool": {"must": must}}


def joins_in(node) -> list[dict]:
    """Every filterjoin below a node, innermost first."""
    out: list[dict] = []
    if isinstance(node, list):
        for x in node:
            out += joins_in(x)
    elif isinstance(node, dict):
        for k, v in node.items():
            out += joins_in(v)
            if k == "filterjoin":
                out.append(v)
    return out
