"""semifold: relational search over document collections, compiled to Spark plans."""

from .engine import Engine, EngineConfig, SearchError, SearchResult
from .sources.catalog import Catalog, IndexDef

__all__ = ["Catalog", "Engine", "EngineConfig", "IndexDef", "SearchError", "SearchResult"]
