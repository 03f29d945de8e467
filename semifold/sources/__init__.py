from .catalog import Catalog, IndexDef

__all__ = ["Catalog", "IndexDef"]
