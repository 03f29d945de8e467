from .builders import QueryBuilders

__all__ = ["QueryBuilders"]
