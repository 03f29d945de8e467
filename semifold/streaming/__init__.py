from .semi import stream_semi

__all__ = ["stream_semi"]
