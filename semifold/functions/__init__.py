from .text import term_frequency, tokens

__all__ = ["term_frequency", "tokens"]
