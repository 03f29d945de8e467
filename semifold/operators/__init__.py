from .joins import KeySet, anti, mark, semi
from .terms import TermsResult, terms_by_query

__all__ = ["KeySet", "TermsResult", "anti", "mark", "semi", "terms_by_query"]
