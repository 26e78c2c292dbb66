"""All registered queries."""

from lutrin.plans import activity, collections, corpus, evaluation, retrieval, streams
from lutrin.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "activity", "collections", "corpus", "evaluation", "retrieval", "streams"]
