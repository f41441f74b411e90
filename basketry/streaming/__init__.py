"""Operators that work row by row and therefore run on a streaming DataFrame unchanged.

They hold no state and need no watermark: documents that arrive as a stream can be flattened as they come.
"""

from basketry.operators.flatten import flatten_collections, flatten_interactions
from basketry.sources.documents import collections_of, parse_documents

__all__ = ["collections_of", "flatten_collections", "flatten_interactions", "parse_documents"]
