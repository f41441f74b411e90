from basketry.sources.documents import collections_of, parse_documents, read_documents, scan_nested_json
from basketry.sources.tables import load_layer, write_tables

__all__ = ["collections_of", "load_layer", "parse_documents", "read_documents", "scan_nested_json", "write_tables"]
