from basketry.functions.checks import validate_ks, validate_ratios
from basketry.functions.hashing import hash_score
from basketry.functions.text import clean_text, last_segment_id, source_slice_range

__all__ = ["clean_text", "hash_score", "last_segment_id", "source_slice_range", "validate_ks", "validate_ratios"]
