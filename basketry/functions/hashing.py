"""Deterministic scores in ``[0, modulus)``: the only source of "randomness" in the library."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODULUS = 1_000_000


def hash_score(seed: int, *parts: Column | str, hash_fn: str = "xxhash64", modulus: int | float = MODULUS) -> Column:
    """Score of ``(seed, *parts)``, equal for equal inputs on every engine run and partitioning.

    ``xxhash64`` hashes the seed and the parts as separate strings. ``md5`` takes the first 32 bits of the
    digest of ``seed|part|...``; other SQL engines can reproduce it. A float ``modulus`` makes the
    ``xxhash64`` value a double before the remainder is taken, which merges scores beyond 53 bits.
    Null parts are skipped by both hashes, so filter null keys first.
    """
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    strings = [F.lit(str(seed)), *(c.cast("string") for c in columns)]
    if hash_fn == "xxhash64":
        value = F.xxhash64(*strings)
    elif hash_fn == "md5":
        digest = F.md5(F.concat_ws("|", *strings))
        value = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    else:
        raise ValueError(f"hash_fn must be 'xxhash64' or 'md5', got {hash_fn!r}")
    return F.pmod(value, F.lit(modulus))
