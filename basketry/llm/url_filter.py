"""URL rules in a sorted, memory-mapped array of 64-bit digests, probed by vectorised binary search."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rules that one index may hold: they pass the driver once, and each executor maps about 100 bytes of disk for each.
MAX_RULES = 5_000_000


def url_host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlRules:
    """An index of rules ``host/path``, each with a verdict, in files that every executor fetches once.

    ``keys`` is sorted; ``text[ends[i-1]:ends[i]]`` is the UTF-8 text of the rule of key ``i``. Different rules with
    one digest stand next to each other. Of two verdicts for one rule the block stays.
    """

    def __init__(self, spark: SparkSession, rules: Iterable[tuple[str, str]], max_rules: int = MAX_RULES, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> None:
        verdicts: dict[str, bool] = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block") or "/" not in rule:
                raise ValueError(f"not a rule: {verdict} {rule}")
            verdicts[rule] = verdicts.get(rule, False) or verdict == "block"
            if len(verdicts) > max_rules:
                raise ValueError(f"more than {max_rules} rules: divide them over several indexes")
        self.digest = digest
        self.lengths = sorted({len(rule) - rule.index("/") for rule in verdicts})
        # Parts of the longest host of a rule: a longer suffix of a url's host fits none.
        self.parts = max((rule[: rule.index("/")].count(".") + 1 for rule in verdicts), default=0)
        ordered = sorted((digest(rule.encode()), rule) for rule in verdicts)
        texts = [rule.encode() for _, rule in ordered]
        arrays = {
            "keys": np.array([key for key, _ in ordered], dtype=np.uint64),
            "ends": np.cumsum([len(t) for t in texts], dtype=np.int64),
            "text": np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8),
            "block": np.array([verdicts[rule] for _, rule in ordered], dtype=bool),
        }
        self._name = f"url-rules-{uuid4().hex}"
        # The driver's copies, from which Spark serves every executor, also one that starts later: they go with the process.
        folder = tempfile.mkdtemp(prefix="url-rules-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for part, array in arrays.items():
            path = os.path.join(folder, f"{self._name}-{part}.npy")
            np.save(path, array)
            spark.sparkContext.addFile(path)

    def _open(self) -> dict[str, np.ndarray]:
        parts = {}
        for part in ("keys", "ends", "text", "block"):
            path = SparkFiles.get(f"{self._name}-{part}.npy")
            try:
                parts[part] = np.load(path, mmap_mode="r")
            except ValueError:  # an empty array can't be mapped
                parts[part] = np.load(path)
        return parts

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """The rules that could fit, longest first for each length of path."""
        ends = host.rsplit(".", self.parts)[-self.parts :] if self.parts else []
        suffixes = [".".join(ends[at:]) for at in range(len(ends))]
        for length in self.lengths:
            if length <= len(path):
                start = path[:length]
                for suffix in suffixes:
                    yield suffix + start

    def judge(self, batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
        index = self._open()
        keys, ends, text, block = (index[p] for p in ("keys", "ends", "text", "block"))
        for batch in batches:
            owners, found = [], []
            for row, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for rule in self.candidates(host, path):
                    owners.append(row)
                    found.append(rule)
            digests = np.array([self.digest(rule.encode()) for rule in found], dtype=np.uint64)
            low, high = np.searchsorted(keys, digests, "left"), np.searchsorted(keys, digests, "right")
            rules: list[str | None] = [None] * batch.num_rows
            blocked = [False] * batch.num_rows
            for hit in np.flatnonzero(low < high):
                row, rule = owners[hit], found[hit]
                for at in range(low[hit], high[hit]):
                    stored = bytes(text[ends[at - 1] if at else 0 : ends[at]]).decode()
                    if stored == rule and (rules[row] is None or len(rule) > len(rules[row])):
                        rules[row], blocked[row] = rule, bool(block[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(rules, pa.string()), pa.array(["block" if b else "allow" for b in blocked], pa.string())],
                names=[*keep, "rule", "verdict"],
            )


def filter_urls(pages: DataFrame, rules: UrlRules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path of the url starts with its own path, which begins with the
    ``/``; the longest wins. A url without a fitting rule is in no list: ``rule`` is null and it is allowed. A null
    url, or one without ``://``, has an empty host and path, so no rule fits. Null ids, repeated rows and empty
    tables pass through; other columns are not read. Rows are judged where they lie, without a shuffle.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    keep = ["page_id", "host", "path"]
    return parts.mapInArrow(
        lambda batches: rules.judge(batches, keep), f"page_id {kind}, host string, path string, rule string, verdict string"
    )
