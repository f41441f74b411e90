"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x. Its score is ``sigmoid(b + sum w_j x_j + pairs)``, where every pair of features j, l
interacts by the inner product of their factors, ``<v_j, v_l> x_j x_l``. By the sum-of-squares identity all pairs cost
one pass over the features: ``sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2) / 2``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import whole

#: Labelled documents that the model is fitted on, the bound of what the driver gathers.
SAMPLE = 6000
WORD_SLOTS = 1 << 14
FACTORS = 4
THRESHOLD = 0.3
#: Steps that a statistic between 0 and 1 is divided into; each is a feature.
STEPS = 8
STATISTICS = (
    "letters", "digits", "symbols", "upper", "spaces", "distinct words", "most frequent word", "short words",
    "long words", "lines", "distinct lines", "words ending in a letter", "sentences", "words", "characters",
    "recorded characters", "bars",
)
SLOTS = WORD_SLOTS + len(STATISTICS) * (STEPS + 1)
_MEMORY = 500_000


class Features:
    """Texts as slots and values. Hashes of words are remembered, at most ``_MEMORY`` of them."""

    def __init__(self) -> None:
        self._slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        slot = self._slots.get(word)
        if slot is None:
            if len(self._slots) >= _MEMORY:
                self._slots.clear()
            slot = self._slots[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
        return slot

    @staticmethod
    def statistics(text: str, words: list[str], counts: Counter, recorded: int | None) -> list[float]:
        """One number for each of ``STATISTICS``, those of size as logarithms, all from 0 to about 1."""
        n, chars = max(len(words), 1), max(len(text), 1)
        kinds = Counter(text)
        of = lambda test: sum(v for k, v in kinds.items() if test(k)) / chars
        letters, digits, upper, spaces = of(str.isalpha), of(str.isdigit), of(str.isupper), of(str.isspace)
        lines = [x for x in text.split("\n") if x]
        lengths = Counter(map(len, counts))
        size = lambda x: np.log1p(x) / 16
        return [
            letters,
            digits * 4,
            (1 - letters - digits - spaces) * 2,
            upper,
            spaces * 2,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            sum(v for k, v in lengths.items() if k <= 2) / max(len(counts), 1),
            sum(v for k, v in lengths.items() if k > 9) / max(len(counts), 1),
            min(1.0, 10 * len(lines) / n),
            len(set(lines)) / max(len(lines), 1),
            sum(v for w, v in counts.items() if w[-1].isalpha()) / n,
            min(1.0, 5 * sum(v for w, v in counts.items() if w[-1] in ".!?") / n),
            size(len(words)),
            size(len(text)),
            size(recorded if recorded is not None and recorded >= 0 else len(text)),
            min(1.0, 2 * counts.get("|", 0) / n),
        ]

    def parts(self, text: str, recorded: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the words, each once, and the statistics, each from 0 to 1."""
        words = text.split()
        counts = Counter(words)
        slots = np.unique(np.fromiter((self._slot(w) for w in counts), dtype=np.uint16, count=len(counts)))
        return slots, np.clip(self.statistics(text, words, counts, recorded), 0, 1)


def vector(words: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: the words share a length of 1, each statistic has its step and its plain value."""
    base = WORD_SLOTS + np.arange(len(numbers)) * (STEPS + 1)
    steps = np.minimum((numbers * STEPS).astype(np.int64), STEPS - 1)
    values = np.concatenate([np.full(len(words), 1 / np.sqrt(max(len(words), 1))), np.full(len(numbers), 0.5), numbers])
    return np.concatenate([words.astype(np.int64), base + steps, base + STEPS]), values


def vectors(documents: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of several documents, and where each begins."""
    found = [vector(*d) for d in documents]
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])[:-1]]).astype(np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([v for _, v in found]), starts


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the documents that begin at ``starts``, each with at least one feature."""
        if not len(starts):
            return np.zeros(0)
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        weighted = self.factors[slots] * values[:, None]
        sums, squares = np.add.reduceat(weighted, starts), np.add.reduceat(weighted**2, starts)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * (sums**2 - squares).sum(1), -30, 30)))


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 300, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 1) -> FactorisationMachine:
    """Fit by mini-batches of the logistic loss with per-slot step sizes, ``steps`` at least. Without both labels: the smoothed rate.

    ``documents`` are parts as of :meth:`Features.parts`; only those of a batch are vectors at a time.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    draw = np.random.default_rng(seed)
    weights, factors = np.zeros(SLOTS), draw.normal(0, 0.05, (SLOTS, FACTORS))
    if len(set(labels.tolist())) < 2:
        return FactorisationMachine(bias, weights, np.zeros_like(factors))
    seen_w, seen_v, seen_b = np.full(SLOTS, 1e-3), np.full((SLOTS, FACTORS), 1e-3), 1e-3
    for _ in range(max(4, -(-steps * batch // len(documents)))):
        for start in range(0, len(order := draw.permutation(len(documents))), batch):
            chosen = order[start : start + batch]
            slots, values, starts = vectors([documents[d] for d in chosen])
            sizes = np.diff(np.concatenate([starts, [len(slots)]]))
            model = FactorisationMachine(bias, weights, factors)
            error = (model.scores(slots, values, starts) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes) * values
            sums = np.add.reduceat(factors[slots] * values[:, None], starts)
            touched, at = np.unique(slots, return_inverse=True)
            slope_w = np.bincount(at, each) + decay * weights[touched]
            slope_v = decay * factors[touched]
            inner = np.repeat(sums, sizes, axis=0) - factors[slots] * values[:, None]
            for f in range(FACTORS):
                slope_v[:, f] += np.bincount(at, each * inner[:, f])
            seen_w[touched] += slope_w**2
            seen_v[touched] += slope_v**2
            seen_b += error.sum() ** 2
            weights[touched] -= rate * slope_w / np.sqrt(seen_w[touched])
            factors[touched] -= rate * slope_v / np.sqrt(seen_v[touched])
            bias -= rate * error.sum() / np.sqrt(seen_b)
    return FactorisationMachine(bias, weights, factors)


def held_out(id_col: str):
    """Ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _columns(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    recorded = F.col(chars_col).cast("bigint") if chars_col in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), recorded.alias("recorded"))


#: Rows and characters of the texts that are vectors at a time.
PART_ROWS, PART_CHARS = 500, 2_000_000


def _parts(features: Features, texts: pa.Array, recorded: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The documents of a batch, as parts, a few at a time: at most ``PART_ROWS``, ``PART_CHARS`` but for a single text."""
    found, chars = [], 0
    for text, number in zip(texts, recorded, strict=True):
        text = text.as_py()
        if found and (len(found) >= PART_ROWS or chars + len(text) > PART_CHARS):
            yield found
            found, chars = [], 0
        found.append(features.parts(text, number.as_py()))
        chars += len(text)
    if found:
        yield found


def _scores(model: tuple, features: Features, texts: pa.Array, recorded: pa.Array) -> pa.Array:
    machine = FactorisationMachine(*model)
    return pa.array(np.concatenate([np.zeros(0), *(machine.scores(*vectors(part)) for part in _parts(features, texts, recorded))]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        found = [d for part in _parts(features, batch.column("text"), batch.column("recorded")) for d in part]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), *(pa.array([d[i].tobytes() for d in found], pa.binary()) for i in range(2))], names=["quality", "words", "numbers"]
        )


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> FactorisationMachine:
    """Learn ``labels`` (``doc_id``, ``quality`` 0 or 1) from at most ``sample`` labelled documents.

    The sample is those with the smallest hashes of their ids, held-out ids excluded. Null and other labels are not
    used; of several labels of a document the smallest counts, of several texts under an id the first in order. Language,
    source and id are no features. The driver gathers ``sample`` rows of at most ``WORD_SLOTS`` numbers of two bytes.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _columns(docs, id_col, text_col, chars_col).join(F.broadcast(chosen), "doc_id")  # ``sample`` short rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "recorded", "quality")).alias("row")).select("row.*")
    found = rows.mapInArrow(_packed, "quality int, words binary, numbers binary").toArrow()
    # In an order of their own, whatever the partitions.
    documents = sorted(zip(*(found[c].to_pylist() for c in ("quality", "words", "numbers")), strict=True))
    parts = [(np.frombuffer(w, dtype=np.uint16), np.frombuffer(n)) for _, w, n in documents]
    return train(parts, np.array([q for q, _, _ in documents], dtype=float))


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    A null text counts as empty and is scored by its statistics; a null or negative ``n_chars`` by the length of the
    text. Repeated rows get equal scores. Documents are scored where they lie, whole, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))  # SLOTS x (FACTORS + 1) numbers, at any data size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = _scores(shared.value, features, batch.column("text"), batch.column("recorded"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

    rows = _columns(docs, id_col, text_col, chars_col).withColumn("held_out", held_out("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, where they lie.

    Scores are those of :func:`score_quality`, with its rules for nulls and empty texts: a document with a null text is
    judged as an empty one. Rows that repeat each other are kept or go together; no column but the two named is read,
    and no name is added, so other columns may have any name. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))
    features = Features()

    @F.arrow_udf("double")
    def score(text: pa.Array, recorded: pa.Array) -> pa.Array:
        return _scores(shared.value, features, text, recorded)

    recorded = F.col(chars_col).cast("bigint") if chars_col in docs.columns else F.lit(None).cast("bigint")
    return docs.where(score(whole(text_col), recorded) >= threshold)
