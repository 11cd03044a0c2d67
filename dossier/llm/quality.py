"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its text's features. The probability that a good
document beats a bad one is the logistic function of the difference of their strengths, so fitting pairs is
logistic regression on feature differences. Every labelled row takes part: rows are dealt into blocks by hash, and
within a block each row meets a fixed number of rows of the other label, so pairs grow with the rows. Sums over pairs
are made in the tasks; what comes back is a vector and a matrix of the features' number. The strength at the rank that
the number of bad labels names, found from counts of all strengths, becomes the score's threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import hashed_words, slices, text_bytes
from dossier.session import materialize

#: Labelled rows of a block, within which pairs are made.
BLOCK_ROWS = 4096
#: Opponents that a row of the rarer label meets at least, and one of the other label.
ROUNDS = 8
RIDGE = 1e-3
#: A score of this much or more predicts label 1.
THRESHOLD = 0.7

_SIGNS = b"!$%&*#|.,;:?\"'()-_/\\<>=+@[]{}~^`"
FEATURES = ("log_bytes", "upper", "digit", "space", "newline", "high", *(f"sign_{chr(s)}" for s in _SIGNS),
            "word_bytes", "distinct", "signed_words", "top_word", "line_bytes")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text: shares of kinds of bytes, lengths of words and lines, repetition."""
    rows = len(offsets) - 1
    own = data[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(rows), sizes)
    counts = np.bincount(row * 256 + own, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    n = np.maximum(sizes, 1)
    shares = [counts[:, 65:91].sum(1) / n, counts[:, 48:58].sum(1) / n, counts[:, 32] / n, counts[:, 10] / n, counts[:, 128:].sum(1) / n]
    shares += [counts[:, s] / n for s in _SIGNS]
    at, word = hashed_words(data, offsets)
    n_words = np.bincount(at, minlength=rows)
    order = np.lexsort((word, at))
    at, word = at[order], word[order]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1]) | (word[1:] != word[:-1])
    distinct = np.bincount(at[head], minlength=rows)
    first = np.flatnonzero(head)
    most = np.zeros(rows)
    np.maximum.at(most, at[first], np.diff(np.append(first, len(at))))
    w = np.maximum(n_words, 1)
    signs = counts[:, list(_SIGNS)].sum(1)
    extra = [n / w, distinct / w ** 0.8, signs / w, most / w, np.log1p(n / (counts[:, 10] + 1))]
    return np.stack([np.log1p(sizes), *shares, *extra], axis=1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        parts = [features(data, offsets[a:b + 1]) for a, b in slices(offsets)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), x.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "features"])


@dataclass(frozen=True)
class Ranking:
    """Strength = weights . (features - mean) / scale; score = logistic of a line that meets THRESHOLD at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weights
        line = math.log(THRESHOLD / (1 - THRESHOLD)) + self.slope * (strength - self.cut)
        return 1 / (1 + np.exp(-np.clip(line, -500, 500)))


Part = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sums(known: DataFrame, part: Part, width: int) -> np.ndarray:
    """The sum of what ``part`` makes of the features and labels of every block; at most a row of numbers a task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for row in range(batch.num_rows):
                label = batch.column(1)[row].values.to_numpy()
                total += part(batch.column(0)[row].values.to_numpy(zero_copy_only=False).reshape(len(label), -1), label)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "x"])

    rows = known.select("features", "label").mapInArrow(run, "at long, x double").groupBy("at").agg(F.array_sort(F.collect_list("x")).alias("x")).collect()
    total = np.zeros(width)
    for r in rows:
        total[r["at"]] = math.fsum(r["x"])  # in sorted order, so that runs agree
    return total


def _differences(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Good minus bad features of the block's pairs: every row has at least ``ROUNDS`` of them (all, if the other label has fewer)."""
    good, bad = z[label == 1], z[label == 0]
    if not len(good) or not len(bad):
        return np.zeros((0, z.shape[1]))
    most, rounds = max(len(good), len(bad)), min(ROUNDS, len(good), len(bad))
    at = np.arange(most)
    return np.concatenate([good[at % len(good)] - bad[(at + r * max(1, len(bad) // rounds)) % len(bad)] for r in range(rounds)])


def _newton(derivatives: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], width: int, ridge: float, steps: int = 30) -> np.ndarray:
    """Logistic regression without an intercept, from the sums of gradient, curvature and number that a pass over the rows gives."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, hessian, n = derivatives(w)
        step = np.linalg.solve(hessian / max(n, 1) + ridge * np.eye(width), gradient / max(n, 1) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient, curvature and number of rows in one array."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [len(y)]])


def _split(total: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    return total[:width], total[width:-1].reshape(width, width), total[-1]


def _at_rank(known: DataFrame, strength: Callable[[np.ndarray], np.ndarray], rank: int) -> float:
    """The strength of the given rank (from 0) among all rows, from counts of 65,536 intervals at a time."""
    sign = 1 << 63

    def ordered(x: np.ndarray) -> np.ndarray:
        bits = (x + 0.0).view(np.uint64)
        return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(sign))

    prefix = 0
    for shift in (48, 32, 16, 0):
        def part(x: np.ndarray, label: np.ndarray, shift=shift, prefix=prefix) -> np.ndarray:
            keys = ordered(strength(x))
            if shift < 48:
                keys = keys[keys >> np.uint64(shift + 16) == np.uint64(prefix)]
            return np.bincount((keys >> np.uint64(shift) & np.uint64(0xFFFF)).astype(int), minlength=1 << 16).astype(float)

        counts = np.cumsum(_sums(known, part, 1 << 16))
        digit = int(np.searchsorted(counts, rank, "right"))
        rank -= int(counts[digit - 1]) if digit else 0
        prefix = prefix << 16 | digit
    bits = np.array([prefix], np.uint64)
    return float(np.where(bits >> np.uint64(63) == 1, bits & np.uint64(sign - 1), ~bits).view(np.float64)[0])


def fit(known: DataFrame) -> Ranking:
    """Weights from preference pairs of all rows of blocks ``features, label``.

    With labels of one kind only, every score is the threshold's neighbour below or above.
    """
    width = len(FEATURES)

    def moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), label.sum()], x.sum(axis=0)])

    total = _sums(known, moments, 2 + width)
    n, n_good, mean = total[0], total[1], total[2:] / max(total[0], 1)
    if not n_good or n_good == n:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0 if n_good else 1.0, 1.0)
    scale = np.sqrt(_sums(known, lambda x, label: ((x - mean) ** 2).sum(axis=0), width) / n)
    scale[scale < 1e-12] = 1

    def pairs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def part(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            d = _differences((x - mean) / scale, label)
            return _logistic(d, np.ones(len(d)), w)

        return _split(_sums(known, part, width + width * width + 1), width)

    weights = _newton(pairs, width, RIDGE)

    def strength(x: np.ndarray) -> np.ndarray:
        return ((x - mean) / scale) @ weights

    at = int(n - n_good)
    cut = (_at_rank(known, strength, at - 1) + _at_rank(known, strength, at)) / 2

    def line(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def part(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            return _logistic((strength(x) - cut)[:, None], label.astype(float), w)

        return _split(_sums(known, part, 3), 1)

    return Ranking(mean, scale, weights, cut, max(float(_newton(line, 1, 1e-6)[0]), 1e-3))


def _blocks(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Rows ``doc_id, features, label`` in blocks by hash, in which both labels occur: ``features`` in one list, and ``label``.

    With a label so rare that blocks of ``BLOCK_ROWS`` would miss it, blocks are larger.
    """
    rare = min(sizes.get(0, 0), sizes.get(1, 0)) or max(sizes.values(), default=0)
    n = max(1, min(-(-sum(sizes.values()) // BLOCK_ROWS), rare // 16))
    order = F.xxhash64("doc_id")
    row = F.struct(order.alias("h"), "doc_id", "features", "label")
    dealt = rows.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return materialize(dealt.select(F.flatten("r.features").alias("features"), F.col("r.label").alias("label")))


def held_out(doc_id) -> object:
    """Rows that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Features come from the whole text alone; null counts as empty and empty texts are scored too. Weights are fitted on all
    labelled rows that are not held out; null labels are left out. Repeated rows give
    repeated rows, an empty table an empty result, no labels the score 0.5 or so for all; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    table = materialize(rows.mapInArrow(_feature_rows, f"doc_id {kind}, features array<double>"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("label")).where("label in (0, 1)")
    rows = materialize(table.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("doc_id", "features", F.col("label").cast("int")))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit(_blocks(rows, sizes))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    out = table.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
