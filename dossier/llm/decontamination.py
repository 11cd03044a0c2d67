"""Benchmark decontamination by latent semantic retrieval.

Words hash to buckets that are weighted by inverse document frequency over all documents. A randomised
SVD of the benchmark passages' TF-IDF matrix, multiplied out in Spark, gives a latent space. Windows of
every document are projected there and those near a passage are candidates. A candidate is a leak if the
longest common subsequence holds most of the passage's words, or fewer of them but also its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import hashed_words, slices, text_bytes
from dossier.session import materialize

#: Buckets of word hashes.
BUCKETS = 1 << 16
#: Dimensions of the latent space, extra ones for the range finder, and rounds of power iteration.
RANK = 96
OVERSAMPLE = 16
POWER_ROUNDS = 2
#: Words in a block; a window is two neighbouring blocks.
BLOCK_WORDS = 16
#: Cosine in the latent space from which a window is a candidate.
MIN_COSINE = 0.6
#: Share of a passage's words in the longest common subsequence: alone, and with the answer found.
MIN_COMMON = 0.8
MIN_COMMON_WITH_ANSWER = 0.6
#: Words at a passage's end that stand for its answer where the benchmark has no column `answer`.
ANSWER_WORDS = 6
#: Passages that are held in memory at once; larger benchmarks are searched in several rounds.
ITEMS_AT_ONCE = 5000


def _df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket over a whole task, and in the last row the number of documents."""
    counts, docs = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        docs += len(offsets) - 1
        for a, b in slices(offsets):
            row, word = hashed_words(data, offsets[a:b + 1])
            kind = np.uint32 if b - a < 1 << 16 else np.int64  # short numbers sort faster
            seen = np.sort(row.astype(kind) << 16 | (word & np.uint64(BUCKETS - 1)).astype(kind))
            counts[:BUCKETS] += np.bincount(seen[np.diff(seen, prepend=seen[:1] + 1) != 0] & (BUCKETS - 1), minlength=BUCKETS)
    counts[BUCKETS] = docs
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])


def inverse_frequency(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(documents / documents with the bucket) over all documents; at most BUCKETS numbers come back."""
    found = docs.select(text_col).mapInArrow(_df_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS + 1)
    counts[found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    return np.log((counts[BUCKETS] + 1) / (counts[:BUCKETS] + 1)) + 1e-3


def words_and_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, words = hashed_words(data, np.array([0, len(data)]))
    return words, (words & np.uint64(BUCKETS - 1)).astype(np.int64)


def _tf_idf(texts: pd.Series, idf: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows over the benchmark's own buckets."""
    out = np.zeros((len(texts), column.max() + 1))
    for i, text in enumerate(texts):
        _, bucket = words_and_buckets(text)
        np.add.at(out[i], column[bucket], idf[bucket])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def latent_space(items: DataFrame, idf: np.ndarray, column: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (buckets by rank) of the passages' TF-IDF matrix A, by randomised subspace iteration.

    Every round multiplies by A'A in Spark: tasks multiply their rows, sums by bucket are grouped, and
    only the thin matrix comes back to be made orthogonal.
    """
    width = int(column.max()) + 1
    thin = min(rank + OVERSAMPLE, width)
    basis = np.random.default_rng(11).standard_normal((width, thin))

    def gram(block: np.ndarray):
        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, thin))
            for rows in batches:
                for at in range(0, len(rows), 256):
                    a = _tf_idf(rows["text"].iloc[at:at + 256], idf, column)
                    total += a.T @ (a @ block)
            some = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"row": some, "v": list(total[some])})

        return multiply

    for _ in range(POWER_ROUNDS + 1):
        basis, _ = np.linalg.qr(basis)
        parts = items.select("text").mapInPandas(gram(basis), "row long, v array<double>")
        sums = parts.groupBy("row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(thin)]).alias("v")).toPandas()
        basis = np.zeros((width, thin))
        if len(sums):
            basis[sums["row"].to_numpy(int)] = np.stack(sums["v"].to_list())
    u, _, _ = np.linalg.svd(basis, full_matrices=False)
    return u[:, :rank]


def places_of(words: np.ndarray) -> dict[int, int]:
    """For every word one bit per place where it stands."""
    masks: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def common_words(a: np.ndarray, b: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, with one bit per word of a."""
    masks = places_of(a) if masks is None else masks
    full = (1 << len(a)) - 1
    v = full
    for word in b.tolist():
        m = masks.get(word)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def mark_of(slots: list[int]) -> int:
    mark = 0
    for slot in slots:
        mark |= 1 << slot
    return mark


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


class Index:
    """The benchmark's passages in the latent space, small enough to be sent to every task."""

    def __init__(self, items: list[Item], idf: np.ndarray, column: np.ndarray, space: np.ndarray, min_cosine: float):
        self.items, self.min_cosine = items, min_cosine
        self.places = [places_of(x.words) for x in items]
        known = np.flatnonzero(column >= 0)
        self.slot = np.full(BUCKETS, len(known), np.int32)
        self.slot[known] = np.arange(len(known))
        vectors = space[column[known]] * idf[known][:, None]
        self.vectors = np.concatenate([vectors, np.zeros((1, space.shape[1]))]).astype(np.float32)
        q = np.stack([self.vectors[self.slot[(x.words & np.uint64(BUCKETS - 1)).astype(np.int64)]].sum(axis=0) for x in items])
        self.queries = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        # For every passage one bit per bucket that its words fall in.
        self.marks = [mark_of(np.unique(self.slot[(x.words & np.uint64(BUCKETS - 1)).astype(np.int64)]).tolist()) for x in items]

    def leaks(self, row: np.ndarray, words: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        """(row, item, cosine, share in common, answer found) of the leaks among the words of some rows."""
        if not len(words):
            return []
        first = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(np.append(first, len(row)))
        blocks = -(-size // BLOCK_WORDS)
        of = np.repeat(np.arange(len(first)), blocks)
        within = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[of] + within * BLOCK_WORDS
        slots = self.slot[(words & np.uint64(BUCKETS - 1)).astype(np.int64)]
        # Only the passages' own words have a place in the latent space.
        known = np.flatnonzero(slots < len(self.vectors) - 1)
        block = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(words))))[known]
        window = np.zeros((len(start), self.vectors.shape[1]), np.float32)
        for at in range(0, len(known), 1 << 15):  # keeps few words' vectors in memory
            some = slice(at, at + (1 << 15))
            head = np.flatnonzero(np.diff(block[some], prepend=-1))
            window[block[some][head]] += np.add.reduceat(self.vectors[slots[known[some]]], head, axis=0)
        same = of[1:] == of[:-1]
        window[:-1][same] += window[1:][same]
        norm = np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
        rows, items, begins, cosines = [], [], [], []
        for at in range(0, len(start), 8192):
            cosine = (window[at:at + 8192] / norm[at:at + 8192]) @ self.queries.T
            i, k = np.nonzero(cosine >= self.min_cosine)
            rows.append(of[at + i]), items.append(k), begins.append(start[at + i]), cosines.append(cosine[i, k])
        rows, items, begins, cosines = (np.concatenate(x) for x in (rows, items, begins, cosines))
        order = np.lexsort((begins, items, rows))
        rows, items, begins, cosines = rows[order], items[order], begins[order], cosines[order]
        groups = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(items, prepend=-1) != 0)).tolist()
        first_block, edge, known_slots = np.cumsum(blocks) - blocks, np.searchsorted(block, np.arange(len(start) + 1)).tolist(), slots[known].tolist()
        marks: list[int | None] = [None] * len(start)

        out = []
        for g, end in zip(groups, [*groups[1:], len(rows)]):
            r, k, places = int(rows[g]), int(items[g]), begins[g:end].tolist()
            item, low, high = self.items[k], int(first[r]), int(first[r] + size[r])
            block_of, wanted = int(first_block[r]), self.marks[k]
            margin, found, places_in = len(item.words), (0.0, False), self.places[k]
            # Every word of the passage that a text lacks shortens the subsequence by one at least.
            may_lack = int((1 - min(MIN_COMMON, MIN_COMMON_WITH_ANSWER)) * margin + 1e-9)
            needed = len(places_in) - may_lack
            spans: list[list[int]] = []
            for p in places:
                a, b = max(low, p - margin), min(high, p + 2 * BLOCK_WORDS + margin)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                # Spans are taken in steps of the passage's length, so that distant words don't add up.
                width = 2 * margin + 2 * BLOCK_WORDS
                for p in range(a, max(a + 1, b - width + margin), max(1, margin)):
                    last = min(b, p + width)
                    lacks = wanted
                    for at in range(block_of + (p - low) // BLOCK_WORDS, block_of + (last - 1 - low) // BLOCK_WORDS + 1):
                        mark = marks[at]
                        if mark is None:
                            mark = marks[at] = mark_of(known_slots[edge[at]:edge[at + 1]])
                        lacks &= ~mark
                    if lacks.bit_count() > may_lack:
                        continue  # the blocks around lack too many of the passage's buckets already
                    text = words[p:last]
                    if len(places_in.keys() & text.tolist()) < needed:
                        continue
                    share = common_words(item.words, text, places_in) / len(item.words)
                    if share < MIN_COMMON_WITH_ANSWER or (share, True) <= found:
                        continue
                    # Every place decides for itself; the best one that is a leak is kept.
                    answer = common_words(item.answer, text) == len(item.answer)
                    if share >= MIN_COMMON or answer:
                        found = max(found, (share, answer))
            if found[0]:
                out.append((int(row[first[r]]), item.item_id, float(cosines[g:end].max()), found[0], found[1]))
        return out


_LEAK = "doc_id long, item_id long, cosine double, common double, answer_found boolean"


def _search(index: Index):
    names = ["doc_id", "item_id", "cosine", "common", "answer_found"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            out: list[tuple] = []
            for a, b in slices(offsets):
                row, words = hashed_words(data, offsets[a:b + 1])
                out += [(int(ids[a + r]), *rest) for r, *rest in index.leaks(row, words)]
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, rank: int = RANK) -> DataFrame:
    """One row per document and benchmark passage that it holds: doc_id, item_id, cosine, common, answer_found.

    `common` is the share of the passage's words in the longest common subsequence. A column `answer` of the benchmark is used where it exists and is not null;
    else a passage's last words stand for it. Null and empty texts hold nothing, passages without words are nowhere.
    Rows with a null id are left out, repeated rows count once, empty tables give an empty result, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = materialize(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.cast("string").alias("answer"))
        .where("item_id is not null and text is not null").withColumn("block", F.xxhash64("item_id"))
    )
    n = items.count()
    if not n:
        return docs.sparkSession.createDataFrame([], _LEAK)
    idf = inverse_frequency(rows)
    rounds, found = -(-n // ITEMS_AT_ONCE), None
    for k in range(rounds):
        part = items.where(F.pmod(F.col("block"), F.lit(rounds)) == k)
        held = []
        for r in part.drop("block").toPandas().itertuples():
            words, _ = words_and_buckets(r.text)
            reply = words_and_buckets(r.answer)[0] if isinstance(r.answer, str) else np.zeros(0, np.uint64)
            if len(words):
                held.append(Item(int(r.item_id), words, reply if len(reply) else words[-ANSWER_WORDS:]))
        if not held:
            continue
        buckets = np.unique(np.concatenate([x.words for x in held]) & np.uint64(BUCKETS - 1)).astype(np.int64)
        column = np.full(BUCKETS, -1)
        column[buckets] = np.arange(len(buckets))
        index = Index(held, idf, column, latent_space(part, idf, column, rank), min_cosine)
        hits = rows.mapInArrow(_search(index), _LEAK)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], _LEAK)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answer_found").alias("answer_found"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage; rows with a null id or text stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
