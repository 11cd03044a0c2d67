"""Exact nearest-vector search between a question table and a chunk table.

Few questions go to the tasks that read the chunks. Else both sides are dealt over a grid of cells, one task each: a cell
holds a bounded part of the chunks and streams a part of the questions past it. Cells are about as many as the shuffle is
wide, so a row is copied about as often as the root of that, and what a task holds does not grow with the tables.
Products are taken block by block in single precision, which only rules pairs out; what is left is scored in double
precision, and only the best ``k`` per question leave a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from dossier.session import shuffle_width

#: Rows of questions and of chunks that meet in one product.
QUESTIONS_PER_TILE = 256
CHUNKS_PER_TILE = 8192
#: Bytes of single-precision vectors of the chunks that a cell holds.
CELL_BYTES = 16 << 20
#: Bytes of questions that go to all tasks.
BROADCAST_BYTES = 4 << 20
BROADCAST_ROWS = 500_000
SCORE_DIGITS = 12


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1), np.float32)


def _unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    return wide / np.where(norms == 0, 1, norms)[:, None]


def _ready(ids: pa.Array, matrix: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors; a vector with a component that is no number is near none."""
    good = np.isfinite(matrix).all(axis=1)
    return (ids, _unit(matrix)) if good.all() else (ids.take(pa.array(np.flatnonzero(good))), _unit(matrix[good]))


def _slack(dim: int) -> float:
    """More than single precision can err in a product of two unit vectors."""
    return (dim + 8) * 2.0**-23


def _exact(left: np.ndarray, right: np.ndarray, q_at: np.ndarray, c_at: np.ndarray) -> np.ndarray:
    step = max(1, (4 << 20) // (8 * left.shape[1]))
    parts = [np.einsum("ij,ij->i", left[q_at[a:a + step]], right[c_at[a:a + step]]) for a in range(0, len(q_at), step)]
    return np.round(np.concatenate(parts) if parts else np.zeros(0), SCORE_DIGITS)


def _tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Products of blocks in single precision, each with the places of its first question and chunk."""
    l32, r32 = left.astype(np.float32), right.astype(np.float32)
    for q in range(0, len(left), QUESTIONS_PER_TILE):
        for c in range(0, len(right), CHUNKS_PER_TILE):
            yield q, c, l32[q:q + QUESTIONS_PER_TILE] @ r32[c:c + CHUNKS_PER_TILE].T


def _cut(q_at: np.ndarray, c_at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each question, equal scores by place."""
    order = np.lexsort((c_at, -score, q_at))
    q_at, c_at, score = q_at[order], c_at[order], score[order]
    keep = np.arange(len(q_at)) - np.searchsorted(q_at, q_at, side="left") < k
    return q_at[keep], c_at[keep], score[keep]


def _kth(sims: np.ndarray, k: int) -> np.ndarray:
    """Of each row a value that at least ``k`` entries reach: the ``k``-th of the greatest of groups of columns."""
    width = sims.shape[1]
    if k == 1:
        return sims.max(axis=1)
    if width >= 32 * k:
        sims = sims[:, :width // 8 * 8].reshape(len(sims), 8, -1).max(axis=1)
    return np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]


def best_pairs(left: np.ndarray, right: np.ndarray, k: int, min_score: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of the best ``k`` rows of ``right`` for each row of ``left``; of equal scores the first rows."""
    slack = _slack(left.shape[1])
    least = -np.inf if min_score is None else min_score
    floor = np.full(len(left), least - slack)
    found: dict[int, list] = {}
    for q, c, sims in _tiles(left, right):
        low = floor[q:q + len(sims)]
        if sims.shape[1] >= k:
            np.maximum(low, _kth(sims, k) - 2 * slack, out=low)
        q_at, c_at = np.nonzero(sims >= low[:, None].astype(np.float32))
        q_at, c_at = q_at + q, c_at + c
        score = _exact(left, right, q_at, c_at)
        fit = score >= least
        found.setdefault(q, []).append(_cut(q_at[fit], c_at[fit], score[fit], k))
    cuts = [_cut(*(np.concatenate(x) for x in zip(*parts)), k) for parts in found.values()]
    none = np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*cuts)) if cuts else (none, none, np.zeros(0))


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs at or above the threshold, block by block."""
    slack = _slack(left.shape[1])
    for q, c, sims in _tiles(left, right):
        q_at, c_at = np.nonzero(sims >= np.float32(threshold - slack))
        sure = sims[q_at, c_at] >= threshold + slack
        q_at, c_at = q_at + q, c_at + c
        sure[~sure] = _exact(left, right, q_at[~sure], c_at[~sure]) >= threshold
        yield q_at[sure], c_at[sure]


# -- Cells ------------------------------------------------------------------

def meet(questions: DataFrame, chunks: DataFrame, cells: int) -> DataFrame:
    """Rows of both sides (``cell, id, vec``; a row stands once in each of its cells) with one task per cell, chunks first."""
    q_type, c_type = questions.schema["id"].dataType, chunks.schema["id"].dataType
    vec = F.col("vec").cast("array<float>").alias("vec")
    asked = questions.where("vec is not null").select("cell", F.lit(1).alias("side"), F.col("id").alias("q"), F.lit(None).cast(c_type).alias("c"), vec)
    known = chunks.where("vec is not null").select("cell", F.lit(0).alias("side"), F.lit(None).cast(q_type).alias("q"), F.col("id").alias("c"), vec)
    return asked.unionByName(known).repartitionById(cells, F.col("cell").cast("int")).sortWithinPartitions("side")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """Of a cell's rows each batch of questions with all chunks: ids and unit vectors, chunks in the order of their ids."""
    ids, parts, known = [], [], None
    for batch in batches:
        first = int(np.searchsorted(batch.column(1).to_numpy(), 1))
        chunks, asked = batch.slice(0, first), batch.slice(first)
        if len(chunks):
            ids.append(chunks.column(3))
            parts.append(_matrix(chunks.column(4)))
        if len(asked) and ids:
            known = known or in_order(ids, parts)
            yield *_ready(asked.column(2), _matrix(asked.column(4))), *known


def in_order(ids: list[pa.Array], parts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    ids, matrix = pa.concat_arrays(ids), np.concatenate(parts)
    order = pc.sort_indices(ids)
    return _ready(ids.take(order), matrix[order.to_numpy()])


def grid(questions: DataFrame, chunks: DataFrame, asked: int, known: int, dim: int) -> tuple[DataFrame, int]:
    """Every question with every chunk: rows ``id, vec`` of both sides in cells."""
    width = shuffle_width(chunks.sparkSession)
    even = math.sqrt(width * max(known, 1) / max(asked, 1))
    rows = max(1, min(width, round(even)), -(-known * dim * 4 // CELL_BYTES))
    columns = max(1, round(width / rows))

    def dealt(parts: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(parts))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.withColumn("column", dealt(columns)).withColumn("row", every(rows))
    right = chunks.withColumn("row", dealt(rows)).withColumn("column", every(columns))
    cell = F.col("row") * columns + F.col("column")
    return meet(left.withColumn("cell", cell), right.withColumn("cell", cell), rows * columns), rows * columns


def sided(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def _scored(q_type: S.DataType, c_type: S.DataType, qid: str, chunk_id: str) -> S.StructType:
    return S.StructType([S.StructField(qid, q_type), S.StructField(chunk_id, c_type), S.StructField("score", S.DoubleType())])


def score_cells(cells: DataFrame, k: int, qid: str, chunk_id: str, min_score: float | None = None) -> DataFrame:
    """Best ``k`` of each question within each cell."""
    out = _scored(cells.schema["q"].dataType, cells.schema["c"].dataType, qid, chunk_id)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, left, ids, right in met(batches):
            q_at, c_at, scores = best_pairs(left, right, k, min_score)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q_at)), ids.take(pa.array(c_at)), pa.array(scores)], names=out.fieldNames())

    return cells.mapInArrow(score, out)


def score_few(asked: pa.Table, q_type: S.DataType, chunks: DataFrame, k: int, qid: str, chunk_id: str, min_score: float | None) -> DataFrame:
    """Best ``k`` of a few questions within each part of the chunks that a task holds at once."""
    out = _scored(q_type, chunks.schema["id"].dataType, qid, chunk_id)
    qids, left = _ready(asked.column(0).combine_chunks(), _matrix(asked.column(1).combine_chunks()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def best() -> pa.RecordBatch:
            known, right = in_order(ids, parts)
            q_at, c_at, scores = best_pairs(left, right, k, min_score)
            return pa.RecordBatch.from_arrays([qids.take(pa.array(q_at)), known.take(pa.array(c_at)), pa.array(scores)], names=out.fieldNames())

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0))
                parts.append(_matrix(batch.column(1)))
            if sum(p.nbytes for p in parts) >= CELL_BYTES // 2:
                yield best()
                ids, parts = [], []
        if ids:
            yield best()

    return chunks.mapInArrow(score, out) if len(qids) else chunks.sparkSession.createDataFrame([], out)


def earlier_pairs(rows: DataFrame, threshold: float, seq: str = "seq", vec: str = "embedding", counted: bool = False) -> DataFrame:
    """Pairs of rows at or above the threshold, ``a`` before ``b`` by ``seq``; ``counted``: only ``b`` and its number of pairs.

    With ``counted`` a cell gives a number per row, so no pair is written.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
    side = sided(rows, seq, vec)
    cells, _ = grid(side, side, size["n"], size["n"], size["dim"] or 1)
    names = ["b", "n"] if counted else ["a", "b"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for late, left, early, right in met(batches):
            late, early = late.to_numpy(), early.to_numpy()
            n_of = np.zeros(len(late), np.int64)
            for b, a in near_pairs(left, right, threshold):
                before = early[a] < late[b]
                if counted:
                    n_of += np.bincount(b[before], minlength=len(late))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(early[a[before]], pa.int64()), pa.array(late[b[before]], pa.int64())], names)
            if counted:
                some = np.flatnonzero(n_of)
                yield pa.RecordBatch.from_arrays([pa.array(late[some], pa.int64()), pa.array(n_of[some], pa.int64())], names)

    found = cells.mapInArrow(near, f"{names[0]} long, {names[1]} long")
    return found.groupBy("b").agg(F.sum("n").alias("n")) if counted else found


def keep_top(scored: DataFrame, k: int, qid: str, chunk_id: str) -> DataFrame:
    order = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(chunk_id))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(questions: DataFrame, chunks: DataFrame, k: int, qid: str = "qid", qvec: str = "question_embedding",
          chunk_id: str = "chunk_id", vec: str = "embedding", min_score: float | None = None) -> DataFrame:
    """The ``k`` most similar chunks of every question: ``qid, chunk_id, score, rank``. Exact."""
    asked, known = sided(questions, qid, qvec), sided(chunks, chunk_id, vec)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = size["dim"] or 1
    if size["n"] * dim * 4 <= BROADCAST_BYTES:
        scored = score_few(asked.toArrow(), asked.schema["id"].dataType, known, k, qid, chunk_id, min_score)
    else:
        scored = score_cells(grid(asked, known, size["n"], known.count(), dim)[0], k, qid, chunk_id, min_score)
    return keep_top(scored, k, qid, chunk_id)


def attach(hits: DataFrame, chunks: DataFrame, rows_at_most: int, chunk_id: str = "chunk_id") -> DataFrame:
    """Join hits to chunk columns; with few enough hits the chunk table is read without a shuffle."""
    side = F.broadcast(hits) if rows_at_most <= BROADCAST_ROWS else hits
    return chunks.join(side, chunk_id)
