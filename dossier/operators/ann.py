"""Inverted-list index over vectors (k-means lists), with exact search on request.

Lists are found with Spark ML, each vector is assigned to its nearest centre, and a search
probes the lists nearest to each question. ``exact=True`` then also probes every list that
could still hold a better vector, by the triangle inequality on angles; nothing is missed.
A stored index keeps every list as a partition of its own, with centres and radii beside them, so a search reads
the partitions of the probed lists alone; new vectors are appended to their lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from dossier.operators import similarity as N
from dossier.session import materialize, shuffle_width


@dataclass
class ListIndex:
    """Centres (a small array: lists x dimensions), and the vectors with ``list_id, angle``."""

    centres: np.ndarray
    vectors: DataFrame
    chunk_id: str
    vec: str
    path: str | None = None

    @cached_property
    def stats(self) -> dict[int, tuple[int, float]]:
        """Per list (one small row each): its vectors, and the widest angle from its centre to one."""
        if self.path:
            rows = self.vectors.sparkSession.read.parquet(f"{self.path}/lists").groupBy("list_id").agg(F.sum("n").alias("n"), F.max("a").alias("a")).collect()
        else:
            rows = _list_stats(self.vectors).collect()
        return {r["list_id"]: (r["n"], r["a"]) for r in rows}


def _list_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a"))


def _angles(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    left = N._unit(np.stack(vectors.to_numpy()).astype(np.float32))
    return np.arccos(np.clip(left @ centres.T, -1.0, 1.0))


def nearest_list(vec: Column, centres: np.ndarray) -> Column:
    def assign(vectors: pd.Series) -> pd.DataFrame:
        angles = _angles(vectors, centres)
        best = angles.argmin(axis=1)
        return pd.DataFrame({"list_id": best.astype("int32"), "angle": angles[np.arange(len(best)), best]})

    kind = S.StructType([S.StructField("list_id", S.IntegerType()), S.StructField("angle", S.DoubleType())])
    return F.pandas_udf(assign, kind)(vec)


def build_index(chunks: DataFrame, lists: int = 100, chunk_id: str = "chunk_id", vec: str = "embedding",
                iterations: int = 5, seed: int = 7) -> ListIndex:
    """All vectors place the centres and all are indexed."""
    rows = chunks.where(F.col(vec).isNotNull())
    training = rows.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=lists, maxIter=iterations, seed=seed, distanceMeasure="cosine").fit(training)
    centres = N._unit(np.array(model.clusterCenters()))
    return ListIndex(centres, _assigned(rows, centres, vec), chunk_id, vec)


def _assigned(rows: DataFrame, centres: np.ndarray, vec: str) -> DataFrame:
    return rows.withColumn("a", nearest_list(F.col(vec), centres)).select(
        *rows.columns, F.col("a.list_id").alias("list_id"), F.col("a.angle").alias("angle")
    )


def _append(vectors: DataFrame, path: str) -> None:
    """Vectors to their lists' partitions, and what they add to the lists' sizes and radii; nothing stored is rewritten."""
    vectors = materialize(vectors)
    # Rebalancing gives a large list several files and small ones one each.
    vectors.hint("rebalance", F.col("list_id")).write.mode("append").partitionBy("list_id").parquet(f"{path}/vectors")
    _list_stats(vectors).coalesce(1).write.mode("append").parquet(f"{path}/lists")


def save_index(index: ListIndex, path: str) -> ListIndex:
    """Store an index in a new folder and return the stored one."""
    spark = index.vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centres)]
    head = spark.createDataFrame(rows, "list_id int, centre array<double>").withColumn("names", F.array(F.lit(index.chunk_id), F.lit(index.vec)))
    head.coalesce(1).write.parquet(f"{path}/centres")
    _append(index.vectors, path)
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> ListIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list_id").collect()
    chunk_id, vec = rows[0]["names"]
    vectors = spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors")
    return ListIndex(np.array([r["centre"] for r in rows]), vectors.withColumn("list_id", F.col("list_id").cast("int")), chunk_id, vec, path)


def add_vectors(spark: SparkSession, path: str, chunks: DataFrame) -> ListIndex:
    """Append new vectors to a stored index; its centres stay, so exact searches stay exact."""
    index = load_index(spark, path)
    _append(_assigned(chunks.where(F.col(index.vec).isNotNull()), index.centres, index.vec), path)
    return load_index(spark, path)


def listed(index: ListIndex, lists: list[int]) -> DataFrame:
    """The vectors of some lists; of a stored index only those partitions are read."""
    return index.vectors.where(F.col("list_id").isin(lists)) if lists else index.vectors.limit(0)


def _probe(questions: DataFrame, centres: np.ndarray, qid: str, qvec: str, choose: Callable,
           worst: str | None = None) -> DataFrame:
    """One row per question and list that ``choose(angles to the centres, worst kept score)`` names."""
    kind = S.ArrayType(S.IntegerType())

    def by_angle(vectors: pd.Series) -> pd.Series:
        return pd.Series([choose(a) for a in _angles(vectors, centres)])

    def by_angle_and_score(vectors: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([choose(a, s) for a, s in zip(_angles(vectors, centres), scores)])

    if worst is None:
        ids = F.pandas_udf(by_angle, kind)(qvec)
    else:
        ids = F.pandas_udf(by_angle_and_score, kind)(qvec, worst)
    rows = questions.select(qid, qvec, F.explode_outer(ids).alias("list_id"))
    return rows.where(F.col("list_id").isNotNull())


def _score_lists(probes: DataFrame, index: ListIndex, k: int, qid: str, qvec: str) -> DataFrame:
    """Score probed (question, list) pairs.

    A list is a row of cells (``similarity.meet``), a large one several, and its questions are dealt over the row's cells, so that a
    task holds a bounded part of one list.
    """
    width = shuffle_width(index.vectors.sparkSession)
    lists, dim = len(index.centres), index.centres.shape[1]
    per_cell = max(1, N.CELL_BYTES // (4 * dim))
    parts = {i: max(1, -(-n // per_cell)) for i, (n, _) in index.stats.items()}
    columns = max(1, round(width / max(1, sum(parts.values()))))
    first, rows = {}, 0
    for i in range(lists):
        first[i], rows = rows, rows + parts.get(i, 1)
    vectors = index.vectors
    if index.path:
        probes = materialize(probes)
        vectors = listed(index, [r["list_id"] for r in probes.select("list_id").distinct().collect()])  # one number a list at most
    start = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("list_id")]
    n_parts = F.create_map(*[F.lit(x) for i in range(lists) for x in (i, parts.get(i, 1))])[F.col("list_id")]

    def dealt(of: Column) -> Column:
        return F.pmod(F.xxhash64("id"), of)

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    known = vectors.select("list_id", F.col(index.chunk_id).alias("id"), F.col(index.vec).alias("vec"))
    known = known.withColumn("row", start + dealt(n_parts)).withColumn("column", every(F.lit(columns)))
    asked = probes.select("list_id", F.col(qid).alias("id"), F.col(qvec).alias("vec"))
    asked = asked.withColumn("part", every(n_parts)).withColumn("row", start + F.col("part")).withColumn("column", dealt(F.lit(columns)))
    cell = F.col("row") * columns + F.col("column")
    cells = N.meet(asked.withColumn("cell", cell), known.withColumn("cell", cell), rows * columns)
    return N.score_cells(cells, k, qid, index.chunk_id)


def search(questions: DataFrame, index: ListIndex, k: int, nprobe: int = 1, exact: bool = True,
           qid: str = "qid", qvec: str = "question_embedding") -> DataFrame:
    """The best ``k`` per question among the probed lists; among all vectors if ``exact``."""
    def nearest(angles: np.ndarray) -> list[int]:
        return np.argsort(angles)[:nprobe].astype("int32").tolist()

    first = _probe(questions, index.centres, qid, qvec, nearest)
    hits = N.keep_top(_score_lists(first, index, k, qid, qvec), k, qid, index.chunk_id)
    if not exact:
        return hits
    radius = np.array([index.stats.get(i, (0, -np.inf))[1] for i in range(len(index.centres))])

    def could_hold(angles: np.ndarray, worst: float | None) -> list[int]:
        limit = np.pi if worst is None or np.isnan(worst) else np.arccos(np.clip(worst, -1.0, 1.0))
        probed = set(np.argsort(angles)[:nprobe].tolist())
        reach = np.nonzero((angles - radius <= limit + 1e-9) & np.isfinite(radius))[0]
        return [int(i) for i in reach if int(i) not in probed]

    worst = hits.groupBy(qid).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst")
    )
    more = _probe(questions.join(worst, qid, "left"), index.centres, qid, qvec, could_hold, "worst")
    both = hits.drop("rank").unionByName(_score_lists(more, index, k, qid, qvec))
    return N.keep_top(both, k, qid, index.chunk_id)
