"""Searches hold a bounded part of the tables in a task, and compare equal cache entries once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.operators import cache
from dossier.operators import similarity as S
from tests.test_operators import brute, frame, vectors


def test_equal_cache_entries_are_compared_once(spark, monkeypatch):
    data = vectors(6, seed=31)
    rows = [(f"e{i:03}", data[i % 6].tolist()) for i in range(300)]
    later = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    entries = spark.createDataFrame(rows, "cache_id string, question_embedding array<float>").withColumn("expires_at", later)
    compared = []
    monkeypatch.setattr(cache.N, "top_k", lambda q, c, *a, run=S.top_k, **b: compared.append(c.count()) or run(q, c, *a, **b))
    asked = frame(spark, data, "qid", "question_embedding")
    hits = cache.lookup(asked, entries, F.expr("TIMESTAMP '2024-01-01 00:00:00'")).collect()
    assert compared == [6]
    assert {r.qid: r.cache_id for r in hits} == {i: f"e{i:03}" for i in range(6)}


def test_cells_copy_rows_by_the_root_of_their_number(spark, monkeypatch):
    """Before, every pair of tiles went through Python as a row of both tiles."""
    q, c = vectors(700, seed=32), vectors(900, seed=33)
    asked, known = S.sided(frame(spark, q, "id", "vec"), "id", "vec"), S.sided(frame(spark, c, "id", "vec"), "id", "vec")
    cells, n = S.grid(asked, known, 700, 900, 8)
    assert n == 4 and cells.count() == 2 * 700 + 2 * 900
    monkeypatch.setattr(S, "CELL_BYTES", 100 * 8 * 4)
    cells, n = S.grid(asked, known, 700, 900, 8)
    held = cells.where("side = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert n == 9 and held < 160


@pytest.mark.parametrize("k, least", [(1, None), (1, 0.5), (4, None), (400, 0.3), (5, -1.0)])
def test_blocks_find_the_best_of_all(monkeypatch, k, least):
    monkeypatch.setattr(S, "QUESTIONS_PER_TILE", 7)
    monkeypatch.setattr(S, "CHUNKS_PER_TILE", 150)
    q, c = vectors(40, seed=34), vectors(500, seed=35, copies=90)
    c[200] = 0
    q_at, c_at, score = S.best_pairs(S._unit(q), S._unit(c), k, least)
    sims = np.round(S._unit(q) @ S._unit(c).T, 12)
    for i in range(len(q)):
        best = [j for j in np.lexsort((np.arange(500), -sims[i]))[:k] if least is None or sims[i, j] >= least]
        assert c_at[q_at == i].tolist() == best and np.allclose(score[q_at == i], sims[i, best])
    pairs = {p for b, a in S.near_pairs(S._unit(q), S._unit(c), 0.4) for p in zip(b.tolist(), a.tolist())}
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(sims >= 0.4))))


def test_vectors_that_are_no_numbers_are_near_none(spark, monkeypatch):
    c = vectors(30, seed=36)
    c[4, 2] = np.nan
    want = {(r.qid, r.chunk_id, r.rank) for r in S.top_k(frame(spark, c[:3], "qid", "question_embedding"), frame(spark, np.delete(c, 4, 0), "n", "embedding")
                                                         .select((F.col("n") + F.when(F.col("n") > 3, 1).otherwise(0)).alias("chunk_id"), "embedding"), 3).collect()}
    for limit in (S.BROADCAST_BYTES, 0):
        monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
        got = S.top_k(frame(spark, c[:5], "qid", "question_embedding"), frame(spark, c, "chunk_id", "embedding"), 3).where("qid < 3 or qid = 4").collect()
        assert {(r.qid, r.chunk_id, r.rank) for r in got} == want
    assert S._matrix(pa.array([], pa.list_(pa.float32()))).shape[0] == 0
