"""The quality model is fitted on every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import quality


def blocks_of(spark, x, label, size):
    rows = [(x[a:a + size].ravel().tolist(), label[a:a + size].tolist()) for a in range(0, len(x), size)]
    return spark.createDataFrame(rows, "features array<double>, label array<int>").repartition(3)


def test_every_labelled_row_takes_part(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("text %s of some words", "id").alias("text"))
    labels = docs.select("doc_id", (F.xxhash64("doc_id") % 2 == 0).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality, "BLOCK_ROWS", 500)
    monkeypatch.setattr(quality, "fit", lambda known, run=quality.fit: seen.append(known.selectExpr("count(*) b", "sum(size(label)) n").first()) or run(known))
    assert quality.score(docs, labels).count() == 3000
    assert seen[0].n == labels.where(~quality.held_out(F.col("doc_id"))).count() and seen[0].b > 3


def test_pairs_hold_every_row():
    draw = np.random.default_rng(3)
    for good, bad in [(5, 90), (90, 5), (40, 41), (1, 1), (7, 0)]:
        z = np.arange(good + bad, dtype=float)[:, None]
        label = np.array([1] * good + [0] * bad)
        at = draw.permutation(len(z))
        d = quality._differences(np.concatenate([z, z * 1000], axis=1)[at], label[at])
        assert len(d) == (min(quality.ROUNDS, good, bad) * max(good, bad))
    left = {int(x) for x in quality._differences(np.array([[1.0], [10.0], [100.0], [0.0]]), np.array([1, 1, 1, 0]))[:, 0]}
    assert left == {1, 10, 100}


def test_rank_is_found_from_counts(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(300, 1)), np.zeros((40, 1)), -np.abs(draw.normal(size=(50, 1))) * 1e-9])
    known, ordered = blocks_of(spark, x, np.ones(len(x), int), 64), np.sort(x[:, 0])
    for rank in (0, 150, 200, len(x) - 1):
        assert quality._at_rank(known, lambda v: v[:, 0], rank) == ordered[rank]
