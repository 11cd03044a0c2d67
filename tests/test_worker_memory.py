"""Python workers hand back results in parts, whatever size a batch has."""

import pandas as pd
from pyspark.sql import functions as F

from dossier.functions import vectors as V
from dossier.operators import extraction as X


def test_embedding_holds_few_texts(spark):
    import numpy as np

    class Counting:
        dim = 1

        def embed(self, texts):
            return np.full((len(texts), 1), float(len(texts)))

    text = F.when(F.col("id") % 7 == 0, F.lit(" ")).when(F.col("id") % 11 != 0, F.col("id").cast("string"))
    rows = spark.range(0, 3000, 1, 1).select("id", text.alias("t")).select("id", "t", V.embed(F.col("t"), Counting()).alias("v")).collect()
    assert len(rows) == 3000
    assert max(r.v[0] for r in rows if r.v) <= V.EMBED_ROWS
    assert all((r.v is None) == (r.t is None or r.t == " ") for r in rows)


def test_manifests_come_back_in_parts():
    content = pd.Series([f"name: r{i}" if i % 5 else None for i in range(300)])
    parts = list(X.read_yaml.func(iter([content, content.iloc[:0], content[:1]])))
    assert max(len(p) for p in parts) <= X.YAML_ROWS
    assert pd.concat(parts)["extracted_text"].tolist() == [*content.tolist(), content[0]]


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(V, "KNOWN_WORDS", 10)
    embedder = V.HashingEmbedder(64)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3, 50, 3)]
    vectors = embedder.embed(texts)
    assert len(embedder._bucket) <= 10 and (vectors[0] == vectors[2]).all()
