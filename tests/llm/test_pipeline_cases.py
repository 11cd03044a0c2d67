"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, empty tables and other columns."""

import pytest

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long, label int, row long, shard int, kind string"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    english = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and n_chars between 300 and 3000").limit(12).collect()]
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    texts = [*english, None, "", " \n\t ", "a", english[0], english[0], f"{english[1]} {passage} {english[2]}", "Word " * 30_000, "x" * 40_000, "漢字 ß"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "Src", None, 1, 5, 2, "k") for i, t in enumerate(texts)] + [(None, english[3], "en", "Src", 1, 1, 5, 2, "k")]
    rows += [rows[2], rows[2]]
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage, "z"), (2, None, "z"), (None, "lost", "z"), (3, "", "z")], "item_id long, text string, row string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, i % 2, 0, "z") for i in range(12)] + [(None, 1, 1, "z"), (3, None, None, "z")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_columns_and_rows_of_their_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.select("doc_id", "text").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, folder))
        rows = key(out)
        assert out.columns == docs.columns and all(r in key(docs) for r in rows), name
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 18 not in kept["benchmark_leaks"] and {0, 1, 2, 12, 13, 19, 20} <= kept["benchmark_leaks"]
    assert not {16, 17} & kept["near_duplicates"] and {0, 1, 3} <= kept["near_duplicates"]
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(shards) == docs.count()


def test_stages_on_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and 18 not in {r["doc_id"] for r in out} and all(0 <= r["shard"] < 24 for r in out)
