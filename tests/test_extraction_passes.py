"""Extraction reads a text once per pattern, and read-back queries move digests, not texts."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.functions import documents as D
from dossier.functions import text as T
from dossier.functions import vectors as V
from dossier.operators import extraction as X
from dossier.plans import ingest
from dossier.plans.catalog import sinks
from dossier.plans.catalog.base import corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("extract, pattern", [
    (X.extract_markdown, "(?s)<!--"), (X.extract_markdown, "^#{1,4}"), (X.extract_plain, "{3,}"),
])
def test_a_text_is_cleaned_once(spark, extract, pattern):
    rows = spark.range(1).select(F.col("id").cast("string").alias("c"), F.lit("a.md").alias("n"))
    assert plan(rows.select(extract(F.col("c"), F.col("n"), F.lit(1.0)).alias("e"))).count(pattern) <= 1


def test_arrows_are_found_as_by_three_passes(spark):
    rng = random.Random(3)
    bits = ["a", "bc", " ", "\n", "\r", '"', "<", ">", ":", "--", "->", "-->", "<-", "..", "x y", " ", ": label", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    arrow = '(?dmU)(?:^|(?<=["<>]))' + X.ARROW
    old = [T.find_all(F.col("c"), arrow, g).alias(f"g{g}") for g in (1, 2, 3)]
    clean = lambda p: F.struct(X._unquote(p["g1"]).alias("a"), X._unquote(p["g2"]).alias("b"), T.strip(p["g3"]).alias("l"))
    kept = F.filter(F.transform(F.arrays_zip(*old), clean), lambda p: (F.length(p["a"]) > 1) & (F.length(p["b"]) > 1))
    want = F.transform(kept, lambda p: F.concat(p["a"], F.lit(" → "), p["b"], F.when(p["l"] != "", F.concat(F.lit(" ["), p["l"], F.lit("]"))).otherwise("")))
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    found = rows.select(X.diagram_relations(F.col("c")).alias("got"), want.alias("want"), "c").collect()
    assert all(r.got == r.want for r in found) and sum(len(r.got) for r in found) > 300
    one = rows.select(X.diagram_relations(F.col("c")).alias("e"))
    assert plan(one).count("regexp_extract_all") == 1


def first_join(node):
    if node.nodeName() == "Join":
        return node
    below = node.children()
    return next(filter(None, (first_join(below.apply(i)) for i in range(below.size()))), None)


@pytest.mark.parametrize("run, text", [(sinks.extracted_text, "value"), (sinks.json_artifacts, "extracted_text")])
def test_texts_are_not_joined(spark, run, text):
    sides = first_join(run(spark, SF)._jdf.queryExecution().optimizedPlan()).children()
    for side in (sides.apply(0), sides.apply(1)):
        names = [side.output().apply(i).name() for i in range(side.output().size())]
        assert text not in names and "sha2(" in side.toString()


def test_chunks_need_no_signals(spark):
    docs = corpus(spark, SF).withColumn("repo_prefix", D.repo_prefix(F.col("source_key")))
    chunks = ingest.chunk_rows(ingest.analyzed_documents(docs), V.HashingEmbedder(16))
    text = plan(chunks.select("doc_id", "content", "embedding"))
    assert not [unread for unread in ("TypeScript", "Text file ", "avg_sentence_len", "avg_line_len") if unread in text]


def test_fields_and_types_are_those_of_whole_extractions(spark):
    docs = corpus(spark, SF).withColumn("repo_prefix", D.repo_prefix(F.col("source_key")))
    heads = "# a\n## b\n### c\nAmazon S3 and AWS Lambda. Amazon S3!"
    odd = [("raw/r/" + n, "raw/r/", c) for n in ("a.md", "b.txt", "c.puml", "d.yaml", "e.py", "f.pdf", "g.rst") for c in (heads, "", "@startuml\nA -> B : x\n", None)]
    files = docs.select("source_key", "repo_prefix", "content").unionByName(spark.createDataFrame(odd, "source_key string, repo_prefix string, content string"))
    content, name, weight = F.col("content"), F.col("source_file"), F.col("weight")
    named = files.withColumn("source_file", D.file_name(F.col("source_key"))).withColumn("weight", D.ingest_weight(name))
    kind = D.extractor_kind(name)
    whole = {"markdown": X.extract_markdown(content, name, weight), "plantuml": X.extract_plantuml(content, name, weight),
             "text": X.extract_plain(content, name, weight)}
    shown = lambda rows: sorted(map(repr, rows.select("source_key", *X.FIELDS).collect()))
    got = X.extract(files)
    for k, e in whole.items():
        want = named.where(kind == k).withColumn("e", e).select("source_key", "e.*")
        assert shown(got.where(kind == k)) == shown(want)
    types = lambda **more: sorted(map(tuple, D.analyze(got, **more).select("source_key", "doc_type", "extracted_text").collect()), key=repr)
    assert types(signals=None) == types() and {"technical_spec", "diagram_derived", "structured_data"} <= {t[1] for t in types()}
