"""Graphs are folded in one pass, sorted by numbers, and their artifacts take little room."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import graph_build as B
from dossier.plans.catalog import graph as C
from dossier.sources.store import Store


def test_nodes_are_folded_in_one_pass(spark):
    seq = F.struct(F.col("key").alias("source_key"), F.lit(0).alias("step"), F.lit(0).alias("pos"))
    props = F.when(F.col("h").isNull(), F.create_map(F.lit("w"), F.col("w"))).otherwise(F.create_map(F.lit("w"), F.col("w"), F.lit("text_hash"), F.col("h")))
    rows = spark.createDataFrame([("n", "a", "1", "old"), ("n", "b", "2", "new"), ("n", "c", "3", None), ("m", "a", "4", None)],
                                 "node_id string, key string, w string, h string").select(
        "node_id", F.lit("Document").alias("node_type"), F.col("key").alias("label"), F.col("key").alias("source_file"),
        F.lit(0.5).alias("confidence"), props.alias("properties"), seq.alias("seq"))
    folded = B.fold_nodes(rows)
    got = {r.node_id: (r.label, round(r.confidence, 6), r.properties) for r in folded.collect()}
    assert got == {"n": ("a", 0.6, {"w": "3", "text_hash": "new"}), "m": ("a", 0.5, {"w": "4"})}
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "xxhash64" in plan


def test_artifacts_are_gzipped(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(2000).select(F.lit("raw/a/").alias("repo_prefix"), F.concat(F.lit("document_order_"), "id").alias("node_id"))
    store.write_json(rows, "nodes", ["repo_prefix"])
    files = [p for p in Path(tmp_path, "nodes").rglob("part-*") if p.is_file()]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    assert spark.read.schema("node_id string").json(f"{tmp_path}/nodes").distinct().count() == 2000


# -- Edges of documents ------------------------------------------------------

DOC_ROWS = [
    # source_key, source_file, weight, doc_type, chunking_strategy, repo_id
    ("raw/a/x.md", "x.md", 0.4, "code", "fixed_512", "repository_a"),
    ("raw/b/x.md", "x.md", 0.7, "narrative", "sentence", "repository_b"),  # the same id, another document
    ("raw/b/y.md", "y.md", 0.5, "code", "sentence", "repository_b"),
    ("raw/b/y.md", "y.md", 0.5, "code", "sentence", "repository_b"),  # comes twice
    (None, "z.md", 0.6, "code", "sentence", None),
    ("raw/b/_", None, 0.9, "code", "sentence", "repository_b"),  # no id
    ("raw/b/none.md", "none.md", 0.3, "code", "sentence", "repository_b"),  # no signals
]
SIGNAL_ROWS = [
    # document, signal_type, value, frequency, pos
    (0, "skill", "Go", 1, 1), (0, "pattern", "CQRS", 2, 2), (0, "skill", "go", 9, 3), (0, "pattern", "cqrs", 1, 4),
    (0, "technology", "Kafka", 1, 5), (0, "aws_service", "Amazon S3", 1, 6), (0, "other", "Z", 1, 7),
    (1, "technology", "Kafka", 2, 1), (1, "pattern", "CQRS", 1, 2), (1, "skill", "Go", 1, 3),
    (2, "aws_service", "Amazon S3", None, 1), (2, "technology", "kafka", 3, 2), (3, "aws_service", "Amazon S3", None, 1),
    (3, "technology", "kafka", 3, 2), (4, "technology", "Kafka", 1, 1), (4, "aws_service", "Amazon S3", 1, 2),
    (5, "technology", "Kafka", 2, 1), (5, "aws_service", "Amazon S3", 4, 2),
]
KINDS = {"skill": ("skill", "INDICATES_SKILL", "DEMONSTRATES_SKILL"), "technology": ("technology", "USES_TECH", "USES_TECH"),
         "aws_service": ("awsservice", "USES_AWS_SERVICE", "USES_AWS_SERVICE"),
         "pattern": ("pattern", "DEMONSTRATES_PATTERN", "DEMONSTRATES_PATTERN")}


def rule_by_rule():
    """Edges by the rules, one sighting after the other in plain Python: first weight and source, 0.1 for each more."""
    seen = []
    doc_ids = [name and "document_" + name.replace(".", "_") for _, name, *_ in DOC_ROWS]
    for (key, name, weight, kind, strategy, repo), doc in zip(DOC_ROWS, doc_ids, strict=True):
        seen += [((key, 0, 0), (repo, "CONTAINS", doc), weight, name), ((key, 3, 0), (doc, "HAS_TYPE", "documenttype_" + kind), 1.0, ""),
                 ((key, 3, 0), (doc, "CHUNKED_WITH", "chunkingstrategy_" + strategy), 1.0, "")]
    seen += [(("", 0, 0), ("person_dev", "BUILT", repo), 1.0, "") for repo in {row[5] for row in DOC_ROWS}]
    used = [(d, kind, f"{KINDS[kind][0]}_{value.lower().replace(' ', '_')}", n, pos) for d, kind, value, n, pos in SIGNAL_ROWS if kind in KINDS]
    for d, kind, node, n, pos in used:
        key, name, weight, *_, repo = DOC_ROWS[d]
        effective = min(1.0, weight * (1 + 0.1 * min(5 if n is None else n, 5)))
        seen.append(((key, 1, pos), (doc_ids[d], KINDS[kind][1], node), effective, name))
        seen.append(((key, 1, pos), ("person_dev" if kind in ("skill", "pattern") else repo, KINDS[kind][2], node), effective, name))
        for e, other, target, *_ in used:
            if DOC_ROWS[e][0] == key is not None and (kind, other) in (("skill", "pattern"), ("technology", "aws_service")):
                seen.append(((key, 2, pos), (node, "STRENGTHENS", target), 0.5, name))
    groups = {}
    for row in sorted(seen, key=lambda x: (x[0][0] is not None, x[0][0] or "", *x[0][1:])):
        groups.setdefault(row[1], []).append(row)
    return {edge: (round(min(1.0, rows[0][2] + 0.1 * (len(rows) - 1)), 6), rows[0][3]) for edge, rows in groups.items()}


def odd_documents(spark, placed):
    docs = spark.createDataFrame([(i, *row, "Dev", "person_dev", "text", 1.0, (0, 0.0, 0.0)) for i, row in enumerate(DOC_ROWS)],
                                 "i int, source_key string, source_file string, weight double, doc_type string, chunking_strategy string, repo_id string,"
                                 " person string, person_id string, extracted_text string, type_confidence double,"
                                 " text_stats struct<heading_count:int,code_char_ratio:double,avg_sentence_len:double>").withColumn("file_type", F.lit("text"))
    signals = spark.createDataFrame(SIGNAL_ROWS, "i int, signal_type string, value string, frequency int, pos int").join(
        docs.select("i", "source_key", "source_file", "weight", "repo_id", "person_id"), "i")
    if placed:
        doc_id = T.stable_id("document", F.col("source_file"))
        docs, signals = (x.withColumn("doc_id", doc_id).withColumn("doc_hash", F.xxhash64("doc_id")).repartition("doc_hash") for x in (docs, signals))
    return docs.drop("i"), signals.drop("i")


@pytest.mark.parametrize("placed", [False, True])
def test_edges_follow_the_rules_on_odd_rows(spark, placed):
    rows = B.build_graph(*odd_documents(spark, placed))[1].collect()
    got = {(r.from_id, r.relationship, r.to_id): (round(r.weight, 6), r.source_file) for r in rows}
    assert len(rows) == len(got) and got == rule_by_rule()


def test_edges_of_placed_documents_stay_where_they_are(spark):
    """Only what documents share is sent: owners' pairs, and the edges folded from all documents."""
    plan = B.build_graph(*odd_documents(spark, True))[1]._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line and "(i#" not in line]
    assert len(sent) == 2 and sum("to_id" in line for line in sent) == 1


def test_placed_orders_are_the_orders(spark, tmp_path):
    """Documents and signals that are dealt out by document are those of the SQL, with orders and parts that come twice or are missing."""
    tables = {
        "customer": [(1, "A B"), (2, None), (2, "C")], "orders": [(1, 1, "F", "x"), (1, 2, "O", "y"), (-5, 2, "P", None), (5, 1, None, "z"), (None, 1, "F", "x"), (7, 9, "F", "x")],
        "part": [(k, f"part {k}") for k in (0, 1, 2, 3, 4, 8)] + [(1, "part 1"), (None, "none")],
        "lineitem": [(o, p, 1, n, n and float(n), 10.0 * p) for o in (1, -5, 5, 7, 8, None) for n, p in ((1, 1), (1, 0), (2, 8), (3, 3), (4, 77), (6, 4), (None, 2))] + [(1, None, 1, 9, 1.0, 1.0)],
    }
    columns = {"customer": "c_custkey long, c_mktsegment string", "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
               "part": "p_partkey long, p_name string",
               "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, columns[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, signals = C.placed_orders(spark, str(tmp_path))
    for placed, plain in ((docs, C.order_docs(spark, str(tmp_path))), (signals, C.order_signals(spark, str(tmp_path)))):
        want = plain.collect()
        assert want and Counter(map(repr, placed.select(*plain.columns).collect())) == Counter(map(repr, want))
        assert placed.where(~F.col("doc_hash").eqNullSafe(F.xxhash64(T.stable_id("document", F.col("source_file"))))).count() == 0
