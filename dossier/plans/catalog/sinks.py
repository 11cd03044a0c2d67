"""Queries that write to the shared folder and read back, and run counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions import documents as D
from dossier.operators import extraction as X
from dossier.operators import graph_build as B
from dossier.plans import ingest
from dossier.plans.catalog.base import CORPUS_CTE, corpus, plain, portable, query, sql_strip
from dossier.plans.catalog.graph import (
    EDGE_ROWS, FACTS_CTE, NEW_CHUNKS, NEW_EDGES, NEW_NODES, NODE_ROWS, OLD_NODES, fresh_nodes, stored_nodes, with_edge_id,
    written_orders,
)
from dossier.plans.catalog.text import KIND, MD_CTE, sql_squeeze
from dossier.session import checkpoint_dir, materialize, materialize_counted
from dossier.sources import files, store


def scratch(spark):
    """A new folder of the store, in the shared folder."""
    return store.Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/sinks/{uuid.uuid4().hex}")


@query("o02_read_text", f"""
WITH {CORPUS_CTE} SELECT count(*) AS records, CAST(sum(length(content)) AS BIGINT) AS chars FROM corpus
""")
def read_text(spark, sf_dir):
    """Files written from the corpus, read back as objects and decoded."""
    target = scratch(spark)
    rows = corpus(spark, sf_dir).select("repo", F.to_json(F.struct("source_key", "content")).alias("value"))
    rows.write.partitionBy("repo").text(f"{target.root}/raw")
    objects = files.read_text(files.read_objects(spark, target.root, "raw/", glob="*.txt"))
    lines = objects.select(F.explode(F.split("content", "\n")).alias("line")).where(F.col("line") != "")
    read = lines.select(F.from_json("line", "source_key string, content string").alias("r"))
    return read.agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("r.content")).cast("bigint").alias("chars"))


def extracted_documents(spark, sf_dir):
    rows = X.extract(corpus(spark, sf_dir).withColumn("repo_prefix", D.repo_prefix(F.col("source_key"))))
    return materialize(rows)


# Texts of diagrams and manifests are stated by o35, o36 and o32 to o34; here they must come back as they were extracted.
EXTRACTED = f"""WITH {MD_CTE}, lines AS (
  SELECT *, regexp_extract_all(content, '(?m)^#{{1,4}}\\s+(.+)$', 1)[1:5] AS h,
    list_filter(list_transform(string_split(cleaned, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS line FROM md
), t AS (SELECT *, {sql_squeeze('content')} AS t FROM corpus WHERE {KIND} = 'text'),
d AS (
  SELECT source_key, cleaned AS t, concat_ws(' | ', 'File: ' || source_file, 'Sections: ' || array_to_string(h, ', '),
    {sql_strip("regexp_replace(line, '[ ' || chr(9) || ']+', ' ', 'g')")}) AS summary FROM lines
  UNION ALL SELECT source_key, t, 'Text file ' || source_file || ': ' || substr(string_split(t, chr(10))[1], 1, 200) FROM t
  UNION ALL SELECT source_key, NULL, NULL FROM corpus WHERE {KIND} IN ('plantuml', 'yaml'))"""


def stated(kind, text):
    """The digest of texts that the SQL states; the others are compared with what was written."""
    return F.when(kind.isin("text", "markdown"), F.md5(text.cast("binary")))


def whole(text):
    """What two equal texts share, so that texts need not move to be compared."""
    return F.sha2(text.cast("binary"), 256)


@query("o12_json_artifacts", f"{EXTRACTED} SELECT source_key, '1.0' AS schema_version, md5(t) AS text_md5, TRUE AS as_extracted FROM d")
def json_artifacts(spark, sf_dir):
    target, docs = scratch(spark), extracted_documents(spark, sf_dir)
    target.write_json(store.derived_artifact(docs), "artifacts", ["repo_prefix"])
    back = spark.read.schema("schema_version string, source_key string, extracted_text string").json(f"{target.root}/artifacts")
    text = F.col("extracted_text")
    was = docs.select("source_key", whole(text).alias("was"))
    kind = D.extractor_kind(D.file_name(F.col("source_key")))
    now = back.select("source_key", "schema_version", stated(kind, text).alias("text_md5"), whole(text).alias("now"))
    return now.join(was, "source_key").select("source_key", "schema_version", "text_md5", F.col("now").eqNullSafe(F.col("was")).alias("as_extracted"))


@query("o13_extracted_text", f"""
{EXTRACTED} SELECT 'derived/' || substr(source_key, 5) || '.extracted.txt' AS text_key, md5(summary || chr(10) || chr(10) || t) AS value_md5,
  TRUE AS as_extracted FROM d
""")
def extracted_text(spark, sf_dir):
    target, docs = scratch(spark), extracted_documents(spark, sf_dir)
    rows = store.extracted_text(docs)
    target.write_json(rows, "extracted_text")
    back = spark.read.schema("text_key string, value string").json(f"{target.root}/extracted_text")
    was = rows.select("text_key", whole(F.col("value")).alias("was"))
    kind = D.extractor_kind(F.regexp_extract("text_key", r"([^/]+)\.extracted\.txt$", 1))
    now = back.select("text_key", stated(kind, F.col("value")).alias("value_md5"), whole(F.col("value")).alias("now"))
    return now.join(was, "text_key").select("text_key", "value_md5", F.col("now").eqNullSafe(F.col("was")).alias("as_extracted"))


@query("o14_repository_artifacts", f"""
WITH {FACTS_CTE}, {EDGE_ROWS}, {NODE_ROWS},
e AS (SELECT split_part(source_key, '/', 2) AS repo, from_id || relationship || to_id AS id FROM (SELECT * FROM fan UNION ALL SELECT * FROM strong UNION ALL SELECT * FROM routed)
  UNION ALL SELECT repo, 'document' || source_file FROM docs UNION ALL SELECT DISTINCT repo, 'built' FROM docs),
n AS (SELECT split_part(source_key, '/', 2) AS repo, node_id AS id FROM (SELECT source_key, node_id FROM nrows UNION ALL SELECT source_key, node_id FROM rrows)
  UNION ALL SELECT DISTINCT repo, unnest(['person', 'repository']) FROM docs),
files AS (SELECT repo, count(*) AS files_processed FROM docs GROUP BY 1), edge AS (SELECT repo, count(DISTINCT id) AS graph_edge_count FROM e GROUP BY 1),
node AS (SELECT repo, count(DISTINCT id) AS graph_node_count FROM n GROUP BY 1),
best AS (SELECT repo, signal_type || ':' || value AS strongest, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) OVER (PARTITION BY repo) AS signal_count
  FROM sig GROUP BY repo, signal_type, value QUALIFY row_number() OVER (PARTITION BY repo ORDER BY sum(frequency) DESC, signal_type, value) = 1)
SELECT repo, files_processed, graph_node_count, graph_edge_count, signal_count, strongest, frequency
FROM files JOIN edge USING (repo) JOIN node USING (repo) JOIN best USING (repo)
""")
def repository_artifacts(spark, sf_dir):
    """All four artifacts of every repository are written, read back and counted; the manifest must give the same counts."""
    target = scratch(spark)
    docs, signals = written_orders(spark, sf_dir)
    ingest.write_repository_artifacts(target, docs, signals, "derived")
    read = lambda kind, name: spark.read.schema(f"{kind}, repo_prefix string").json(f"{target.root}/derived/{name}")
    count = lambda rows, name: rows.groupBy("repo_prefix").agg(F.count(F.lit(1)).alias(name))
    totals = read("signal_type string, value string, frequency long", "expertise_signals")
    order = F.struct(-F.col("frequency"), "signal_type", "value")
    best = totals.groupBy("repo_prefix").agg(F.count(F.lit(1)).alias("signals"), F.min(order).alias("b"))
    found = count(read("node_id string", "graph_entities"), "nodes").join(count(read("edge_id string", "graph_edges"), "edges"), "repo_prefix").join(best, "repo_prefix")
    counts = "files_processed long, graph_node_count long, graph_edge_count long, signal_count long"
    same = (F.col("nodes") == F.col("graph_node_count")) & (F.col("edges") == F.col("graph_edge_count")) & (F.col("signals") == F.col("signal_count"))
    return read(counts, "repository_manifests").join(found, "repo_prefix").where(same).select(
        F.element_at(F.split("repo_prefix", "/"), 2).alias("repo"), "files_processed", "graph_node_count", "graph_edge_count", "signal_count",
        F.concat_ws(":", "b.signal_type", "b.value").alias("strongest"), (-F.col("b.col1")).alias("frequency"),
    )


@query("o18_write_counts", f"""
WITH known AS (SELECT node_id FROM ({plain(OLD_NODES)}) UNION SELECT node_id FROM ({plain(NEW_NODES)})),
n AS (SELECT * FROM ({plain(NEW_EDGES)}) e WHERE from_id IN (SELECT node_id FROM known) AND to_id IN (SELECT node_id FROM known))
SELECT (SELECT count(*) FROM ({plain(NEW_NODES)})) AS nodes_written, (SELECT count(*) FROM n) AS edges_written,
  (SELECT count(*) FROM known) AS nodes_stored, 0::BIGINT AS errors
""")
def write_counts(spark, sf_dir):
    """Counts observed on a store's own merge of nodes and edges."""
    target, old = scratch(spark), stored_nodes(spark, sf_dir)
    target.replace("nodes", old.select(*target.read("nodes").columns))
    new = with_edge_id(portable(spark, sf_dir, NEW_EDGES))
    nodes, edges, errors = ingest.write_graph(target, fresh_nodes(spark, sf_dir).select(*old.columns), new)
    counted = target.read("nodes").agg(F.count(F.lit(1)).alias("nodes_stored"))
    return counted.select(F.lit(nodes).cast("long").alias("nodes_written"), F.lit(edges).cast("long").alias("edges_written"), "nodes_stored",
                          F.lit(len(errors)).cast("long").alias("errors"))


@query("o64_manifest_counters", f"""
WITH {FACTS_CTE}, {EDGE_ROWS}, {NODE_ROWS}, every AS (SELECT * FROM fan UNION ALL SELECT * FROM strong UNION ALL SELECT * FROM own UNION ALL SELECT * FROM routed)
SELECT 'partial' AS status, (SELECT count(*) FROM docs) AS files_processed, (SELECT count(*) FROM nation) AS files_skipped,
  (SELECT count(DISTINCT node_id) FROM (SELECT node_id FROM nrows UNION ALL SELECT node_id FROM rrows)) + 1
    + (SELECT count(DISTINCT lower(repo)) FROM docs) AS graph_node_count,
  (SELECT count(DISTINCT (from_id, relationship, to_id)) FROM every) AS graph_edge_count,
  (SELECT count(DISTINCT (signal_type, value)) FROM sig) AS signal_count, (SELECT count(*) FROM ({plain(NEW_CHUNKS)}) WHERE e IS NOT NULL) AS chunks_written,
  (SELECT count(*) FROM nation) AS error_count, (SELECT count(DISTINCT (doc_type, chunking_strategy)) FROM docs) AS routes
""")
def manifest_counters(spark, sf_dir):
    """Orders are read files, nations files that could not be read; all numbers are observed while tables are written."""
    docs, signals = written_orders(spark, sf_dir)
    failed = portable(spark, sf_dir, "SELECT n_name AS source_key, 'unreadable' AS error FROM {nation}")
    texts = docs.select("source_key", F.lit(None).cast("string").alias("error")).unionByName(failed)
    nodes, edges = B.build_graph(docs, signals)
    chunks = portable(spark, sf_dir, NEW_CHUNKS)
    found = materialize_counted(texts, errors=F.count("error"))[1]
    counts = {name: materialize_counted(rows, kept=F.count(kept))[1]["kept"] for name, rows, kept in [
        ("docs", docs.select("source_key"), "source_key"), ("nodes", nodes.select("node_id"), "node_id"), ("edges", edges.select("edge_id"), "edge_id"),
        ("signals", B.aggregate_signals(signals).select("value"), "value"), ("chunks", chunks.select("e"), "e"),
    ]}
    routes = {r["doc_type"]: r["n"] for r in docs.groupBy("doc_type", "chunking_strategy").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = ingest.summarise("raw/", found, counts, (0, 0), routes, [])
    names = ["files_processed", "files_skipped", "graph_node_count", "graph_edge_count", "signal_count", "chunks_written", "error_count"]
    row = (report.status, *[getattr(report, n) for n in names], len(report.routing_summary))
    return spark.createDataFrame([row], "status string, " + ", ".join(f"{n} long" for n in [*names, "routes"]))
