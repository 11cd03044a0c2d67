"""Batch ingest: files to extracted documents, chunks, graph and artifacts."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import documents as D
from dossier.functions import vectors as V
from dossier.operators import chunking as C
from dossier.operators import extraction as X
from dossier.operators import graph_build as B
from dossier.session import materialize, materialize_counted
from dossier.sources import files
from dossier.sources.store import Store, derived_artifact, extracted_text

log = logging.getLogger(__name__)


@dataclass
class IngestReport:
    """Counters of one run; ``status`` is success, partial (some errors) or no_files.

    Unreadable files are rows of the output ``errors``; ``errors`` here names sinks that failed.
    """

    status: str
    repo_prefix: str
    files_processed: int = 0
    files_skipped: int = 0
    graph_node_count: int = 0
    graph_edge_count: int = 0
    signal_count: int = 0
    chunks_written: int = 0
    routing_summary: dict[str, int] = field(default_factory=dict)
    error_count: int = 0
    nodes_written: int = 0
    edges_written: int = 0
    errors: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


def analyzed_documents(texts: DataFrame, person: str = "Developer", path_identity: bool = False,
                       repeat_services: bool = True) -> DataFrame:
    """Readable files as documents with signals, statistics, type and owners.

    A document is named by its base name within its repository; with ``path_identity`` by
    its whole path, so that equal names in two folders stay two documents.
    """
    ready = texts.where(F.col("content").isNotNull()).select("source_key", "repo_prefix", "content")
    # Diagrams and manifests are typed by name; in other files the signals' services are those of the text.
    docs = D.analyze(X.extract(ready, repeat_services), signals=None)
    repo = F.element_at(F.split(F.rtrim("repo_prefix", F.lit("/")), "/"), -1)
    docs = B.with_owners(docs.withColumn("repo", F.when(repo == "", "unknown_repo").otherwise(repo)), F.lit(person), F.col("repo"))
    if path_identity:
        docs = docs.withColumn("source_file", F.col("source_key").substr(F.length("repo_prefix") + 1, F.length("source_key")))
    return docs


def last_of_name(docs: DataFrame) -> DataFrame:
    """Of documents sharing repository and name the one last in key order, whose chunks remain."""
    last = docs.groupBy("repo", "source_file").agg(F.max("source_key").alias("source_key"))
    return docs.join(last.select("source_key"), "source_key", "left_semi")


def chunk_rows(docs: DataFrame, embedder: V.Embedder) -> DataFrame:
    """Chunk-table rows of documents, embedded."""
    rows = last_of_name(docs).select(
        F.concat_ws("/", "repo", "source_file").alias("doc_id"), "source_file", "doc_type",
        F.col("chunking_strategy").alias("strategy"), "extracted_text",
    )
    chunks = C.chunk_documents(rows, strategy="strategy", keep=["doc_id", "source_file", "doc_type", "strategy"])
    return chunks.select(
        F.sha2(F.concat_ws("#", "doc_id", "chunk_index"), 256).alias("id"), "doc_id", "source_file", "doc_type",
        "strategy", F.col("chunk_index").cast("int").alias("chunk_index"), "content",
        V.embed(F.col("content"), embedder).alias("embedding"), "parent_content", "is_child",
        F.create_map().cast("map<string,string>").alias("metadata"), F.current_timestamp().alias("created_at"),
    )


def write_graph(store: Store, nodes: DataFrame, edges: DataFrame) -> tuple[int, int, list[str]]:
    """Merge nodes, then edges, into the store: numbers of both written, and errors.

    Edges whose ends are unknown are not written. An error raises only if no node was written.
    """
    written, errors = [0, 0], []
    try:
        fresh, seen = materialize_counted(nodes)
        store.replace("nodes", B.merge_nodes(store.read("nodes"), fresh))
        written[0] = seen["rows"]
    except Exception as problem:
        raise RuntimeError(f"no node was written: {problem}") from problem
    try:
        known = store.read("nodes")
        fresh, seen = materialize_counted(B.drop_dangling(edges, known))
        store.replace("edges", B.merge_edges(store.read("edges"), fresh, known))
        written[1] = seen["rows"]
    except Exception as problem:
        log.warning("edges were not written: %s", problem)
        errors.append(f"edges were not written: {problem}")
    return *written, errors


def summarise(repo_prefix: str, found: dict[str, int], counts: dict[str, int], written: tuple[int, int], routing: dict[str, int],
              errors: list[str]) -> IngestReport:
    """The run's report from the counts that were observed on its writes."""
    if not found["rows"]:
        return IngestReport("no_files", repo_prefix)
    problems = found["errors"] + len(errors)
    return IngestReport(
        "partial" if problems else "success", repo_prefix, counts["docs"], found["rows"] - counts["docs"], counts["nodes"], counts["edges"],
        counts["signals"], counts["chunks"], routing, problems, *written, errors,
    )


def write_repository_artifacts(store: Store, docs: DataFrame, signals: DataFrame, base: str, part: str = "") -> None:
    """For every repository of the run its own entities, edges, signals (strongest first) and counts, as partitions by ``repo_prefix``."""
    by = ["repo_prefix"]
    nodes, edges = B.repository_graphs(docs, signals)
    nodes, edges = materialize(nodes), materialize(edges)
    signals = signals.withColumn("repo_prefix", D.repo_prefix(F.col("source_key")))
    totals = materialize(B.aggregate_signals(signals, by))
    files_ = docs.select(D.repo_prefix(F.col("source_key")).alias("repo_prefix"))
    count = lambda rows, name: rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    manifest = count(files_, "files_processed")
    for rows, name in ((nodes, "graph_node_count"), (edges, "graph_edge_count"), (totals, "signal_count")):
        manifest = manifest.join(count(rows, name), by, "left")
    ordered = totals.sortWithinPartitions("repo_prefix", F.desc("strength"), "first_seen").drop("first_seen")
    for rows, name in ((nodes, "graph_entities"), (edges, "graph_edges"), (ordered, "expertise_signals"), (manifest.na.fill(0), "repository_manifests")):
        store.write_json(rows, f"{base}/{name}{part}", by)


def run(store: Store, texts: DataFrame, repo_prefix: str = "raw/", person: str = "Developer",
        embedder: V.Embedder | None = None, path_identity: bool = False, bucket: str = "",
        batch: int | None = None) -> IngestReport:
    """Ingest ``source_key, repo_prefix, content, error`` rows into the store.

    Documents are written out once, since chunks, graph and artifacts all read them. With
    ``batch`` the files of this run stand beside those of other batches, in a folder
    ``batch=N`` of each output; the same batch again replaces its own.
    """
    texts, found = materialize_counted(texts, errors=F.count("error"))
    if not found["rows"]:
        return summarise(repo_prefix, found, {}, (0, 0), {}, [])
    counts, errors, written = {}, [], (0, 0)
    docs, seen = materialize_counted(analyzed_documents(texts, person, path_identity))
    counts["docs"] = seen["rows"]
    nodes, edges = B.build_graph(docs)
    nodes, seen = materialize_counted(nodes)
    counts["nodes"] = seen["rows"]
    edges, seen = materialize_counted(edges)
    counts["edges"] = seen["rows"]
    if counts["docs"]:
        try:
            *written, errors = write_graph(store, nodes, edges)
        except RuntimeError as problem:
            log.warning("graph: %s", problem)
            errors = [str(problem)]
    chunks, seen = materialize_counted(chunk_rows(docs, embedder or V.HashingEmbedder()), kept=F.count("embedding"))
    counts["chunks"] = seen["kept"]
    store.write_chunks(chunks)
    signals, seen = materialize_counted(B.aggregate_signals(B.signal_table(docs)))
    counts["signals"] = seen["rows"]
    base = "derived/" + repo_prefix.removeprefix("raw/").strip("/")
    part = "" if batch is None else f"/batch={batch}"
    store.write_json(derived_artifact(docs, bucket), f"{base}/artifacts{part}", ["repo_prefix"])
    store.write_json(extracted_text(docs), f"{base}/extracted_text{part}")
    write_repository_artifacts(store, docs, B.signal_table(docs), base, part)
    failed = texts.where(F.col("error").isNotNull()).select("source_key", "error")
    store.write_json(failed, f"{base}/errors{part}")
    routing = {r["routing_key"]: r["files"] for r in D.routing_summary(docs).collect()}
    report = summarise(repo_prefix, found, counts, written, routing, errors)
    store.write_json(store.spark.createDataFrame([(report.status, _json(report))], "status string, manifest string"),
                     f"{base}/processing_manifest{part}")
    return report


def _json(report: IngestReport) -> str:
    return json.dumps(report.to_dict(), indent=2)


def run_folder(store: Store, root: str, repo_prefix: str = "raw/", **options) -> IngestReport:
    """Ingest every file below a folder, or one repository's folder."""
    objects = files.read_objects(store.spark, root, repo_prefix)
    return run(store, files.read_text(objects), repo_prefix, **options)
