"""Stored tables and sinks on any file system Spark can write to.

A table is a folder of parquet versions and a small pointer file naming the current one.
A new version becomes visible when the pointer is replaced, so readers never see half a
write and a lost job leaves the old version in place. The chunk table is partitioned by a
hash of the document instead, and an upsert rewrites only the partitions it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import documents as D
from dossier.operators.cache import CACHE_TYPE
from dossier.operators.routing import WEIGHTS_TYPE
from dossier.session import cut_lineage, ship

CHUNKS_TYPE = (
    "id string, doc_id string, source_file string, doc_type string, strategy string, chunk_index int, content string, "
    "embedding array<float>, parent_content string, is_child boolean, metadata map<string,string>, created_at timestamp"
)
NODES_TYPE = (
    "node_id string, node_type string, label string, source_file string, confidence double, properties map<string,string>"
)
EDGES_TYPE = (
    "edge_id string, from_id string, to_id string, relationship string, weight double, source_file string"
)
TABLES = {"nodes": NODES_TYPE, "edges": EDGES_TYPE, "query_cache": CACHE_TYPE, "routing_weights": WEIGHTS_TYPE}
# Graph tables are read by kind, so each kind is a partition.
PARTITIONS = {"nodes": ["node_type"], "edges": ["relationship"]}
CHUNK_BUCKETS = 256


class Store:
    def __init__(self, spark: SparkSession, root: str, chunk_buckets: int = CHUNK_BUCKETS):
        ship(spark)
        self.spark, self.root, self.chunk_buckets = spark, root.rstrip("/"), chunk_buckets

    # -- versioned tables ---------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current"

    def _current(self, name: str) -> tuple[str | None, str]:
        """Version and tag the pointer names."""
        if not self.exists(self._pointer(name)):
            return None, ""
        fs, target = self._fs(self._pointer(name))
        stream = fs.open(target)
        try:
            version, tag = stream.readUTF().split("|", 1)
        finally:
            stream.close()
        return version, tag

    def tag(self, name: str) -> str:
        return self._current(name)[1]

    def has(self, name: str) -> bool:
        return self._current(name)[0] is not None

    def read(self, name: str) -> DataFrame:
        version = self._current(name)[0]
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{version}").select(*columns)

    def replace(self, name: str, rows: DataFrame, tag: str | None = None) -> None:
        """Make ``rows`` the current version; a tag is stored with the pointer, else the old tag stays.

        The version before the current one is kept for readers still on it; older ones go.
        """
        version, (previous, old_tag) = uuid.uuid4().hex, self._current(name)
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        by = PARTITIONS.get(name, [])
        kept = rows.select(*columns)
        (kept.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by) if by else kept.write).parquet(f"{self.root}/{name}/{version}")
        fs, target = self._fs(self._pointer(name))
        stream = fs.create(target, True)
        try:
            stream.writeUTF(f"{version}|{old_tag if tag is None else tag}")
        finally:
            stream.close()
        for status in self._fs(f"{self.root}/{name}")[0].listStatus(self._fs(f"{self.root}/{name}")[1]):
            if status.isDirectory() and status.getPath().getName() not in (version, previous):
                self.delete(f"{name}/{status.getPath().getName()}")

    # -- chunks -------------------------------------------------------------

    @property
    def chunks_path(self) -> str:
        return f"{self.root}/chunks"

    def chunks(self) -> DataFrame:
        if not self.exists(self.chunks_path):
            return self.spark.createDataFrame([], CHUNKS_TYPE)
        return self.spark.read.schema(f"{CHUNKS_TYPE}, bucket int").parquet(self.chunks_path).drop("bucket")

    def write_chunks(self, new: DataFrame) -> None:
        """Replace the chunks of every document present in ``new``; other documents stay."""
        columns = self.spark.createDataFrame([], CHUNKS_TYPE).columns
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.chunk_buckets)).cast("int")
        fresh = cut_lineage(new.select(*columns).withColumn("bucket", bucket))
        if self.exists(self.chunks_path):
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            if not touched:
                return
            stored = self.spark.read.schema(f"{CHUNKS_TYPE}, bucket int").parquet(self.chunks_path)
            stored = stored.where(F.col("bucket").isin(touched))
            fresh = cut_lineage(upsert_chunks(stored, fresh))
        # Rebalancing gives a large bucket several tasks and files, and small ones one each.
        (
            fresh.hint("rebalance", F.col("bucket")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.chunks_path)
        )

    def truncate_chunks(self) -> None:
        self.spark.createDataFrame([], f"{CHUNKS_TYPE}, bucket int").write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy("bucket").parquet(self.chunks_path)

    # -- artifacts ----------------------------------------------------------

    def write_json(self, rows: DataFrame, path: str, by: list[str] | None = None) -> None:
        """JSON lines, gzipped: ids of nodes and edges repeat each other, so the files take a small part of the room."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
        (writer.partitionBy(*by) if by else writer).json(f"{self.root}/{path}")

    # -- records of model calls ---------------------------------------------

    def append_calls(self, calls: DataFrame) -> None:
        """Add the metric items of model calls; nothing stored is read or rewritten."""
        metric_items(calls).withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").parquet(f"{self.root}/metrics")

    def call_items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/metrics").drop("day")

    def delete(self, path: str) -> bool:
        fs, target = self._fs(f"{self.root}/{path}")
        return fs.delete(target, True)


def upsert_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows of documents not written again, and the new rows that have an embedding.

    A document is keyed by (source_file, doc_id) and counts as written only if at least one
    of its new rows can be stored.
    """
    ready = new.where(F.col("embedding").isNotNull())
    keys = ready.select("source_file", "doc_id").distinct()
    return stored.join(keys, ["source_file", "doc_id"], "left_anti").unionByName(ready)


def extracted_text(docs: DataFrame) -> DataFrame:
    """The text record of each document under its derived key: summary, blank line, extracted text."""
    key = D.derived_key(F.col("repo_prefix"), F.col("source_key"), ".extracted.txt")
    return docs.select(key.alias("text_key"), F.concat("summary", F.lit("\n\n"), "extracted_text").alias("value"))


def derived_artifact(docs: DataFrame, bucket: str = "") -> DataFrame:
    """The per-file record, encoded once."""
    return docs.select(
        F.lit("1.0").alias("schema_version"), F.lit(bucket).alias("source_bucket"), "source_key", "repo_prefix",
        "file_type", "extracted_text", "summary", "expertise_signals",
        F.array().cast("array<string>").alias("graph_nodes"), F.array().cast("array<string>").alias("graph_edges"),
        F.map_concat("metadata", F.create_map(F.lit("source_weight"), F.col("weight").cast("string"))).alias("metadata"),
    )


# -- Model-call metrics -----------------------------------------------------

def _score(value: Column) -> Column:
    """Eight decimals, zero when absent."""
    return F.coalesce(F.round(value.cast("double"), 8), F.lit(0.0)).cast("decimal(38,8)")


def metric_items(calls: DataFrame) -> DataFrame:
    """Model calls as metric items: keys, defaults, decimals, expiry after 90 days.

    ``calls``: ``operation, called_at, trace_id, prompt_tokens, completion_tokens, cost_usd,
    decision, decision_reason, hallucination_risk_score, hallucination_risk_level,
    composite_risk_score, composite_risk_level, policy_decision, model_id, body_len, pipeline_operation``.
    """
    stamp = F.date_format("called_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = {"hallucination_risk_level": "hallucination_risk_level", "composite_risk_level": "composite_risk_level",
            "policy_gate": "policy_decision"}
    return calls.select(
        F.concat(F.lit("OBSERVATORY#"), "operation").alias("pk"),
        F.concat(stamp, F.lit("#"), "trace_id").alias("sk"), "trace_id", "operation", stamp.alias("timestamp"),
        F.coalesce("prompt_tokens", F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).cast("long").alias("completion_tokens"),
        _score(F.col("cost_usd")).alias("cost_usd"), F.coalesce("decision", F.lit("unknown")).alias("decision"),
        F.when(F.coalesce("decision_reason", F.lit("")) == "", "none").otherwise(F.col("decision_reason")).alias("decision_reason"),
        _score(F.col("hallucination_risk_score")).alias("hallucination_risk_score"),
        _score(F.col("composite_risk_score")).alias("composite_risk_score"),
        *[F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(F.col(c)).alias(k) for k, c in text.items()],
        (F.unix_timestamp("called_at") + K.METRIC_TTL_SECONDS).alias("ttl"),
        "model_id", F.col("body_len").cast("long").alias("body_len"), "pipeline_operation",
    )
