"""Structured Streaming: files arriving under ``raw/`` are ingested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.functions import documents as D
from dossier.functions import vectors as V
from dossier.plans import ingest
from dossier.sources import files
from dossier.sources.store import Store


def ingest_stream(store: Store, root: str, checkpoint: str, files_per_batch: int = 1000,
                  available_now: bool = True, embedder: V.Embedder | None = None, whole_repos: bool = True,
                  **options) -> StreamingQuery:
    """Each micro-batch runs the batch ingest; merges are keyed, so a replayed batch changes nothing.

    With ``whole_repos`` the repositories a batch touches are read again in full, so that
    their graph and artifacts describe all their files and not only the new ones. Without it
    every batch writes its artifacts beside those of the earlier ones.
    """
    source = (
        store.spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length bigint, content binary"
        )
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .load(f"{root.rstrip('/')}/raw/")
    )

    def batch(rows: DataFrame, batch_id: int) -> None:
        arrived = files.with_keys(rows)
        if not whole_repos:
            ingest.run(store, files.read_text(arrived), embedder=embedder, batch=batch_id, **options)
            return
        prefix = D.repo_prefix(F.col("source_key"))
        for row in arrived.select(prefix.alias("prefix")).distinct().collect():
            ingest.run_folder(store, root, row["prefix"], embedder=embedder, **options)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
