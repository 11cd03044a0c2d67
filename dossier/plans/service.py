"""One request at a time: cache, answer, feedback; and administration. Callers parse requests and shape replies."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import vectors as V
from dossier.functions.screen import screened
from dossier.operators import cache as C
from dossier.operators import evidence as A
from dossier.operators import graph_query as G
from dossier.operators import routing as W
from dossier.plans import answer as P
from dossier.session import materialize
from dossier.sources.requests import QueryRequest
from dossier.sources.store import TABLES, Store


@dataclass
class Service:
    store: Store
    embedder: V.Embedder
    model: A.Generator | None = None
    use_graph: bool = True
    environment: str = "unknown"
    classifier: A.Generator | None = None
    record_calls: bool = True
    screen: bool = False

    # -- requests -----------------------------------------------------------

    def health(self) -> dict:
        rows = []
        if self.use_graph:
            rows = [r.asDict() for r in G.document_type_distribution(self.store.read("nodes"), self.store.read("edges")).collect()]
        return {"status": "healthy", "environment": self.environment, "routingGraph": {"documentTypeDistribution": rows}}

    def answer(self, request: QueryRequest) -> dict:
        """Answer one question; cache and routing weights are updated as a side effect."""
        start = time.monotonic()
        spark, store = self.store.spark, self.store
        question = spark.createDataFrame(
            [(0, request.question, request.question_type)], "qid long, question string, question_type string"
        )
        if self.screen:
            question, refused = screened(question)
            stop = refused.first()
            if stop is not None:
                return {"answer": "", "blocked": True, "reasons": list(stop["reasons"]), "latencyMs": _since(start), "cacheHit": False}
        now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        cache = store.read("query_cache")
        hits, _ = P.with_cache(question, cache, now, self.embedder)
        hit = hits.first()
        if hit is not None:
            store.replace("query_cache", C.count_hits(cache, hits.select("cache_id")))
            return {**json.loads(hit["response_json"]), "cacheHit": True, "latencyMs": _since(start)}
        nodes, edges = (store.read("nodes"), store.read("edges")) if self.use_graph else (None, None)
        weights = store.read("routing_weights")
        responses = materialize(P.answer_batch(
            question, store.chunks().withColumnRenamed("id", "chunk_id"), nodes, edges, weights, self.embedder, self.model, request.top_k,
            request.min_confidence, request.include_graph_expansion, self.classifier, store.append_calls if self.record_calls else None,
        ))
        row = responses.select(P.response_json().alias("body"), P.response_json(False).alias("stored"), "confidence",
                               "question_type", "routing_decision.strategy").first()
        self._remember(request, row, now)
        return {**json.loads(row["body"]), "latencyMs": _since(start), "cacheHit": False}

    def _remember(self, request: QueryRequest, row, now) -> None:
        spark, store = self.store.spark, self.store
        stamp = time.time_ns() // 1000
        if row["confidence"] >= K.CACHE_MIN_CONFIDENCE:
            asked = spark.createDataFrame(
                [(stamp, request.question, row["stored"], row["question_type"], row["confidence"])],
                "seq long, question string, response_json string, question_type string, confidence double",
            ).where(~P.Q.is_time_sensitive(F.col("question")))
            asked = materialize(asked.withColumn("embedding", V.embed(F.col("question"), self.embedder)).drop("question"))
            store.replace("query_cache", C.write(store.read("query_cache"), asked, now))
        feedback = spark.createDataFrame(
            [(row["strategy"], row["question_type"], row["confidence"], stamp)],
            "strategy string, question_type string, confidence double, seq long",
        )
        if not K.PENALISE_THRESHOLD <= row["confidence"] < K.REINFORCE_THRESHOLD:
            store.replace("routing_weights", W.apply_feedback(store.read("routing_weights"), feedback))


def _since(start: float) -> int:
    return int((time.monotonic() - start) * 1000)


# -- Administration ---------------------------------------------------------

def init_tables(store: Store) -> dict:
    """Create missing tables; existing ones stay as they are."""
    for name in TABLES:
        if not store.has(name):
            store.replace(name, store.read(name))
    if not store.exists(store.chunks_path):
        store.truncate_chunks()
    return {"status": "success", "tables": [*TABLES, "chunks"]}


def seed_routing(store: Store) -> dict:
    store.replace("routing_weights", W.seed(store.read("routing_weights")))
    return {"status": "success", "nodes": len(K.STRATEGY_PRIORITY) + len(K.QUESTION_TYPES), "edges": store.read("routing_weights").count()}


def reset_routing(store: Store) -> dict:
    store.replace("routing_weights", W.reset(store.read("routing_weights"), F.current_timestamp()))
    return {"status": "success", "edges_reset": store.read("routing_weights").count()}


def empty(store: Store, name: str) -> dict:
    """Empty a table, keeping its schema; ``chunks`` and ``graph`` included; ``artifacts`` deletes derived files."""
    if name == "chunks":
        store.truncate_chunks()
    elif name == "graph":
        for table in ("nodes", "edges", "routing_weights"):
            store.replace(table, store.read(table).limit(0))
    elif name == "artifacts":
        store.delete("derived")
    else:
        raise ValueError(f"unknown store: {name}")
    return {"status": "success", "emptied": name}


ACTIONS = {
    "init_db": init_tables,
    "seed_routing": seed_routing,
    "reset_routing": reset_routing,
    "empty_artifacts": lambda s: empty(s, "artifacts"),
    "empty_graph": lambda s: empty(s, "graph"),
    "empty_chunks": lambda s: empty(s, "chunks"),
}


def run_action(store: Store, action: str = "") -> dict:
    """One administrative action; none means tables and routing weights are set up."""
    if action in ACTIONS:
        try:
            return {"action": action, **ACTIONS[action](store)}
        except Exception as failed:
            return {"action": action, "status": "failed", "reason": str(failed)}
    if action == "empty_all":
        parts = {name: run_action(store, f"empty_{name}") for name in ("artifacts", "graph", "chunks")}
        whole = all(p["status"] == "success" for p in parts.values())
        return {"action": action, "status": "success" if whole else "partial", **parts}
    if action:
        return {"action": action, "status": "failed", "reason": "unknown action"}
    made, seeded = run_action(store, "init_db"), run_action(store, "seed_routing")
    return {"status": "success" if made["status"] == "success" else "partial", "tables": made, "routing": seeded}
