"""Files to answers: ingest, service, streams, administration."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import vectors as V
from dossier.operators import routing as W
from dossier.plans import ingest
from dossier.plans.service import Service, run_action
from dossier.sources import files
from dossier.sources.requests import BadRequest, QueryRequest, parse_event
from dossier.sources.store import Store
from dossier.streaming.feedback import feedback_stream, replay_stream
from dossier.streaming.ingest import ingest_stream

ARCHITECTURE = """# Platform
Uses AWS Lambda and Amazon S3 in an event-driven, serverless way with Python.
## Storage
Data lives in Amazon S3.
## Compute
Runs on AWS Lambda.
"""


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_files(root):
    contents = {
        "raw/alpha/architecture.md": ARCHITECTURE.encode(),
        "raw/alpha/docs/repo-signals.yaml": b"repo_name: alpha\nskills:\n  - Python\npatterns: [serverless]\n",
        "raw/alpha/docs/flow.puml": b"@startuml\nactor User\nUser --> Api : calls\n@enduml\n",
        "raw/beta/readme.md": "Kafka and Go with CQRS \xe9".encode("latin-1"),
        "raw/beta/resume.docx": docx("Built systems in Rust.", " ", "Led a team."),
        "raw/beta/broken.pdf": b"not a pdf",
    }
    for key, body in contents.items():
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return contents


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    write_files(root)
    store = Store(spark, str(root / "store"), chunk_buckets=4)
    run_action(store)
    report = ingest.run_folder(store, str(root), embedder=V.HashingEmbedder(64))
    return root, store, report


def test_file_source(spark, tmp_path):
    contents = write_files(tmp_path)
    listed = files.list_files(spark, str(tmp_path)).collect()
    assert {r.source_key: r.length for r in listed} == {k: len(v) for k, v in contents.items()}
    texts = {r.source_key: r for r in files.read_text(files.read_objects(spark, str(tmp_path))).collect()}
    assert texts["raw/beta/readme.md"].content == contents["raw/beta/readme.md"].decode("utf-8", errors="replace")
    assert texts["raw/beta/resume.docx"].content == "Built systems in Rust.\n\nLed a team."
    assert texts["raw/beta/broken.pdf"].content is None and texts["raw/beta/broken.pdf"].error
    assert texts["raw/beta/resume.docx"].repo_prefix == "raw/beta/"


def test_ingest_report_and_tables(spark, ingested):
    root, store, report = ingested
    assert report.status == "partial" and report.files_processed == 5 and report.files_skipped == 1
    assert report.error_count == 1
    assert report.routing_summary["technical_spec:hierarchical"] >= 1
    kinds = {r.node_type for r in store.read("nodes").select("node_type").distinct().collect()}
    assert {"Person", "Repository", "Document", "Skill", "Technology", "AWSService", "Pattern", "DocumentType", "ChunkingStrategy"} == kinds
    assert store.chunks().count() == report.chunks_written > 0
    manifest = json.loads(spark.read.json(f"{store.root}/derived/processing_manifest").first().manifest)
    assert manifest["files_processed"] == 5
    texts = spark.read.json(f"{store.root}/derived/extracted_text")
    assert texts.where("text_key = 'derived/alpha/architecture.md.extracted.txt'").count() == 1


def test_ingest_again_changes_nothing(ingested):
    root, store, report = ingested
    view = lambda: (sorted(map(str, store.read("edges").collect())), store.read("nodes").count(), sorted(r.id for r in store.chunks().select("id").collect()))
    before = view()
    ingest.run_folder(store, str(root), embedder=V.HashingEmbedder(64))
    assert view() == before


def request(body, encoded=False, method="POST", path="/dev/query-expertise"):
    text = body if isinstance(body, str) else json.dumps(body)
    return {"requestContext": {"http": {"method": method}}, "rawPath": path, "isBase64Encoded": encoded,
            "body": base64.b64encode(text.encode()).decode() if encoded else text}


def test_requests():
    asked = parse_event(request({"question": " Q ", "topK": "7", "minConfidence": 0.1}, encoded=True))
    assert (asked.question, asked.top_k, asked.min_confidence) == (" Q ", 7, 0.1)
    assert parse_event(request({"question": "q", "top_k": 3})).top_k == 3
    for bad in ["", "{", "[]", {"question": "  "}, {"question": "q", "topK": 51}, {"question": "q", "topK": "many"}, {"question": "x" * 2001}]:
        with pytest.raises(BadRequest):
            parse_event(request(bad))
    with pytest.raises(BadRequest, match="Invalid topK"):
        parse_event(request({"question": "q", "topK": "many"}))
    assert QueryRequest.from_dict({"question": "q"}).top_k == K.DEFAULT_TOP_K


def fixed_model():
    class Fixed:
        """A model that always gives the same reply (local, so that it travels by value)."""

        model_id = "fixed"

        def generate(self, system, prompts):
            return ['```json\n{"answer": "yes", "confidence": 0.9, "inferred_skills": ["Zig"]}\n```' for _ in prompts]

    return Fixed()


def test_service(ingested):
    _, store, _ = ingested
    service = Service(store, V.HashingEmbedder(64))
    health = service.health()
    assert {d["doc_type"] for d in health["routingGraph"]["documentTypeDistribution"]} >= {"technical_spec"}
    plain = service.answer(parse_event(request({"question": "Which cloud design uses AWS Lambda?", "minConfidence": 0.0})))
    assert plain["modelId"] == "none" and plain["questionType"] == "architecture" and plain["cacheHit"] is False
    assert plain["routingDecision"]["strategy"] == "graph_first" and "1. [" in plain["answer"]
    assert "AWS Lambda" in plain["graphEntitiesUsed"] and "Python" in plain["inferredSkills"]
    # A confidence of zero is never cached but does count against the strategy.
    assert store.read("query_cache").count() == 0
    weight = store.read("routing_weights").where("strategy = 'graph_first' AND question_type = 'architecture'").first()
    assert round(weight.weight, 6) == 0.78 and weight.feedback_count == 1


def test_service_with_model_and_cache(ingested):
    _, store, _ = ingested
    service = Service(store, V.HashingEmbedder(64), fixed_model())
    body = {"question": "How well does the team know Kafka?", "minConfidence": 0.0}
    first = service.answer(parse_event(request(body)))
    assert first["answer"] == "yes" and first["confidence"] == 0.9 and "Zig" in first["inferredSkills"] and first["sources"]
    again = service.answer(parse_event(request(body)))
    assert again["cacheHit"] is True and again["answer"] == "yes" and again["routingDecision"] == {}
    assert [r.pipeline_operation for r in store.call_items().collect()] == ["synthesize_answer"]  # a cache hit calls no model
    assert store.read("query_cache").first().hit_count == 1


def test_admin(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), chunk_buckets=2)
    assert run_action(store)["status"] == "success"
    assert store.read("routing_weights").count() == 24 and store.chunks().count() == 0
    assert run_action(store, "init_db")["status"] == "success" and store.read("routing_weights").count() == 24
    assert run_action(store, "reset_routing")["edges_reset"] == 24
    assert run_action(store, "empty_all")["status"] == "success" and store.read("routing_weights").count() == 0
    assert run_action(store, "nonsense")["status"] == "failed"


def test_ingest_stream_equals_batch(spark, ingested, tmp_path):
    root, batch, _ = ingested
    store = Store(spark, str(tmp_path / "s"), chunk_buckets=4)
    query = ingest_stream(store, str(root), str(tmp_path / "c"), files_per_batch=2, embedder=V.HashingEmbedder(64))
    query.awaitTermination(240)
    assert query.exception() is None
    ids = lambda s: sorted(r.id for r in s.chunks().select("id").collect())
    assert ids(store) == ids(batch)
    nodes = lambda s: sorted(r.node_id for r in s.read("nodes").select("node_id").collect())
    assert nodes(store) == nodes(batch)


def test_stream_of_files_keeps_the_artifacts_of_every_batch(spark, ingested, tmp_path):
    root, batch, _ = ingested
    store = Store(spark, str(tmp_path / "s"), chunk_buckets=4)
    query = ingest_stream(store, str(root), str(tmp_path / "c"), files_per_batch=3, embedder=V.HashingEmbedder(64), whole_repos=False)
    query.awaitTermination(240)
    assert query.exception() is None
    for name, key in (("extracted_text", "text_key"), ("artifacts", "source_key")):
        keys = lambda s: sorted(r[0] for r in spark.read.json(f"{s.root}/derived/{name}").select(key).collect())
        assert keys(store) == keys(batch)
    assert spark.read.json(f"{store.root}/derived/processing_manifest").select("batch").distinct().count() > 1


def test_graph_tables_are_stored_by_kind(spark, ingested):
    _, store, _ = ingested
    plan = store.read("edges").where("relationship = 'USES_TECH'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(relationship" in plan
    assert store.read("edges").columns == ["edge_id", "from_id", "to_id", "relationship", "weight", "source_file"]


def feedback_log(spark, path, n=400):
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hybrid").otherwise("graph_first").alias("strategy"),
        F.when(F.col("id") % 4 == 0, "project").otherwise("general").alias("question_type"),
        ((F.col("id") * 37 % 100) / 100).alias("confidence"),
    ).repartition(4)
    rows.write.parquet(path)
    return rows


def test_feedback_stream_equals_batch(spark, tmp_path):
    log = feedback_log(spark, str(tmp_path / "log"))
    store = Store(spark, str(tmp_path / "s"))
    run_action(store, "seed_routing")
    start = store.read("routing_weights")
    want = {(r.strategy, r.question_type): (round(r.weight, 9), r.feedback_count) for r in W.apply_feedback(start, log).collect()}
    # One batch holds the whole log, so the order within it is the order of seq.
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = feedback_stream(store, source, str(tmp_path / "c"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = {(r.strategy, r.question_type): (round(r.weight, 9), r.feedback_count) for r in store.read("routing_weights").collect()}
    assert got == want and store.tag("routing_weights") == "0"


def test_replay_stream_equals_batch(spark, tmp_path):
    log = feedback_log(spark, str(tmp_path / "log"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = (replay_stream(source).writeStream.format("memory").queryName("replayed").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert query.exception() is None
    rows = spark.table("replayed").collect()
    assert len(rows) == 400
    for kind in ("project", "general"):
        state = W.ReplayState(W.start_weights(kind))
        asked = sorted((r.seq, r.strategy) for r in rows if r.question_type == kind)
        for seq, strategy in asked:
            assert strategy == K.STRATEGY_PRIORITY[state.choice()]
            confidence = seq * 37 % 100 / 100
            if confidence >= 0.7:
                state.run(5, 1)
            elif confidence < 0.4:
                state.run(-2, 1)


def test_counts_are_observed_on_writes(spark):
    from dossier.session import materialize_counted

    rows = spark.range(100).withColumn("odd", F.when(F.col("id") % 2 == 1, 1))
    table, seen = materialize_counted(rows, odd=F.count("odd"))
    assert table.count() == 100 and seen == {"rows": 100, "odd": 50}
    assert materialize_counted(rows.limit(0), odd=F.count("odd"))[1] == {"rows": 0, "odd": 0}
    assert materialize_counted(spark.createDataFrame([], "x int"))[1] == {"rows": 0}


def test_graph_errors_raise_only_without_nodes(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([("a", "Skill", "A", "", 1.0, {}), ("b", "Skill", "B", "", 1.0, {})], "node_id string, node_type string, label string, source_file string, confidence double, properties map<string,string>")
    edges = spark.createDataFrame([("e", "a", "b", "USES", 1.0, ""), ("f", "a", "zz", "USES", 1.0, "")], "edge_id string, from_id string, to_id string, relationship string, weight double, source_file string")
    store = Store(spark, str(tmp_path / "s"))
    assert ingest.write_graph(store, nodes, edges) == (2, 1, [])
    assert ingest.write_graph(store, nodes.limit(0), edges.limit(0)) == (0, 0, [])  # nothing to write is no error
    replace = Store.replace

    def failing(name):
        def run(self, table, rows):
            if table == name:
                raise OSError("disk full")
            return replace(self, table, rows)

        return run

    monkeypatch.setattr(Store, "replace", failing("edges"))
    assert ingest.write_graph(store, nodes, edges) == (2, 0, ["edges were not written: disk full"])
    monkeypatch.setattr(Store, "replace", failing("nodes"))
    with pytest.raises(RuntimeError, match="no node was written: disk full"):
        ingest.write_graph(store, nodes, edges)
