"""Ordered folds, search, cache, routing, graph and answers against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import ann, cache
from dossier.operators import evidence as A
from dossier.operators import graph_build as B
from dossier.operators import graph_query as G
from dossier.operators import ordered as O
from dossier.operators import retrieval as R
from dossier.operators import routing as W
from dossier.operators import similarity as S
from dossier.sources import store


# -- Ordered ----------------------------------------------------------------

def moves(n=5000, hot=0.7):
    """Most rows share one key, in shuffled order with gaps in the sequence."""
    rng = random.Random(4)
    rows = [(3 * i, "hot" if rng.random() < hot else f"k{i % 5}", rng.choice([0.05, -0.02])) for i in range(n)]
    return rows, rng.sample(rows, n)


def test_clamp_fold_equals_sequence(spark):
    rows, shuffled = moves()
    want = {}
    for _, key, d in rows:
        want[key] = min(1.0, max(0.1, want.get(key, 0.5) + d))
    df = spark.createDataFrame(shuffled, "seq long, k string, d double")
    got = O.clamp_fold(df, "seq", "d", ["k"], bits=4).withColumn("w", O.apply_clamp(F.lit(0.5), F.col("d"), F.col("lo"), F.col("hi")))
    assert {r.k: round(r.w, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_running_totals_equal_sequence(spark):
    rows, shuffled = moves(2000)
    df = spark.createDataFrame(shuffled, "seq long, k string, d double").withColumn("one", F.lit(1))
    got = {r.seq: r.running_one for r in O.running_totals(df, "seq", ["one"], ["k"], bits=4).collect()}
    seen = {}
    for seq, key, _ in rows:
        seen[key] = seen.get(key, 0) + 1
        assert got[seq] == seen[key]


def test_value_at_rank(spark):
    values = [random.Random(1).randrange(50000) for _ in range(3000)] + [7] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for share in (0.0, 0.2, 0.5, 0.95):
        got = O.value_at_rank(df, "v", lambda n: F.floor(n * F.lit(share))).first()["v"]
        assert got == sorted(values)[int(len(values) * share)]
    small = spark.createDataFrame([(i,) for i in range(20)], "v long")
    assert O.value_at_rank(small, "v", lambda n: F.floor(n * F.lit(0.95))).first()["v"] == 19


# -- Search -----------------------------------------------------------------

def vectors(n, dim=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dim)).astype(np.float32)
    if copies:
        out[:copies] = out[0]  # a hot group of equal vectors
    return out


def frame(spark, data, name, vec):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], f"{name} long, {vec} array<float>")


def brute(q, c, k):
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(c).T, 12)
    ids = np.arange(len(c))
    return {(i, j + 1): int(np.lexsort((ids, -sims[i]))[j]) for i in range(len(q)) for j in range(min(k, len(c)))}


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_top_k_is_exact_broadcast_or_not(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(S, "QUESTIONS_PER_TILE", 16)
    q, c = vectors(50, seed=1), vectors(400, seed=2, copies=150)
    got = S.top_k(frame(spark, q, "qid", "question_embedding"), frame(spark, c, "chunk_id", "embedding"), 5)
    assert {(r.qid, r.rank): r.chunk_id for r in got.collect()} == brute(q, c, 5)


def test_list_index_exact_and_recall(spark):
    q, c = vectors(30, seed=3), vectors(500, seed=4, copies=150)
    index = ann.build_index(frame(spark, c, "chunk_id", "embedding"), lists=12, iterations=2)
    asked = frame(spark, q, "qid", "question_embedding")
    want = brute(q, c, 6)
    exact = {(r.qid, r.rank): r.chunk_id for r in ann.search(asked, index, 6, nprobe=1, exact=True).collect()}
    assert exact == want
    probed = {(r.qid, r.chunk_id) for r in ann.search(asked, index, 6, nprobe=6, exact=False).collect()}
    recall = len(probed & {(q_, c_) for (q_, _), c_ in want.items()}) / len(want)
    assert recall > 0.6


# -- Retrieval --------------------------------------------------------------

def results(spark, rows):
    df = spark.createDataFrame(rows, "qid long, rank int, chunk_id long, content string, effective_score double")
    return df.select(
        "qid", "chunk_id", "content", F.col("effective_score").alias("score"), F.lit("a.md").alias("source_file"),
        F.lit("pgvector://a.md").alias("source_uri"), F.lit(1.0).alias("source_weight"), "effective_score",
        F.create_map().cast("map<string,string>").alias("metadata"), "rank",
    )


def listed(df):
    return [(r.qid, r.rank, r.chunk_id) for r in df.orderBy("qid", "rank").collect()]


def test_dedup_keeps_first_of_alike(spark):
    rows = [(1, 1, 10, "a b c d", 0.9), (1, 2, 11, "A b c d", 0.8), (1, 3, 12, "x y", 0.7), (1, 4, 13, "", 0.6), (1, 5, 14, "", 0.5)]
    assert listed(R.deduplicate(results(spark, rows))) == [(1, 1, 10), (1, 2, 12), (1, 3, 13), (1, 4, 14)]


def test_merge_and_rerank(spark):
    first = results(spark, [(1, 1, 10, "go lang", 0.5), (1, 2, 11, "java beans", 0.4), (2, 1, 20, "one", 0.3)])
    second = results(spark, [(1, 1, 10, "go lang", 0.9), (1, 2, 30, "rust crab", 0.45), (3, 1, 40, "solo", 0.2)])
    assert listed(R.merge(first, second, 2)) == [(1, 1, 10), (1, 2, 30), (2, 1, 20), (3, 1, 40)]
    asked = spark.createDataFrame([(1, "java beans?"), (2, "is it")], "qid long, question string")
    assert listed(R.keyword_rerank(first, asked)) == [(1, 1, 11), (1, 2, 10), (2, 1, 20)]


def test_strategies(spark):
    data = vectors(40, seed=6)
    names = ["architecture.md", "resume.pdf", "readme.md", "notes.txt"]
    chunks = spark.createDataFrame(
        [(i, v.tolist(), f"text {i} word{i % 7}", names[i % 4], "narrative", "sentence", i % 2 == 0) for i, v in enumerate(data)],
        "chunk_id long, embedding array<float>, content string, source_file string, doc_type string, strategy string, is_child boolean")
    asked = spark.createDataFrame(
        [(i, f"find word{i}", data[i].tolist(), s) for i, s in enumerate(K.STRATEGY_PRIORITY)],
        "qid long, question string, question_embedding array<float>, strategy string")
    rows = R.retrieve_with_strategy(asked, chunks, 4, -1.0).collect()
    assert {r.qid for r in rows} == {0, 1, 2, 3} and max(r.rank for r in rows) == 4
    for r in rows:
        if r.qid != 2:  # all but the reranked list are in score order
            better = [x for x in rows if x.qid == r.qid and x.rank < r.rank]
            assert all(x.effective_score >= r.effective_score for x in better)


def test_stored_index_reads_probed_lists_only(spark, tmp_path, monkeypatch):
    data = vectors(400, seed=21)
    rows = frame(spark, data, "chunk_id", "embedding")
    path = str(tmp_path / "index")
    index = ann.save_index(ann.build_index(rows.where("chunk_id < 300"), lists=8, iterations=3), path)
    before = {i: n for i, (n, _) in index.stats.items()}
    index = ann.add_vectors(spark, path, rows.where("chunk_id >= 300"))
    assert sum(n for n, _ in index.stats.values()) == 400 and sum(before.values()) == 300
    asked = frame(spark, data[:40], "qid", "question_embedding")
    exact = ann.search(asked, index, 5, nprobe=1)
    want = S.top_k(asked, rows, 5)
    key = lambda df: sorted((r.qid, r.chunk_id, r.rank) for r in df.collect())
    assert key(exact) == key(want)
    # Two of the eight lists are read, as folders.
    some = ann.listed(index, [1, 5])
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("list_id=")[1].split("/")[0] for r in read} == {"1", "5"}
    pruned = some._jdf.queryExecution().executedPlan().toString()
    assert "list_id" in pruned.split("PartitionFilters: [")[1].split("]")[0] and "IN (1,5)" in pruned.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    asked_for = []
    monkeypatch.setattr(ann, "listed", lambda index, lists, run=ann.listed: asked_for.append(lists) or run(index, lists))
    assert ann.search(asked.where("qid = 3"), index, 5, nprobe=2, exact=False).count() > 0
    assert [len(x) for x in asked_for] == [2]
    monkeypatch.undo()
    assert ann.listed(index, []).count() == 0


# -- Cache ------------------------------------------------------------------

def in_order(unit, threshold):
    kept = []
    for i in range(len(unit)):
        if not kept or np.round(unit[kept] @ unit[i], 12).max() < threshold:
            kept.append(i)
    return kept


@pytest.mark.parametrize("degree", [1000, 2, 0])
def test_cache_insert_follows_the_order(spark, degree):
    data = vectors(120, dim=4, seed=7, copies=40)
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    empty = spark.createDataFrame([], cache.CACHE_TYPE)
    got = cache.insert_new(frame(spark, data, "seq", "embedding"), empty, F.current_timestamp(), 0.8, degree).collect()
    assert sorted(r.seq for r in got) == in_order(unit, 0.8)


@pytest.mark.parametrize("shuffled", [False, True])
def test_cache_insert_along_a_chain(spark, shuffled):
    """Every vector is near its neighbours on an arc only, so each decision hangs on the one before."""
    turn = np.arange(600) * 0.01
    if shuffled:
        np.random.default_rng(3).shuffle(turn)
    data = np.stack([np.cos(turn), np.sin(turn)], axis=1).astype(np.float32)
    threshold = float(np.cos(0.0151))
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    empty = spark.createDataFrame([], cache.CACHE_TYPE)
    got = cache.insert_new(frame(spark, data, "seq", "embedding"), empty, F.current_timestamp(), threshold).collect()
    assert sorted(r.seq for r in got) == in_order(unit, threshold)


def test_settling_equals_one_pass(spark):
    draw = np.random.default_rng(5)
    pairs = {tuple(sorted(draw.choice(300, 2, replace=False).tolist())) for _ in range(700)} | {(i, i + 1) for i in range(300, 420)}
    gone = set()
    for b in range(421):
        if any((a, b) in pairs and a not in gone for a in range(b)):
            gone.add(b)
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long")
    assert {r.seq for r in cache.settle(df).collect()} == gone
    assert cache.settle(df.limit(0)).count() == 0


def test_cache_write_lookup_expire(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = [(1, [1.0, 0.0], '{"answer":"a","latencyMs":5,"n":[1]}', "general", 0.9), (2, [1.0, 0.0], '{"answer":"b"}', "general", 0.9),
            (3, [0.0, 1.0], '{"answer":"c"}', "general", 0.4)]
    new = spark.createDataFrame(rows, "seq long, embedding array<float>, response_json string, question_type string, confidence double")
    stored = cache.write(spark.createDataFrame([], cache.CACHE_TYPE), new, now)
    assert [json.loads(r.response_json) for r in stored.collect()] == [{"answer": "a", "n": [1]}]
    asked = spark.createDataFrame([(7, [0.99, 0.01])], "qid long, question_embedding array<float>")
    hits = cache.lookup(asked, stored, now)
    assert [(r.qid, r.cache_id) for r in hits.collect()] == [(7, "q1")]
    assert cache.count_hits(stored, hits).first().hit_count == 1
    assert cache.lookup(asked, stored, now + F.expr("INTERVAL 8 DAYS")).count() == 0


# -- Routing ----------------------------------------------------------------

def test_selection_ties_and_boundaries(spark):
    rows = [("graph_first", "t", 0.5), ("hybrid", "t", 0.5), ("semantic_search", "t", 0.4), ("hybrid", "u", 0.9), ("semantic_search", "u", 0.9)]
    best = {r.question_type: r.strategy for r in W.select_strategy(spark.createDataFrame(rows, "strategy string, question_type string, weight double")).collect()}
    assert best == {"t": "graph_first", "u": "hybrid"}
    acts = spark.createDataFrame([(0.7,), (0.4,), (0.3999,), (None,)], "c double").select(W.feedback_action(F.col("c")).alias("a")).collect()
    assert [r.a for r in acts] == ["reinforce", "neutral", "penalise", "unknown"]


def test_feedback_clamps(spark):
    stored = spark.createDataFrame([("hybrid", "t", 0.98, 0)], "strategy string, question_type string, weight double, feedback_count long")
    log = spark.createDataFrame([("hybrid", "t", 0.9, 1), ("hybrid", "t", 0.5, 2), ("hybrid", "t", 0.1, 3)],
                                "strategy string, question_type string, confidence double, seq long")
    row = W.apply_feedback(stored, log).first()
    assert (round(row.weight, 9), row.feedback_count) == (0.98, 2)
    assert round(W.apply_feedback(stored, log.where("seq = 1")).first().weight, 9) == 1.0


def replay_plainly(log):
    state = {}
    for kind, confidence in log:
        w, n = state.setdefault(kind, (W.start_weights(kind), [0] * 4))
        step = 5 if confidence >= 0.7 else -2 if confidence < 0.4 else 0
        if step:
            at = w.index(max(w))
            w[at] = min(100, max(10, w[at] + step))
            n[at] += 1
    return {(k, s): (w[i] / 100, n[i]) for k, (w, n) in state.items() for i, s in enumerate(K.STRATEGY_PRIORITY)}


def test_replay_runs_equal_single_steps(spark):
    rng = random.Random(8)
    log = [("general" if rng.random() < 0.6 else rng.choice(["project", "odd"]), rng.choice([0.1, 0.1, 0.5, 0.9])) for _ in range(3000)]
    df = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(log)], "seq long, question_type string, confidence double")
    got = {(r.question_type, r.strategy): (r.weight, r.feedback_count) for r in W.replay(df).collect()}
    assert got == replay_plainly(log)


def test_seed_and_reset(spark):
    stored = spark.createDataFrame([("hybrid", "general", 0.99, 5, True, None)], W.WEIGHTS_TYPE)
    seeded = W.seed(stored)
    assert seeded.count() == 24 and seeded.where("weight = 0.99").count() == 1
    assert W.seed(seeded).count() == 24
    assert W.reset(seeded, F.current_timestamp()).where("weight = 0.99").count() == 0


# -- Graph ------------------------------------------------------------------

def docs(spark, files):
    rows = [(f"raw/r/{name}", name, "text", 0.5, "text", [(k, v, name, w, n) for k, v, w, n in signals]) for name, signals in files]
    kind = "array<struct<signal_type:string,value:string,source_file:string,weight:double,frequency:int>>"
    df = spark.createDataFrame(rows, f"source_key string, source_file string, file_type string, weight double, extracted_text string, expertise_signals {kind}")
    return B.with_owners(df, F.lit("Dev"), F.lit("r"))


def test_graph_build(spark):
    files = [("a.md", [("skill", "Go", 0.4, 0), ("pattern", "CQRS", 0.95, 0), ("technology", "X", 0.5, 9), ("other", "Z", 1.0, 1), ("skill", " ", 1.0, 1)]),
             ("b.md", [("skill", "go", 0.9, 1), ("skill", "Go", 0.9, 1), ("pattern", "CQRS", 0.1, 0), ("aws_service", "AWS S3", 0.3, 1)])]
    nodes, edges = B.build_graph(docs(spark, files), routing=False)
    n = {r.node_id: r for r in nodes.collect()}
    e = {r.edge_id: r for r in edges.collect()}
    assert n["skill_go"].label == "Go" and round(n["skill_go"].confidence, 6) == 0.5 and n["skill_go"].source_file == "a.md"
    assert n["skill_go"].properties == {"category": "skill", "frequency": "1"}
    assert n["technology_x"].confidence == 0.75
    assert n["document_a_md"].properties["text_hash"] and "skill_" not in n
    assert e["person_dev__demonstrates_pattern__pattern_cqrs"].weight == 1.0
    # One sighting in the first document, two in the second.
    assert round(e["skill_go__strengthens__pattern_cqrs"].weight, 6) == 0.7
    assert round(e["document_b_md__indicates_skill__skill_go"].weight, 6) == 1.0
    assert "technology_x__strengthens__awsservice_aws_s3" not in e
    assert {"person_dev__built__repository_r", "repository_r__contains__document_a_md"} <= set(e)


def test_merge_is_idempotent_and_drops_dangling(spark):
    nodes, edges = B.build_graph(docs(spark, [("a.md", [("skill", "Go", 0.4, 1)])]), routing=False)
    once = B.merge_nodes(nodes.limit(0), nodes)
    assert sorted(map(str, B.merge_nodes(once, nodes).collect())) == sorted(map(str, once.collect()))
    lost = edges.limit(1).withColumn("to_id", F.lit("nowhere")).withColumn("edge_id", F.lit("x"))
    assert B.merge_edges(edges.limit(0), edges.unionByName(lost), once).count() == edges.count()


def test_first_labels_are_distinct_and_sorted(spark):
    rows = spark.createDataFrame([("a", x) for x in "zxyzabq"] + [("b", None)], "k string, l string")
    assert {r.k: r.ls for r in G.first_labels(rows, ["k"], "l", 3, "ls").collect()} == {"a": ["a", "b", "q"]}


# -- Answers ----------------------------------------------------------------

def test_evidence_budget_stops_before_a_block(spark):
    rows = [(1, 1, 1, "a" * 4950, 0.5), (1, 2, 2, "b" * 3950, 0.4), (1, 3, 3, "c", 0.3)]
    assert [r.rank for r in A.evidence_blocks(results(spark, rows)).orderBy("rank").collect()] == [1, 2]
    first = A.evidence_blocks(results(spark, rows)).orderBy("rank").first().block
    assert first.startswith("[1] Source: a.md (authority=HIGH, score=0.500)\naaa") and first.endswith("a\n")


def test_reply_parsing(spark):
    fence = "```json\n{\"answer\": \"x\", \"confidence\": 0.9}\n```"
    rows = spark.createDataFrame([(fence,), ("garbage",), ("[1]",)], "raw string").select(A.parse_reply(F.col("raw")).alias("r")).collect()
    assert [(r.r.answer, r.r.confidence) for r in rows] == [("x", 0.9), ("garbage", 0.5), ("[1]", 0.5)]


def test_chunk_upsert_keeps_documents_without_new_rows(spark):
    kind = "doc_id string, source_file string, embedding array<float>, content string"
    old = spark.createDataFrame([("r/a", "a", [1.0], "old a"), ("r/b", "b", [1.0], "old b")], kind)
    new = spark.createDataFrame([("r/a", "a", [1.0], "new a"), ("r/a", "a", None, "lost"), ("r/b", "b", None, "lost")], kind)
    assert sorted(r.content for r in store.upsert_chunks(old, new).collect()) == ["new a", "old b"]


def test_metric_items(spark):
    row = spark.createDataFrame(
        [("invoke_model", "t", None, None, 0.123456789, None, "", None, None, None, None, None, "m", 3, "p")],
        "operation string, trace_id string, prompt_tokens long, completion_tokens long, cost_usd double, decision string, decision_reason string, "
        "hallucination_risk_score double, hallucination_risk_level string, composite_risk_score double, composite_risk_level string, "
        "policy_decision string, model_id string, body_len int, pipeline_operation string",
    ).withColumn("called_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    item = store.metric_items(row).first()
    assert item.pk == "OBSERVATORY#invoke_model" and item.sk.endswith("#t") and str(item.cost_usd) == "0.12345679"
    assert (item.decision, item.decision_reason, item.policy_gate, item.prompt_tokens) == ("unknown", "none", "unknown", 0)
    assert item.ttl == 1704067200 + 90 * 86400
