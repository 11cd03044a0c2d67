"""Queries over answer assembly and model-call metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import vectors as V
from dossier.operators import evidence as A
from dossier.operators import graph_query as G
from dossier.operators import observed as M
from dossier.operators import retrieval as R
from dossier.operators import routing as W
from dossier.plans import answer as P
from dossier.plans import ingest
from dossier.plans.catalog.base import CORPUS_CTE, case_list, corpus, documents, plain, portable, query, sql_strip, table
from dossier.plans.catalog.graph import AROUND_ALL, stored_graph
from dossier.plans.catalog.routing import PRIOR_ROWS, PRIORITY, SQL_CLASS
from dossier.plans.catalog.retrieval import BASE_CTE, PRIMARY, TOP_K, chunks, questions
from dossier.plans.catalog.text import AWS_RX, PAT_RX, TECH_RX, sql_found
from dossier.session import checkpoint_dir, materialize
from dossier.sources import store

SQL_SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


@query("o103_entity_ids", f"""
WITH {CORPUS_CTE}, e AS ({' UNION ALL '.join(
    f"SELECT repo AS qid, '{kind}_' || unnest({sql_found('content', rx)}) AS v FROM corpus"
    for kind, rx in [("aws_service", AWS_RX), ("technology", TECH_RX), ("pattern", PAT_RX)])}),
d AS (SELECT DISTINCT qid, {SQL_SLUG.format(x='v')} AS entity_id FROM e)
SELECT qid, entity_id FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY entity_id) <= 20
""")
def entity_ids(spark, sf_dir):
    return G.entity_ids(corpus(spark, sf_dir).withColumnRenamed("repo", "qid"))


BLOCKS = f"""sized AS (SELECT qid, question, q_strategy, rank, '[' || rank || '] Source: ' || source_file || ' (authority='
  || CASE WHEN source_weight >= 0.8::DOUBLE THEN 'HIGH' WHEN source_weight >= 0.5::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END
  || ', score=' || printf('%.3f', effective_score) || ')' || chr(10) || {sql_strip('content')} || chr(10) AS block FROM prim),
used AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
blocks AS (SELECT * FROM used WHERE before < 8000)"""


def retrieved(spark, sf_dir):
    return R.retrieve(questions(spark, sf_dir), chunks(spark, sf_dir), TOP_K)


@query("o107_evidence_blocks", f"""
WITH {BASE_CTE}, {PRIMARY}, {BLOCKS} SELECT qid, rank, length(block) AS chars, md5(block) AS block_md5 FROM blocks
""")
def evidence_blocks(spark, sf_dir):
    rows = A.evidence_blocks(retrieved(spark, sf_dir))
    return rows.select("qid", F.col("rank").cast("bigint").alias("rank"), F.length("block").cast("bigint").alias("chars"),
                       F.md5(F.col("block").cast("binary")).alias("block_md5"))


@query("o108_prompt", f"""
WITH {BASE_CTE}, {PRIMARY}, {BLOCKS},
b AS (SELECT qid, any_value(question) AS question, any_value(q_strategy) AS q_strategy, string_agg(block, chr(10) ORDER BY rank) AS blocks FROM blocks GROUP BY qid)
SELECT qid, md5('Question type: ' || q_strategy || chr(10) || chr(10) || '=== RETRIEVED EVIDENCE ===' || chr(10) || chr(10) || blocks || chr(10)
  || CASE WHEN qid % 2 = 0 THEN chr(10) || '=== GRAPH CONTEXT ===' || chr(10) || 'Demonstrated skills: Go, Rust' || chr(10) || 'Architecture patterns: CQRS' || chr(10) ELSE '' END
  || 'Repeated patterns (cross-repo evidence): RAG' || chr(10) || chr(10) || '=== QUESTION ===' || chr(10) || question) AS prompt_md5 FROM b
""")
def prompt(spark, sf_dir):
    q = questions(spark, sf_dir)
    labels = {"skills": ["Go", "Rust"], "patterns": ["CQRS"], "aws_services": [], "repeated_patterns": ["RAG"]}
    context = q.select("qid", (F.col("qid") % 2 == 0).alias("has_person"), *[
        F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in labels.items()
    ])
    text = A.evidence_text(A.evidence_blocks(retrieved(spark, sf_dir)), context)
    message = A.user_message(F.col("strategy"), F.col("evidence"), F.col("question"))
    return q.join(text, "qid").select("qid", F.md5(message.cast("binary")).alias("prompt_md5"))


REPLY_BODY = """'{{"answer": "' || replace(replace(replace(text, chr(92), ' '), '"', ' '), chr(10), ' ') || '", "confidence": 0.' || CAST(1 + turn % 9 AS STRING)
  || ', "inferred_skills": ["Go", "SQL ' || role || '"]' || CASE WHEN turn % 2 = 0 THEN ', "repeated_patterns": ["RAG"]' ELSE '' END || '}}'"""
FENCE_3 = "chr(96) || chr(96) || chr(96)"
REPLIES = f"""
SELECT conv_id, turn, {case_list('conv_id', [
    REPLY_BODY, f"{FENCE_3} || 'json' || chr(10) || {REPLY_BODY} || chr(10) || {FENCE_3}", "text", "'[1, 2]'", "'  ' || text || '  '"])} AS raw
FROM {{conversations}}
"""
# Doubled braces survive Spark's parameter substitution; the checking engine needs them single.
DUCK_REPLIES = plain(REPLIES).replace("{{", "{").replace("}}", "}")
PARSED = f"""t AS (SELECT *, trim(regexp_replace(regexp_replace(trim(raw, ' ' || chr(10)), '(?m)^```(?:json)?\\s*', '', 'g'), '(?m)\\s*```$', '', 'g'), ' ' || chr(10)) AS body
  FROM ({DUCK_REPLIES}) r),
j AS (SELECT *, json_valid(body) AND coalesce(json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT', false) AS ok FROM t),
p AS (SELECT conv_id, turn, raw, CASE WHEN ok THEN json_extract_string(body, '$.answer') ELSE raw END AS answer,
  CASE WHEN ok THEN CAST(json_extract(body, '$.confidence') AS DOUBLE) ELSE 0.5::DOUBLE END AS confidence,
  CASE WHEN ok THEN CAST(json_extract(body, '$.inferred_skills') AS VARCHAR[]) END AS skills,
  CASE WHEN ok THEN CAST(json_extract(body, '$.repeated_patterns') AS VARCHAR[]) END AS patterns FROM j)"""


def parsed_replies(spark, sf_dir):
    return portable(spark, sf_dir, REPLIES).withColumn("reply", A.parse_reply(F.col("raw")))


@query("o109_parse_reply", f"""
WITH {PARSED} SELECT conv_id, turn, answer, round(confidence, 6) AS confidence, array_to_string(skills, ',') AS skills FROM p
""")
def parse_reply(spark, sf_dir):
    return parsed_replies(spark, sf_dir).select(
        "conv_id", "turn", "reply.answer", F.round("reply.confidence", 6).alias("confidence"),
        F.array_join("reply.inferred_skills", ",").alias("skills"),
    )


@query("o110_merge_reply", f"""
WITH {PARSED} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(coalesce(skills, []), ['AWS', 'Go'])))[1:15], ',') AS skills,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(patterns, []), ['CQRS'])))[1:10], ',') AS patterns FROM p
""")
def merge_reply(spark, sf_dir):
    skills, patterns = F.array(F.lit("AWS"), F.lit("Go")), F.array(F.lit("CQRS"))
    none = F.array().cast("array<map<string,string>>")
    rows = parsed_replies(spark, sf_dir).withColumn(
        "m", A.merge_reply(F.col("reply"), F.col("raw"), skills, patterns, none)
    )
    return rows.select("conv_id", "turn", F.array_join("m.inferred_skills", ",").alias("skills"),
                       F.array_join("m.repeated_patterns", ",").alias("patterns"))


@query("o111_extractive_answer", f"""
WITH {BASE_CTE}, {PRIMARY},
l AS (SELECT qid, any_value(question) AS question, string_agg(rank || '. [' || source_file || '] ' || substr(content, 1, 300) || '...', chr(10) ORDER BY rank) AS lines FROM prim WHERE rank <= 3 GROUP BY qid)
SELECT qid, '[No generation model is set: the closest evidence follows]' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10)
  || 'Top retrieved evidence:' || chr(10) || chr(10) || lines AS answer, 0.0::DOUBLE AS confidence FROM l
""")
def extractive_answer(spark, sf_dir):
    rows = A.extractive_answer(questions(spark, sf_dir), retrieved(spark, sf_dir))
    return rows.select("qid", "answer", "confidence")


SEEDED = f"""best AS (SELECT question_type, strategy FROM (VALUES {PRIOR_ROWS}) v(strategy, question_type, weight)
  QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY weight DESC, {PRIORITY}) = 1)"""


# The evidence itself has no SQL; what every response must say has.
@query("o112_answer_batch", f"""
WITH q AS (SELECT item_id AS qid, text AS question FROM benchmark), k AS (SELECT qid, {SQL_CLASS} AS question_type FROM q), {SEEDED}
SELECT qid, question_type, strategy, strategy IN ('graph_first', 'hybrid') AS graph_forced, 'none' AS model_id, FALSE AS cache_hit,
  TRUE AS has_evidence, TRUE AS is_json FROM k JOIN best USING (question_type)
""")
def answer_batch(spark, sf_dir):
    """Questions to full responses over the chunked and embedded documents and the order graph."""
    embedder = V.HashingEmbedder(256)
    docs = documents(spark, sf_dir, "doc_id", "text", "source").select(
        F.concat(F.lit("raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_key"),
        F.concat(F.lit("raw/"), "source", F.lit("/")).alias("repo_prefix"), F.col("text").alias("content"),
    )
    rows = materialize(ingest.chunk_rows(ingest.analyzed_documents(docs), embedder)).withColumnRenamed("id", "chunk_id")
    asked = portable(spark, sf_dir, "SELECT item_id AS qid, text AS question FROM {benchmark}")
    nodes, edges = stored_graph(spark, sf_dir, *AROUND_ALL)
    weights = W.seed(spark.createDataFrame([], W.WEIGHTS_TYPE))
    answers = P.answer_batch(asked, rows, nodes, edges, weights, embedder, min_confidence=0.0)
    body = F.try_parse_json(P.response_json())
    return answers.select(
        "qid", "question_type", "routing_decision.strategy", F.col("routing_decision.graphExpansionForced").alias("graph_forced"), "model_id", "cache_hit",
        F.col("retrieval_count").between(1, K.DEFAULT_TOP_K).alias("has_evidence"),
        (F.try_variant_get(body, "$.answer", "string") == F.col("answer")).alias("is_json"),
    )


CALLS = f"""
SELECT 'invoke_model' AS operation, ts AS called_at, 'trace-' || CAST(event_id AS STRING) AS trace_id, user_id AS prompt_tokens,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS completion_tokens, value / 7 AS cost_usd, event_type AS decision,
  {case_list('event_id', ["''", "'ok'", "NULL"])} AS decision_reason, CASE WHEN event_id % 2 = 0 THEN value / 500 END AS hallucination_risk_score,
  {case_list('event_id', ["'low'", "NULL"])} AS hallucination_risk_level, CAST(NULL AS DOUBLE) AS composite_risk_score,
  CAST(NULL AS STRING) AS composite_risk_level, 'allow' AS policy_decision, 'model-x' AS model_id, length(props) AS body_len,
  'synthesize_answer' AS pipeline_operation FROM {{events}}
"""


@query("o21_metric_items", f"""
WITH c AS ({plain(CALLS)}), s AS (SELECT *, strftime(called_at, '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM c)
SELECT 'OBSERVATORY#' || operation AS pk, stamp || '#' || trace_id AS sk, prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens,
  round(CAST(round(cost_usd, 8) AS DOUBLE), 6) AS cost_usd, decision, coalesce(nullif(decision_reason, ''), 'none') AS decision_reason,
  round(coalesce(hallucination_risk_score, 0), 6) AS hallucination_risk_score, coalesce(hallucination_risk_level, 'unknown') AS hallucination_risk_level,
  'unknown' AS composite_risk_level, policy_decision AS policy_gate, CAST(floor(epoch(called_at)) AS BIGINT) + 7776000 AS ttl FROM s
""")
def metric_items(spark, sf_dir):
    items = store.metric_items(portable(spark, sf_dir, CALLS).withColumn("called_at", F.col("called_at").cast("timestamp")))
    return items.select(
        "pk", "sk", "prompt_tokens", "completion_tokens", F.round(F.col("cost_usd").cast("double"), 6).alias("cost_usd"),
        "decision", "decision_reason",
        F.round(F.col("hallucination_risk_score").cast("double"), 6).alias("hallucination_risk_score"),
        "hallucination_risk_level", "composite_risk_level", "policy_gate", "ttl",
    )


class FirstWords:
    """A model that repeats the first three words of its prompt."""

    def __init__(self, model_id: str):
        self.model_id = model_id

    def generate(self, system: str, prompts: list[str]) -> list[str]:
        return [" ".join(p.split()[:3]) for p in prompts]


@query("o113_calls_by_model", r"""
WITH asked AS (
  SELECT 'small' AS model_id, 'classify_question' AS pipeline_operation, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'large', 'synthesize_answer', text FROM documents
)
SELECT 'invoke_model' AS operation, model_id, pipeline_operation, count(*) AS calls,
  CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS prompt_tokens, CAST(sum(least(3, len(regexp_extract_all(text, '\S+')))) AS BIGINT) AS completion_tokens,
  CAST(sum(length(text)) AS BIGINT) AS body_chars, 'unknown' AS decision, TRUE AS kept_90_days
FROM asked WHERE text IS NOT NULL GROUP BY 1, 2, 3
""")
def calls_by_model(spark, sf_dir):
    """Models are called over whole tables, their records stored as items and read back."""
    target = store.Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/calls/{uuid.uuid4().hex}")
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("text")
    for rows, name, step in [(users, "small", "classify_question"), (table(spark, sf_dir, "documents").select("text"), "large", "synthesize_answer")]:
        _, calls = M.observed(rows, "text", "", FirstWords(name), step)
        M.record(calls, target.append_calls)
    items = target.call_items()
    kept = F.col("ttl") - F.unix_timestamp(F.to_timestamp("timestamp")) == K.METRIC_TTL_SECONDS
    return items.groupBy("operation", "model_id", "pipeline_operation").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("body_len").alias("body_chars"), F.max("decision").alias("decision"), F.bool_and(kept).alias("kept_90_days"),
    )
