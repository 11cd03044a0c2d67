"""Queries over experiment results; each event is one asked question."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import experiment as E
from dossier.plans.catalog.base import case_list, plain, portable, query

KINDS = [f"'{t}'" for t in K.QUESTION_TYPES]
RESULTS = f"""
SELECT event_id AS index, CASE event_type WHEN 'signup' THEN 'skill_depth' WHEN 'error' THEN 'architecture' WHEN 'click' THEN 'project'
    WHEN 'view' THEN 'comparison' ELSE 'credential' END AS declared_type, props AS question,
  CASE WHEN user_id % 9 = 0 THEN NULL ELSE {case_list('user_id', KINDS)} END AS classified_type,
  CASE WHEN user_id % 13 = 0 THEN NULL ELSE {case_list('user_id', [f"'{s}'" for s in K.STRATEGY_PRIORITY])} END AS routing_decision,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(least(value / 100, 1.0) AS DOUBLE) END AS confidence,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS latency_ms,
  CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 17 = 0 THEN 'timeout' END AS error,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'RAG' WHEN 2 THEN 'RAG,serverless' ELSE 'retry,user ' || CAST(user_id AS STRING) END AS patterns
FROM {{events}}
"""
ACTED = f"""r AS ({plain(RESULTS)}),
a AS (SELECT *, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.70::DOUBLE THEN 'reinforce' WHEN confidence < 0.40::DOUBLE THEN 'penalise'
  ELSE 'neutral' END AS act FROM r), ok AS (SELECT * FROM a WHERE status = 'ok')"""
R, P, N = ("count(*) FILTER (act = 'reinforce')", "count(*) FILTER (act = 'penalise')", "count(*)")


def sql_pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(100 * ({a}) / ({b})::DOUBLE, 1) ELSE 0 END"


def results(spark, sf_dir):
    rows = portable(spark, sf_dir, RESULTS)
    listed = F.filter(F.split("patterns", ","), lambda x: x != "")
    return E.with_feedback(
        rows.withColumn("repeated_patterns", listed).withColumn("graph_entities_used", listed).drop("patterns")
    )


@query("o114_totals", f"""
WITH {ACTED} SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS succeeded,
  {sql_pct("count(*) FILTER (status = 'ok')", "count(*)")} AS success_pct, count(*) FILTER (status = 'error') AS failed FROM a
""")
def totals(spark, sf_dir):
    return E.totals(results(spark, sf_dir))


@query("o115_feedback_actions", f"""
WITH {ACTED} SELECT index, act AS feedback_action, CASE act WHEN 'reinforce' THEN 0.05::DOUBLE WHEN 'penalise' THEN -0.02::DOUBLE ELSE 0 END AS feedback_delta FROM a
""")
def feedback_actions(spark, sf_dir):
    return results(spark, sf_dir).select("index", "feedback_action", "feedback_delta")


@query("o116_action_breakdown", f"""
WITH {ACTED}, c AS (SELECT {R} AS r, {P} AS p, count(*) FILTER (act = 'neutral') AS n, count(*) AS t FROM ok)
SELECT r AS reinforced, p AS penalised, n AS neutral, {sql_pct('r', 't')} AS reinforced_pct, {sql_pct('p', 't')} AS penalised_pct,
  {sql_pct('n', 't')} AS neutral_pct, round(r * 0.05::DOUBLE + p * -0.02::DOUBLE, 6) AS net_delta,
  round(CASE WHEN p > 0 THEN r / p::DOUBLE END, 6) AS ratio,
  CASE WHEN p = 0 THEN NULL WHEN r / p::DOUBLE >= 2.5 THEN 'OK' ELSE 'BELOW BREAK-EVEN' END AS status FROM c
""")
def action_breakdown(spark, sf_dir):
    return E.action_breakdown(results(spark, sf_dir))


PAIRS = f"""pairs AS (SELECT *, CASE WHEN net_delta < 0 THEN 'ERODING' WHEN penalised > 0 AND reinforced / penalised::DOUBLE < 2.5 THEN 'at-risk' ELSE '' END AS flag
  FROM (SELECT *, round(reinforced * 0.05::DOUBLE + penalised * -0.02::DOUBLE, 6) AS net_delta FROM (
    SELECT coalesce(routing_decision, 'unknown') AS strategy, coalesce(classified_type, declared_type) AS question_type,
      {R} AS reinforced, {P} AS penalised, count(*) FILTER (act NOT IN ('reinforce', 'penalise')) AS other FROM ok GROUP BY 1, 2) x) y)"""


@query("o117_pair_pressure", f"WITH {ACTED}, {PAIRS} SELECT * FROM pairs")
def pair_pressure(spark, sf_dir):
    return E.pair_pressure(results(spark, sf_dir))


@query("o118_confidence_stats", f"""
WITH {ACTED} SELECT round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
  {P} AS below_penalise, {sql_pct(P, N)} AS below_pct, {R} AS above_reinforce, {sql_pct(R, N)} AS above_pct FROM ok WHERE confidence IS NOT NULL
""")
def confidence_stats(spark, sf_dir):
    return E.confidence_stats(results(spark, sf_dir))


@query("o119_latency_stats", f"""
WITH {ACTED}, l AS (SELECT list_sort(list(latency_ms)) AS v FROM ok WHERE latency_ms IS NOT NULL)
SELECT round(list_avg(v), 6) AS avg_ms, v[CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_ms, v[1] AS min_ms, v[-1] AS max_ms FROM l
""")
def latency_stats(spark, sf_dir):
    return E.latency_stats(results(spark, sf_dir))


@query("o120_classifier_accuracy", f"""
WITH {ACTED} SELECT declared_type, count(*) FILTER (classified_type = declared_type) AS correct, count(*) AS asked,
  {sql_pct("count(*) FILTER (classified_type = declared_type)", N)} AS accuracy_pct FROM ok GROUP BY 1
""")
def classifier_accuracy(spark, sf_dir):
    return E.classifier_accuracy(results(spark, sf_dir))


@query("o121_strategy_distribution", f"""
WITH {ACTED} SELECT coalesce(routing_decision, 'unknown') AS strategy, count(*) AS answers,
  {sql_pct(N, "(SELECT count(*) FROM ok)")} AS share_pct FROM ok GROUP BY 1
""")
def strategy_distribution(spark, sf_dir):
    return E.strategy_distribution(results(spark, sf_dir))


@query("o121_strategy_confidence", f"""
WITH {ACTED} SELECT coalesce(routing_decision, 'unknown') AS strategy, round(avg(confidence), 6) AS avg_confidence, {R} AS reinforced, {P} AS penalised,
  round(CASE WHEN {P} > 0 THEN {R} / ({P})::DOUBLE END, 6) AS ratio, coalesce(CASE WHEN {P} > 0 THEN {R} / ({P})::DOUBLE < 2.5 END, false) AS under_pressure
FROM ok WHERE confidence IS NOT NULL GROUP BY 1
""")
def strategy_confidence(spark, sf_dir):
    return E.strategy_confidence(results(spark, sf_dir))


@query("o122_type_by_strategy", f"""
WITH {ACTED} SELECT declared_type, {', '.join(f"count(*) FILTER (coalesce(routing_decision, 'unknown') = '{s}') AS {s}" for s in K.STRATEGY_PRIORITY + ['unknown'])}
FROM ok GROUP BY 1
""")
def type_by_strategy(spark, sf_dir):
    return E.type_by_strategy(results(spark, sf_dir))


@query("o123_graph_usage", f"""
WITH {ACTED}, n AS (SELECT CASE WHEN patterns = '' THEN 0 ELSE len(string_split(patterns, ',')) END AS n FROM ok)
SELECT count(*) FILTER (n > 0) AS with_graph, count(*) AS answered, round(avg(n) FILTER (n > 0), 6) AS avg_entities FROM n
""")
def graph_usage(spark, sf_dir):
    return E.graph_usage(results(spark, sf_dir))


@query("o124_erosion", f"""
WITH {ACTED}, {PAIRS} SELECT strategy, question_type, net_delta, reinforced, penalised, CAST(floor(penalised * 2.5 + 1) AS BIGINT) AS needed_to_recover
FROM pairs WHERE net_delta < 0
""")
def erosion(spark, sf_dir):
    return E.erosion(E.pair_pressure(results(spark, sf_dir)))


@query("o125_top_patterns", f"""
WITH {ACTED} SELECT pattern, count(*) AS seen FROM (SELECT unnest(string_split(patterns, ',')) AS pattern FROM ok WHERE patterns <> '') x
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5
""")
def top_patterns(spark, sf_dir):
    return E.top_patterns(results(spark, sf_dir))


@query("o126_running_check", f"""
WITH {ACTED}, c AS (SELECT row_number() OVER w AS n, sum((act = 'reinforce')::BIGINT) OVER w AS r, sum((act = 'penalise')::BIGINT) OVER w AS p
  FROM ok WINDOW w AS (ORDER BY index ROWS UNBOUNDED PRECEDING))
SELECT n AS completed, r::BIGINT AS reinforced, p::BIGINT AS penalised, (n - r - p)::BIGINT AS neutral, round(r * 0.05::DOUBLE + p * -0.02::DOUBLE, 6) AS net_delta,
  round(CASE WHEN p > 0 THEN r / p::DOUBLE END, 6) AS ratio, coalesce(CASE WHEN p > 0 THEN r / p::DOUBLE < 2.5 END, false) AS below_break_even
FROM c WHERE n % 10 = 0
""")
def running_check(spark, sf_dir):
    return E.running_check(results(spark, sf_dir))


@query("o127_pending_questions", f"""
WITH {ACTED} SELECT index, declared_type FROM r WHERE declared_type IN ('project', 'architecture') AND status <> 'ok'
""")
def pending_questions(spark, sf_dir):
    rows = results(spark, sf_dir)
    done = E.succeeded(rows)
    return E.pending_questions(rows.select("index", "declared_type"), done, ["project", "architecture"])


@query("o127_errors", f"WITH {ACTED} SELECT index, substr(question, 1, 60) AS question, error FROM r WHERE status = 'error'")
def errors(spark, sf_dir):
    return E.errors(results(spark, sf_dir))


RUNS = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'partial' ELSE 'TIMED_OUT' END AS status FROM {orders}
"""


@query("o129_ingestion_rollup", f"""
SELECT CASE WHEN status IN ('SUCCEEDED', 'success') THEN 'ok' WHEN status = 'partial' THEN 'partial' ELSE 'failed' END AS outcome, count(*) AS runs
FROM ({plain(RUNS)}) r GROUP BY 1
""")
def ingestion_rollup(spark, sf_dir):
    return E.ingestion_rollup(portable(spark, sf_dir, RUNS))
