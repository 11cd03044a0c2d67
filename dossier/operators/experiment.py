"""Analytics over experiment results.

A result row: ``index, declared_type, question, classified_type, routing_decision, confidence,
feedback_action, feedback_delta, retrieval_count, graph_entities_used, inferred_skills,
repeated_patterns, latency_ms, status, error, answer_preview``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import ordered as O
from dossier.operators.routing import feedback_action, feedback_delta


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, 1)).otherwise(0.0)


def with_feedback(results: DataFrame) -> DataFrame:
    confidence = F.col("confidence")
    return results.withColumn("feedback_action", feedback_action(confidence)).withColumn(
        "feedback_delta", feedback_delta(confidence)
    )


def succeeded(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "ok")


def strategy() -> Column:
    return F.coalesce("routing_decision", F.lit("unknown"))


def totals(results: DataFrame) -> DataFrame:
    ok = count_when(F.col("status") == "ok")
    return results.agg(
        F.count(F.lit(1)).alias("total"), ok.alias("succeeded"), percent(ok, F.count(F.lit(1))).alias("success_pct"),
        count_when(F.col("status") == "error").alias("failed"),
    )


def _actions() -> list[Column]:
    action = F.col("feedback_action")
    return [
        count_when(action == "reinforce").alias("reinforced"), count_when(action == "penalise").alias("penalised"),
    ]


def _ratio() -> Column:
    return F.when(F.col("penalised") > 0, F.col("reinforced") / F.col("penalised"))


def action_breakdown(results: DataFrame) -> DataFrame:
    ok = succeeded(results)
    rows = ok.agg(
        *_actions(), count_when(F.col("feedback_action") == "neutral").alias("neutral"),
        F.count(F.lit(1)).alias("answered"),
    )
    r, p = F.col("reinforced"), F.col("penalised")
    return rows.select(
        "reinforced", "penalised", "neutral", percent(r, F.col("answered")).alias("reinforced_pct"),
        percent(p, F.col("answered")).alias("penalised_pct"), percent(F.col("neutral"), F.col("answered")).alias("neutral_pct"),
        F.round(r * K.REINFORCE_DELTA + p * K.PENALISE_DELTA, 6).alias("net_delta"), F.round(_ratio(), 6).alias("ratio"),
        F.when(p == 0, F.lit(None)).when(_ratio() >= K.BREAK_EVEN_RATIO, "OK").otherwise("BELOW BREAK-EVEN").alias("status"),
    )


def pair_pressure(results: DataFrame) -> DataFrame:
    """Per (strategy, question type): actions, net movement, and whether the weight erodes.

    The net is counted from whole moves, so it is exact whatever the row order.
    """
    rows = (
        succeeded(results)
        .groupBy(strategy().alias("strategy"), F.coalesce("classified_type", "declared_type").alias("question_type"))
        .agg(*_actions(), (F.count(F.lit(1)) - count_when(F.col("feedback_action").isin("reinforce", "penalise"))).alias("other"))
    )
    net = F.round(F.col("reinforced") * K.REINFORCE_DELTA + F.col("penalised") * K.PENALISE_DELTA, 6)
    flag = F.when(net < 0, "ERODING").when(_ratio() < K.BREAK_EVEN_RATIO, "at-risk").otherwise("")
    return rows.withColumn("net_delta", net).withColumn("flag", flag)


def erosion(pairs: DataFrame) -> DataFrame:
    need = F.floor(F.col("penalised") * K.BREAK_EVEN_RATIO + 1).cast("long")
    return pairs.where(F.col("net_delta") < 0).select(
        "strategy", "question_type", "net_delta", "reinforced", "penalised", need.alias("needed_to_recover")
    )


def confidence_stats(results: DataFrame) -> DataFrame:
    c = F.col("confidence")
    rows = succeeded(results).where(c.isNotNull())
    low, high, n = count_when(c < K.PENALISE_THRESHOLD), count_when(c >= K.REINFORCE_THRESHOLD), F.count(F.lit(1))
    return rows.agg(
        F.round(F.avg(c), 6).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        low.alias("below_penalise"), percent(low, n).alias("below_pct"), high.alias("above_reinforce"),
        percent(high, n).alias("above_pct"),
    )


def latency_stats(results: DataFrame) -> DataFrame:
    rows = succeeded(results).where(F.col("latency_ms").isNotNull())
    p95 = O.value_at_rank(rows, "latency_ms", lambda n: F.floor(n * F.lit(0.95)))
    v = F.col("latency_ms")
    plain = rows.agg(
        F.round(F.avg(v), 6).alias("avg_ms"), F.min(v).cast("long").alias("min_ms"), F.max(v).cast("long").alias("max_ms")
    )
    return plain.select("avg_ms", p95.scalar().alias("p95_ms"), "min_ms", "max_ms")


def classifier_accuracy(results: DataFrame) -> DataFrame:
    right, n = count_when(F.col("classified_type") == F.col("declared_type")), F.count(F.lit(1))
    return succeeded(results).groupBy("declared_type").agg(
        right.alias("correct"), n.alias("asked"), percent(right, n).alias("accuracy_pct")
    )


def strategy_distribution(results: DataFrame) -> DataFrame:
    counts = succeeded(results).groupBy(strategy().alias("strategy")).agg(F.count(F.lit(1)).alias("answers"))
    whole = counts.agg(F.sum("answers")).scalar()
    return (
        counts.select("strategy", "answers", percent(F.col("answers"), whole).alias("share_pct"))
        .orderBy(F.desc("answers"), "strategy")
    )


def strategy_confidence(results: DataFrame) -> DataFrame:
    c = F.col("confidence")
    rows = succeeded(results).where(c.isNotNull()).groupBy(strategy().alias("strategy")).agg(
        F.round(F.avg(c), 6).alias("avg_confidence"), count_when(c >= K.REINFORCE_THRESHOLD).alias("reinforced"),
        count_when(c < K.PENALISE_THRESHOLD).alias("penalised"),
    )
    return rows.withColumn("ratio", F.round(_ratio(), 6)).withColumn(
        "under_pressure", F.coalesce(_ratio() < K.BREAK_EVEN_RATIO, F.lit(False))
    )


def type_by_strategy(results: DataFrame) -> DataFrame:
    rows = succeeded(results).select("declared_type", strategy().alias("s"))
    return rows.groupBy("declared_type").pivot("s", K.STRATEGY_PRIORITY + ["unknown"]).agg(F.count(F.lit(1))).na.fill(0)


def graph_usage(results: DataFrame) -> DataFrame:
    n = F.size("graph_entities_used")
    return succeeded(results).agg(
        count_when(n > 0).alias("with_graph"), F.count(F.lit(1)).alias("answered"),
        F.round(F.avg(F.when(n > 0, n)), 6).alias("avg_entities"),
    )


def top_patterns(results: DataFrame, limit: int = 5) -> DataFrame:
    rows = succeeded(results).select(F.explode("repeated_patterns").alias("pattern"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("seen")).orderBy(F.desc("seen"), "pattern").limit(limit)


def running_check(results: DataFrame, every: int = 10) -> DataFrame:
    """Cumulative actions after each ``every``-th answered question, in ``index`` order."""
    action = F.col("feedback_action")
    ok = succeeded(results).select(
        "index", F.lit(1).cast("long").alias("completed"), (action == "reinforce").cast("long").alias("reinforced"),
        (action == "penalise").cast("long").alias("penalised"),
    )
    rows = O.running_totals(ok, "index", ["completed", "reinforced", "penalised"]).where(F.col("running_completed") % every == 0)
    r, p = F.col("running_reinforced"), F.col("running_penalised")
    ratio = F.when(p > 0, r / p)
    return rows.select(
        F.col("running_completed").alias("completed"), r.alias("reinforced"), p.alias("penalised"),
        (F.col("running_completed") - r - p).alias("neutral"),
        F.round(r * K.REINFORCE_DELTA + p * K.PENALISE_DELTA, 6).alias("net_delta"), F.round(ratio, 6).alias("ratio"),
        F.coalesce(ratio < K.BREAK_EVEN_RATIO, F.lit(False)).alias("below_break_even"),
    )


def pending_questions(questions: DataFrame, done: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Questions of the wanted types still to be asked (resume from a checkpoint)."""
    rows = questions if types is None else questions.where(F.col("declared_type").isin(types))
    return rows.join(done.select("index"), "index", "left_anti")


def errors(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "error").select("index", F.substring("question", 1, 60).alias("question"), "error")


def ingestion_rollup(runs: DataFrame) -> DataFrame:
    """Ingestion runs by outcome: finished, finished with errors, failed."""
    status = F.col("status")
    outcome = F.when(status.isin("SUCCEEDED", "success"), "ok").when(status == "partial", "partial").otherwise("failed")
    return runs.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))
