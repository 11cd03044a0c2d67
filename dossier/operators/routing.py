"""Strategy routing: weights, selection, feedback, replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import ordered as O

WEIGHTS_TYPE = (
    "strategy string, question_type string, weight double, feedback_count bigint, seeded boolean, reset_at timestamp"
)


def priors(spark: SparkSession) -> DataFrame:
    """The 24 prior weights."""
    rows = [
        (strategy, kind, weight)
        for kind, weights in K.ROUTING_PRIORS.items()
        for strategy, weight in weights.items()
    ]
    return spark.createDataFrame(rows, "strategy string, question_type string, weight double")


def prior_weight(strategy: Column, question_type: Column) -> Column:
    """Prior of a pair as an expression; 0.5 for a pair without one."""
    table = F.create_map(*[
        F.lit(x)
        for kind, weights in K.ROUTING_PRIORS.items()
        for strategy_, weight in weights.items()
        for x in (f"{strategy_}|{kind}", weight)
    ])
    return F.coalesce(F.element_at(table, F.concat_ws("|", strategy, question_type)), F.lit(K.UNKNOWN_PRIOR))


def priority(strategy: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in K.STRATEGY_PRIORITY]), strategy)


def seed(stored: DataFrame) -> DataFrame:
    """Add prior rows that are missing; stored rows stay as they are."""
    fresh = priors(stored.sparkSession).select(
        "*", F.lit(0).cast("long").alias("feedback_count"), F.lit(True).alias("seeded"),
        F.lit(None).cast("timestamp").alias("reset_at"),
    )
    return stored.unionByName(fresh.join(stored, ["strategy", "question_type"], "left_anti"))


def reset(stored: DataFrame, at: Column) -> DataFrame:
    """Stored pairs that have a prior go back to it."""
    prior = priors(stored.sparkSession).withColumnRenamed("weight", "prior")
    joined = stored.join(F.broadcast(prior), ["strategy", "question_type"], "left")
    known = F.col("prior").isNotNull()
    return joined.select(
        "strategy", "question_type", F.coalesce("prior", "weight").alias("weight"),
        F.when(known, 0).otherwise(F.col("feedback_count")).cast("long").alias("feedback_count"), "seeded",
        F.when(known, at).otherwise(F.col("reset_at")).alias("reset_at"),
    )


def listing(weights: DataFrame, question_type: str | None = None) -> DataFrame:
    rows = weights if question_type is None else weights.where(F.col("question_type") == question_type)
    return rows.select(
        "question_type", "strategy", "weight", F.coalesce("feedback_count", F.lit(0)).alias("feedback_count")
    ).orderBy("question_type", F.desc("weight"), "strategy")


def strategy_weights(question_types: DataFrame, stored: DataFrame) -> DataFrame:
    """Every type with each strategy's weight: stored rows of the type if it has any, else priors.

    A stored type lacking a strategy gives that strategy weight 0, so it is never chosen.
    """
    every = question_types.select("question_type").distinct().withColumn(
        "strategy", F.explode(F.array(*[F.lit(s) for s in K.STRATEGY_PRIORITY]))
    )
    has_any = stored.select("question_type").distinct().withColumn("stored", F.lit(True))
    return (
        every.join(stored.select("strategy", "question_type", "weight"), ["strategy", "question_type"], "left")
        .join(has_any, "question_type", "left")
        .select(
            "question_type", "strategy",
            F.coalesce(
                "weight",
                F.when(F.col("stored"), F.lit(0.0)).otherwise(prior_weight(F.col("strategy"), F.col("question_type"))),
            ).alias("weight"),
        )
    )


def select_strategy(weights: DataFrame) -> DataFrame:
    """Best strategy per question type and the switches it implies."""
    best = weights.groupBy("question_type").agg(
        F.max_by(F.struct("strategy", "weight"), F.struct("weight", -priority(F.col("strategy")))).alias("b")
    )
    return with_switches(best.select(
        "question_type", F.col("b.strategy").alias("strategy"), F.col("b.weight").alias("strategy_confidence")
    ))


def with_switches(chosen: DataFrame) -> DataFrame:
    strategy = F.col("strategy")
    return (
        chosen.withColumn("include_graph", strategy.isin("graph_first", "hybrid"))
        .withColumn("boost_keywords", strategy.isin("keyword_boosted", "hybrid"))
        .withColumn("use_secondary", strategy == "hybrid")
    )


# -- Feedback ---------------------------------------------------------------

def feedback_action(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), "unknown")
        .when(confidence >= K.REINFORCE_THRESHOLD, "reinforce")
        .when(confidence < K.PENALISE_THRESHOLD, "penalise")
        .otherwise("neutral")
    )


def feedback_delta(confidence: Column) -> Column:
    return (
        F.when(confidence >= K.REINFORCE_THRESHOLD, K.REINFORCE_DELTA)
        .when(confidence < K.PENALISE_THRESHOLD, K.PENALISE_DELTA)
        .otherwise(0.0)
    )


def apply_feedback(stored: DataFrame, feedback: DataFrame, seq: str = "seq") -> DataFrame:
    """Apply ordered feedback ``(strategy, question_type, confidence, seq)`` to stored weights.

    Neutral answers drop out first; the rest fold in blocks (see ``operators.ordered``).
    """
    moves = feedback.withColumn("delta", feedback_delta(F.col("confidence"))).where(F.col("delta") != 0)
    folded = O.clamp_fold(moves, seq, "delta", ["strategy", "question_type"])
    joined = stored.join(folded, ["strategy", "question_type"], "left")
    changed = F.col("n").isNotNull()
    weight = O.apply_clamp(F.col("weight"), F.col("d"), F.col("lo"), F.col("hi"))
    return joined.select(
        "strategy", "question_type", F.when(changed, weight).otherwise(F.col("weight")).alias("weight"),
        (F.coalesce("feedback_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("feedback_count"),
        *[c for c in stored.columns if c not in ("strategy", "question_type", "weight", "feedback_count")],
    )


# -- Replay -----------------------------------------------------------------

def feedback_runs(answers: DataFrame, seq: str = "seq", bits: int = O.BITS) -> DataFrame:
    """Runs of equal moves: ``question_type, first_seq, delta, times``.

    Neutral answers move nothing and are dropped. Runs are found within blocks of the order
    key, so a run crossing a block is simply two runs.
    """
    moves = (
        answers.withColumn("delta", feedback_delta(F.col("confidence"))).where(F.col("delta") != 0)
        .withColumn("block", F.shiftright(F.col(seq).cast("long"), bits))
    )
    order = Window.partitionBy("question_type", "block").orderBy(seq)
    starts = F.when(F.lag("delta").over(order) == F.col("delta"), 0).otherwise(1)
    return (
        moves.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
        .groupBy("question_type", "block", "run")
        .agg(F.min(seq).alias("first_seq"), F.first("delta").alias("delta"), F.count(F.lit(1)).alias("times"))
        .select("question_type", "first_seq", "delta", "times")
    )


class ReplayState:
    """Weights of one question type, in hundredths so that ties are exact."""

    FLOOR, CEIL = round(K.WEIGHT_FLOOR * 100), round(K.WEIGHT_CEIL * 100)

    def __init__(self, weights: list[int], counts: list[int] | None = None):
        self.weights = list(weights)
        self.counts = list(counts or [0] * len(weights))

    def choice(self) -> int:
        return self.weights.index(max(self.weights))

    def run(self, step: int, times: int) -> None:
        """Apply ``times`` moves of ``step`` hundredths, each to the strategy best at that moment."""
        if step > 0:
            at = self.choice()  # a reinforced best strategy stays best
            self.weights[at] = min(self.CEIL, self.weights[at] + step * times)
            self.counts[at] += times
            return
        while times:
            at = self.choice()
            if self.weights[at] == self.FLOOR:
                self.counts[at] += times  # all at the floor: nothing moves any more
                return
            self.weights[at] = max(self.FLOOR, self.weights[at] + step)
            self.counts[at] += 1
            times -= 1


def start_weights(question_type: str) -> list[int]:
    known = K.ROUTING_PRIORS.get(question_type, {})
    return [round(known.get(s, K.UNKNOWN_PRIOR) * 100) for s in K.STRATEGY_PRIORITY]


def replay(answers: DataFrame, seq: str = "seq") -> DataFrame:
    """Select, answer, feed back, in order, per question type: the weights at the end.

    Which weight a move touches depends on all moves before it, so one type is one sequence.
    Only its runs are streamed, in order, through a constant-size state.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, state = None, None
        for batch in batches:
            for q, delta, times in zip(batch["question_type"], batch["delta"], batch["times"]):
                if q != kind:
                    if state is not None:
                        yield _state_rows(kind, state)
                    kind, state = q, ReplayState(start_weights(q))
                state.run(round(delta * 100), int(times))
        if state is not None:
            yield _state_rows(kind, state)

    runs = feedback_runs(answers, seq)
    return runs.repartition("question_type").sortWithinPartitions("question_type", "first_seq").mapInPandas(
        walk, "question_type string, strategy string, weight double, feedback_count bigint"
    )


def _state_rows(kind: str, state: ReplayState) -> pd.DataFrame:
    return pd.DataFrame({
        "question_type": kind, "strategy": K.STRATEGY_PRIORITY,
        "weight": [w / 100 for w in state.weights], "feedback_count": state.counts,
    })


def most_reinforced(weights: DataFrame, limit: int = 20) -> DataFrame:
    return (
        weights.where(F.col("feedback_count") > 0)
        .select("strategy", "question_type", "weight", F.col("feedback_count").alias("total_feedback"))
        .orderBy(F.desc("total_feedback"), "strategy", "question_type").limit(limit)
    )
