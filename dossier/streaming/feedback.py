"""Structured Streaming: answers adjust routing weights as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier import constants as K
from dossier.operators import routing as W
from dossier.sources.store import Store


def feedback_stream(store: Store, answers: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold each micro-batch of ``strategy, question_type, confidence, seq`` into the stored weights.

    The batch fold is the one used on tables. The number of the last batch applied is the
    tag of the weights' version, written in one step with it, so a replayed batch is skipped.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if int(store.tag("routing_weights") or -1) < batch_id:
            store.replace("routing_weights", W.apply_feedback(store.read("routing_weights"), rows), tag=str(batch_id))

    writer = answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- Replay on state --------------------------------------------------------

REPLAY_OUT = "question_type string, seq long, strategy string, weight double"
REPLAY_STATE = "weights array<int>, counts array<bigint>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kind = key[0]
    saved = state.getOption
    now = W.ReplayState(list(saved[0]), list(saved[1])) if saved else W.ReplayState(W.start_weights(kind))
    for rows in _in_order(batches):
        picked, weights = [], []
        for confidence in rows["confidence"]:
            at = now.choice()
            picked.append(K.STRATEGY_PRIORITY[at])
            weights.append(now.weights[at] / 100)
            if confidence >= K.REINFORCE_THRESHOLD:
                now.run(round(K.REINFORCE_DELTA * 100), 1)
            elif confidence < K.PENALISE_THRESHOLD:
                now.run(round(K.PENALISE_DELTA * 100), 1)
        yield pd.DataFrame({"question_type": kind, "seq": rows["seq"], "strategy": picked, "weight": weights})
    state.update(([int(w) for w in now.weights], [int(c) for c in now.counts]))


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one micro-batch and key in order; the trigger's file limit bounds them."""
    parts = list(batches)
    if parts:
        yield pd.concat(parts).sort_values("seq")


def replay_stream(answers: DataFrame) -> DataFrame:
    """The strategy chosen for each arriving question, on weights learnt from all before it."""
    return answers.groupBy("question_type").applyInPandasWithState(
        _advance, REPLAY_OUT, REPLAY_STATE, "append", GroupStateTimeout.NoTimeout
    )
