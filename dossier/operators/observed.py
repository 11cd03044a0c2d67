"""Observed model calls: every call gives its answer and a record of the call.

The Arrow task that calls the model returns both in one struct; the rows are written once, so that no retry calls a
model anew for the record's sake, and then fall apart into answers and records. Records are appended to a sink whose failures
are logged and otherwise ignored: they never cost an answer. Errors of the model itself pass on, unless the caller has
another way to answer and asks for null instead.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.evidence import Generator
from dossier.session import materialize

log = logging.getLogger(__name__)

CALL_TYPE = (
    "operation string, called_at timestamp, trace_id string, prompt_tokens long, completion_tokens long, cost_usd double, decision string, "
    "decision_reason string, hallucination_risk_score double, hallucination_risk_level string, composite_risk_score double, "
    "composite_risk_level string, policy_decision string, model_id string, body_len long, pipeline_operation string, source string"
)
CALL_FIELDS = [part.split()[0] for part in CALL_TYPE.split(", ")]
Sink = Callable[[DataFrame], None]


class Meter(Protocol):
    """What is known about a call: any of CALL_FIELDS, the rest stays null."""

    def measure(self, model_id: str, prompt: str, reply: str | None) -> dict: ...


class WordMeter:
    """Counts words as tokens at a price per thousand; it judges nothing."""

    def __init__(self, price: float = 0.0):
        self.price = price

    def measure(self, model_id: str, prompt: str, reply: str | None) -> dict:
        asked, said = len(prompt.split()), len((reply or "").split())
        return {"prompt_tokens": asked, "completion_tokens": said, "cost_usd": self.price * (asked + said) / 1000}


def observed(rows: DataFrame, prompt: str, system: str, model: Generator, pipeline_operation: str, source: str = "model", meter: Meter | None = None,
             operation: str = "invoke_model", null_on_error: bool = False, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """The rows with the model's reply in `raw`, and the records of the calls (CALL_TYPE), one per row.

    A null prompt is not sent and has a null reply and no record.
    """
    meter = meter or WordMeter()

    def call(prompts: pd.Series) -> pd.DataFrame:
        sent = [p for p in prompts if p is not None]
        try:
            replies = iter(model.generate(system, sent) if sent else [])
        except Exception as problem:
            if not null_on_error:
                raise
            log.warning("model call failed: %s", problem)
            replies = iter([None] * len(sent))
        out = []
        for text in prompts:
            reply = next(replies) if text is not None else None
            record = {
                "operation": operation, "called_at": datetime.now(timezone.utc).replace(tzinfo=None), "trace_id": uuid.uuid4().hex, "model_id": model.model_id,
                "body_len": len(text), "pipeline_operation": pipeline_operation, "source": source, **meter.measure(model.model_id, text, reply),
            } if text is not None else {}
            out.append((reply, *(record.get(f) for f in CALL_FIELDS)))
        found = pd.DataFrame(out, columns=[raw, *CALL_FIELDS], dtype=object)
        found["called_at"] = pd.to_datetime(found["called_at"])
        return found

    both = materialize(rows.withColumn("call", F.pandas_udf(call, f"{raw} string, {CALL_TYPE}")(F.col(prompt))))
    answers = both.select(*rows.columns, F.col(f"call.{raw}").alias(raw))
    return answers, both.where("call.operation is not null").select(*[f"call.{f}" for f in CALL_FIELDS])


def record(calls: DataFrame, sink: Sink | None) -> bool:
    """Append the records; False without a sink, and where the sink fails, which is logged and swallowed."""
    if sink is None:
        return False
    try:
        sink(calls)
        return True
    except Exception as problem:
        log.warning("call records were not written: %s", problem)
        return False
