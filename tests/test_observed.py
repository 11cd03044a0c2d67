"""Model calls and their records."""

import logging
import time

import pytest
from pyspark.sql import functions as F

from dossier.functions import questions as Q
from dossier.functions import vectors as V
from dossier.operators import observed as M
from dossier.operators import routing as W
from dossier.operators.routing import WEIGHTS_TYPE
from dossier.plans import answer as P
from dossier.sources.store import Store


def model_of(reply, name="m"):
    class Model:
        model_id = name

        def generate(self, system, prompts):
            if reply == "fail":
                raise RuntimeError("invoke failed")
            return [None if reply is None else f"{system} {reply} {p}" for p in prompts]

    return Model()


def meter_of(**fields):
    class Meter:
        def measure(self, model_id, prompt, reply):
            return fields

    return Meter()


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(1, "one two"), (2, "three"), (3, None), (4, "")], "qid long, prompt string").repartition(2)


def test_answers_come_back_and_every_call_has_a_record(prompts):
    answers, calls = M.observed(prompts, "prompt", "sys", model_of("says"), "synthesize_answer", "synthesis")
    assert {r.qid: r.raw for r in answers.collect()} == {1: "sys says one two", 2: "sys says three", 3: None, 4: "sys says "}
    rows = {r.body_len: r for r in calls.collect()}
    assert sorted(rows) == [0, 5, 7] and len({r.trace_id for r in rows.values()}) == 3
    assert rows[7].prompt_tokens == 2 and rows[7].completion_tokens == 4 and rows[7].model_id == "m" and rows[7].source == "synthesis"
    again = {r.trace_id for r in calls.collect()}
    assert again == {r.trace_id for r in rows.values()}  # reading twice calls no model twice


def test_item_shape(spark, prompts, tmp_path):
    fields = {"trace_id": "trace-123", "prompt_tokens": 11, "completion_tokens": 22, "cost_usd": 0.0123, "decision": "allow", "decision_reason": "ok"}
    _, calls = M.observed(prompts.where("qid = 1"), "prompt", "", model_of("x", "large"), "synthesize_answer", meter=meter_of(**fields))
    store = Store(spark, str(tmp_path))
    assert M.record(calls, store.append_calls)
    item = store.call_items().first()
    assert item.pk == "OBSERVATORY#invoke_model" and item.operation == "invoke_model" and item.pipeline_operation == "synthesize_answer"
    assert item.trace_id == "trace-123" and item.sk.endswith("#trace-123") and item.decision == "allow" and item.decision_reason == "ok"
    assert (item.prompt_tokens, item.completion_tokens, float(item.cost_usd)) == (11, 22, 0.0123)
    assert item.hallucination_risk_level == "unknown" and item.policy_gate == "unknown" and item.model_id == "large" and item.body_len == 7


def test_records_are_appended(spark, prompts, tmp_path):
    store = Store(spark, str(tmp_path))
    for _ in range(2):
        M.record(M.observed(prompts, "prompt", "", model_of("x"), "a")[1], store.append_calls)
    assert store.call_items().count() == 6


def test_nothing_is_written_without_a_sink(prompts):
    answers, calls = M.observed(prompts, "prompt", "", model_of("x"), "a")
    assert M.record(calls, None) is False and answers.count() == 4


def test_sink_failures_are_swallowed(prompts, caplog):
    def broken(calls):
        raise OSError("no such table")

    answers, calls = M.observed(prompts, "prompt", "", model_of("x"), "a")
    with caplog.at_level(logging.WARNING):
        assert M.record(calls, broken) is False
    assert "no such table" in caplog.text and answers.count() == 4


def test_items_expire_after_about_ninety_days(spark, prompts, tmp_path):
    before, store = int(time.time()), Store(spark, str(tmp_path))
    M.record(M.observed(prompts, "prompt", "", model_of("x"), "a")[1], store.append_calls)
    assert all(89 * 86_400 <= r.ttl - before <= 91 * 86_400 for r in store.call_items().collect())


def test_model_errors_pass_on_or_become_null(prompts):
    with pytest.raises(Exception, match="invoke failed"):
        M.observed(prompts, "prompt", "", model_of("fail"), "a")
    answers, calls = M.observed(prompts, "prompt", "", model_of("fail"), "a", null_on_error=True)
    assert {r.raw for r in answers.collect()} == {None} and calls.count() == 3


@pytest.mark.parametrize("said, wanted", [(" Credential.\n", "credential"), ("poetry", "architecture"), (None, "architecture"), ("fail", "architecture")])
def test_classifier_answers_or_patterns_decide(spark, tmp_path, said, wanted):
    class Model:
        model_id = "small"

        def generate(self, system, prompts):
            if said == "fail":
                raise RuntimeError("down")
            assert all(p.endswith("?") for p in prompts)
            return [said] * len(prompts)

    store = Store(spark, str(tmp_path))
    rows = [(1, "How is the system architecture designed?", None), (2, "Anything else?", "project")]
    asked = spark.createDataFrame(rows, "qid long, question string, question_type string")
    weights = W.seed(spark.createDataFrame([], WEIGHTS_TYPE))
    got = {r.qid: r.question_type for r in P.prepare(asked, weights, V.HashingEmbedder(16), Model(), store.append_calls).collect()}
    assert got == {1: wanted, 2: "project"}
    items = store.call_items().collect()
    assert [(r.pipeline_operation, r.model_id) for r in items] == [("classify_question", "small")]  # a given type asks no model


def test_classification_prompt_ends_with_the_question(spark):
    assert spark.range(1).select(Q.classification_prompt(F.lit("Who?"))).first()[0].endswith("Question: Who?")
