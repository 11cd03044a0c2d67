"""HTTP request bodies: parsing and validation, as columns and for one event."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import text as T

REQUEST_TYPE = (
    "question string, topK string, top_k string, includeGraphExpansion string, minConfidence string, questionType string"
)


@dataclass
class QueryRequest:
    question: str
    top_k: int = K.DEFAULT_TOP_K
    include_graph_expansion: bool = True
    min_confidence: float = K.DEFAULT_MIN_CONFIDENCE
    question_type: str | None = None

    @classmethod
    def from_dict(cls, body: dict) -> QueryRequest:
        try:
            top_k = int(body.get("topK", body.get("top_k", K.DEFAULT_TOP_K)))
        except (ValueError, TypeError) as problem:
            raise BadRequest("Invalid topK") from problem
        return cls(
            question=body.get("question", ""),
            top_k=top_k,
            include_graph_expansion=bool(body.get("includeGraphExpansion", True)),
            min_confidence=float(body.get("minConfidence", K.DEFAULT_MIN_CONFIDENCE)),
            question_type=body.get("questionType"),
        )


class BadRequest(ValueError):
    """A request that is answered with status 400."""


def parse_event(event: dict) -> QueryRequest:
    raw = event.get("body") or ""
    try:
        if event.get("isBase64Encoded"):
            raw = base64.b64decode(raw).decode("utf-8")
        body = json.loads(raw) if raw.strip() else {}
        question = body.get("question", "").strip()
        request = QueryRequest.from_dict(body) if question else None
    except BadRequest:
        raise
    except (ValueError, TypeError, AttributeError) as problem:
        raise BadRequest("Invalid request") from problem
    if request is None:
        raise BadRequest("Invalid request")
    if len(request.question) > K.MAX_QUESTION_CHARS:
        raise BadRequest("Question too long")
    if not 1 <= request.top_k <= K.MAX_TOP_K:
        raise BadRequest("Invalid topK")
    return request


def parse_requests(events: DataFrame, body: str = "body", encoded: str = "is_base64") -> DataFrame:
    """Request rows with their parsed fields and ``problem`` (null when the request is valid)."""
    raw = F.when(F.col(encoded), F.unbase64(body).cast("string")).otherwise(F.col(body))
    r = F.from_json(raw, REQUEST_TYPE)
    parsed = events.withColumn("r", r).select(
        *events.columns,
        F.col("r.question").alias("question"),
        F.when(F.coalesce("r.topK", "r.top_k").isNull(), K.DEFAULT_TOP_K)
        .otherwise(F.coalesce("r.topK", "r.top_k").try_cast("int")).alias("top_k"),
        F.coalesce(F.col("r.includeGraphExpansion").try_cast("boolean"), F.lit(True)).alias("include_graph"),
        F.coalesce(F.col("r.minConfidence").try_cast("double"), F.lit(K.DEFAULT_MIN_CONFIDENCE)).alias("min_confidence"),
        F.col("r.questionType").alias("question_type"),
    )
    blank = F.coalesce(T.strip(F.col("question")), F.lit("")) == ""
    problem = (
        F.when(blank, "Invalid request")
        .when(F.length("question") > K.MAX_QUESTION_CHARS, "Question too long")
        .when(F.col("top_k").isNull() | ~F.col("top_k").between(1, K.MAX_TOP_K), "Invalid topK")
    )
    return parsed.withColumn("problem", problem)
