"""Answering: a table of questions to a table of responses.

Every step is keyed by question: classes and strategies by joins on small tables, chunks by
one tiled search, near-duplicates by folds over each question's bounded list, graph context
by joins on the labels found in its evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import questions as Q
from dossier.functions import text as T
from dossier.functions import vectors as V
from dossier.operators import cache as C
from dossier.operators import evidence as A
from dossier.operators import graph_query as G
from dossier.operators import observed as M
from dossier.operators import retrieval as R
from dossier.operators import routing as W
from dossier.session import materialize

LABELS = "array<string>"
CLASSIFIER_PROMPT = "You sort questions into types."


def prepare(questions: DataFrame, weights: DataFrame, embedder: V.Embedder, classifier: A.Generator | None = None, sink: M.Sink | None = None) -> DataFrame:
    """Add embedding, class, strategy and its switches, and whether the cache may be used.

    A classifier is asked about questions without a type of their own; where it fails or says something else, patterns decide.
    """
    if "question_type" not in questions.columns:
        questions = questions.withColumn("question_type", F.lit(None).cast("string"))
    said = None
    if classifier is not None:
        open_ = F.coalesce("question_type", F.lit("")) == ""
        asked = questions.withColumn("prompt", F.when(open_, Q.classification_prompt(F.col("question"))))
        questions, calls = M.observed(asked, "prompt", CLASSIFIER_PROMPT, classifier, "classify_question", "classifier", null_on_error=True, raw="said")
        M.record(calls, sink)
        said = F.col("said")
    asked = questions.select(
        "qid", "question", Q.classify(F.col("question"), F.col("question_type"), said).alias("question_type"),
        (~Q.is_time_sensitive(F.col("question"))).alias("cache_allowed"),
        V.embed(F.col("question"), embedder).alias("question_embedding"),
    )
    chosen = W.select_strategy(W.strategy_weights(asked, weights))
    return asked.join(chosen, "question_type")


# -- Graph context ----------------------------------------------------------

def mentioned(results: DataFrame) -> DataFrame:
    """Terms in each question's evidence: ``qid, kind, label``, at most ten per kind."""
    text = F.col("content")
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), finder(text).alias("labels"))
        for kind, finder in [("Skill", T.find_technologies), ("Pattern", T.find_patterns), ("AWSService", T.find_aws_services)]
    ])
    rows = results.select("qid", F.explode(kinds).alias("k")).select("qid", "k.kind", F.explode("k.labels").alias("label"))
    order = Window.partitionBy("qid", "kind").orderBy("label")
    ranked = rows.distinct().withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= G.LABEL_LIMIT).drop("place")


def _for_questions(terms: DataFrame, kind: str, rows: DataFrame, label: str, order: list[str], limit: int) -> DataFrame:
    """Query rows handed to the questions naming their label, the first ``limit`` each.

    The rows are already cut to as many per label, so a label on very many rows stays small.
    """
    asked = terms.where(F.col("kind") == kind).select("qid", F.lower("label").alias("low")).distinct()
    joined = asked.join(rows.withColumn("low", F.lower(label)), "low").drop("low")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return joined.withColumn("place", place).where(F.col("place") <= limit)


def graph_context(results: DataFrame, questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One context row per question (see ``operators.evidence.evidence_text``)."""
    terms = materialize(mentioned(results))

    def labels(kind: str) -> DataFrame:
        return terms.where(F.col("kind") == kind).select("label")

    person = G.person_summary(nodes, edges)
    skills = _for_questions(
        terms, "Skill", G.skill_neighbourhood(nodes, edges, labels("Skill"), None).select("skill"), "skill", ["skill"], 20
    ).select("qid", F.col("skill").alias("label"))
    patterns = _for_questions(
        terms, "Pattern", G.pattern_evidence(nodes, edges, labels("Pattern"), 30), "pattern",
        ["pattern", "entity_type", "entity_label", "source_file"], 30,
    ).select("qid", F.col("pattern").alias("label"))
    services = _for_questions(
        terms, "AWSService", G.aws_service_context(nodes, edges, labels("AWSService"), 30), "aws_service",
        ["aws_service", "repository"], 30,
    ).select("qid", F.col("aws_service").alias("label"))
    repeated = patterns.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)

    def collected(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("qid").agg(F.array_sort(F.collect_set("label")).alias(name))

    none = F.array().cast(LABELS)
    own = person.select(F.struct("skills", "patterns", "aws_services")).scalar()
    joined = (
        questions.select("qid", own.alias("own"))
        .select("qid", "own.*", F.col("own").isNotNull().alias("has_person"))
        .join(collected(skills, "near_skills"), "qid", "left").join(collected(repeated, "repeated_patterns"), "qid", "left")
        .join(collected(skills.union(patterns).union(services), "graph_entities_used"), "qid", "left")
    )
    found = F.array_union(F.coalesce("near_skills", none), F.coalesce("skills", none))
    return joined.select(
        "qid", "has_person",
        *[F.coalesce(c, none).alias(c) for c in ("skills", "patterns", "aws_services", "repeated_patterns", "graph_entities_used")],
        F.slice(F.array_sort(found), 1, 15).alias("inferred_skills"),
    )


def no_context(questions: DataFrame) -> DataFrame:
    none = F.array().cast(LABELS)
    names = ("skills", "patterns", "aws_services", "repeated_patterns", "graph_entities_used", "inferred_skills")
    return questions.select("qid", F.lit(False).alias("has_person"), *[none.alias(n) for n in names])


# -- Responses --------------------------------------------------------------

def routing_decision() -> Column:
    return F.struct(
        F.col("strategy").alias("strategy"), F.col("question_type").alias("questionType"),
        F.col("strategy_confidence").alias("strategyConfidence"), F.col("include_graph").alias("graphExpansionForced"),
        F.col("boost_keywords").alias("keywordBoostApplied"), F.col("use_secondary").alias("neptuneVectorsUsed"),
    )


def evidence_for(prepared: DataFrame, chunks: DataFrame, top_k: int, min_confidence: float) -> DataFrame:
    found = R.retrieve_with_strategy(prepared, chunks, top_k, min_confidence)
    return R.deduplicate(found)


def respond(prepared: DataFrame, results: DataFrame, context: DataFrame, model: A.Generator | None = None, sink: M.Sink | None = None) -> DataFrame:
    """Responses: the model's reply merged with graph findings, or the extractive fallback. Model calls leave their records in the sink."""
    counted = results.groupBy("qid").agg(F.count(F.lit(1)).alias("retrieval_count"))
    base = (
        prepared.join(context.select("qid", "inferred_skills", "repeated_patterns", "graph_entities_used"), "qid")
        .join(counted, "qid", "left")
    )
    if model is None:
        answers = (
            A.extractive_answer(prepared, results).join(A.top_sources(results, 3), "qid", "left")
            .select("qid", "answer", F.coalesce("sources", F.array().cast("array<map<string,string>>")).alias("sources"),
                    "confidence", "model_id")
        )
        rows = base.join(answers, "qid")
    else:
        evidence = A.evidence_text(A.evidence_blocks(results), context)
        prompts = base.join(evidence, "qid").join(A.top_sources(results, 5), "qid", "left")
        message = A.user_message(F.col("question_type"), F.col("evidence"), F.col("question"))
        replied, calls = M.observed(prompts.withColumn("message", message), "message", A.SYSTEM_PROMPT, model, "synthesize_answer", "synthesis")
        M.record(calls, sink)
        replied = replied.withColumn("reply", A.parse_reply(F.col("raw")))
        merged = A.merge_reply(F.col("reply"), F.col("raw"), F.col("inferred_skills"), F.col("repeated_patterns"), F.col("sources"))
        keep = [c for c in base.columns if c not in ("inferred_skills", "repeated_patterns")]
        rows = replied.withColumn("m", merged).select(*keep, "m.*", F.lit(model.model_id).alias("model_id"))
    return rows.select(
        "qid", "answer", "sources", "inferred_skills", "repeated_patterns", "confidence", "question_type",
        "graph_entities_used", F.coalesce("retrieval_count", F.lit(0)).cast("bigint").alias("retrieval_count"), "model_id",
        routing_decision().alias("routing_decision"), F.lit(False).alias("cache_hit"),
    )


def response_json(include_decision: bool = True) -> Column:
    """A response row in its wire form; a stored one has an empty routing decision."""
    decision = F.col("routing_decision") if include_decision else F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(
        "answer", "sources", F.col("inferred_skills").alias("inferredSkills"),
        F.col("repeated_patterns").alias("repeatedPatterns"), "confidence", F.col("question_type").alias("questionType"),
        F.col("graph_entities_used").alias("graphEntitiesUsed"), F.col("retrieval_count").alias("retrievalCount"),
        F.col("model_id").alias("modelId"), decision.alias("routingDecision"),
    ))


def answer_batch(questions: DataFrame, chunks: DataFrame, nodes: DataFrame | None, edges: DataFrame | None,
                 weights: DataFrame, embedder: V.Embedder, model: A.Generator | None = None,
                 top_k: int = K.DEFAULT_TOP_K, min_confidence: float = K.DEFAULT_MIN_CONFIDENCE,
                 expand: bool = True, classifier: A.Generator | None = None, sink: M.Sink | None = None) -> DataFrame:
    """Answer every ``(qid, question[, question_type])`` row, without the cache.

    Strategies that need the graph expand it whatever ``expand`` says; without a graph
    nothing is expanded. Records of model calls go to ``sink``.
    """
    prepared = materialize(prepare(questions, weights, embedder, classifier, sink))
    results = materialize(evidence_for(prepared, chunks, top_k, min_confidence))
    if nodes is None or edges is None:
        context = no_context(prepared)
    else:
        wide = prepared if expand else prepared.where("include_graph")
        plain = prepared.where("NOT include_graph") if not expand else prepared.limit(0)
        context = graph_context(results.join(wide.select("qid"), "qid", "left_semi"), wide, nodes, edges)
        if not expand:
            context = context.unionByName(no_context(plain))
    return respond(prepared, results, context, model, sink)


def with_cache(questions: DataFrame, cache: DataFrame, now: Column, embedder: V.Embedder,
               threshold: float = K.CACHE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Split questions into cache hits (``qid, cache_id, response_json``) and the rest."""
    asked = questions.select("qid", "question", V.embed(F.col("question"), embedder).alias("question_embedding"))
    allowed = materialize(asked.where(~Q.is_time_sensitive(F.col("question"))).drop("question"))
    hits = C.lookup(allowed, cache, now, threshold).join(cache.select("cache_id", "response_json"), "cache_id")
    hits = materialize(hits.select("qid", "cache_id", "response_json"))
    return hits, questions.join(hits.select("qid"), "qid", "left_anti")
