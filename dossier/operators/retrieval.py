"""Retrieval: weighted top-k, keyword rerank, secondary pass, merge, near-duplicate removal.

Works on many questions at once. Columns of a result row: ``qid, chunk_id, content, score,
source_file, source_uri, source_weight, effective_score, metadata, rank``. A question's list
holds at most 50 + 25 rows, so its folds run over a bounded array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import documents as D
from dossier.functions import questions as Q
from dossier.operators import similarity as S
from dossier.session import materialize

RESULT = ["qid", "chunk_id", "content", "score", "source_file", "source_uri", "source_weight",
          "effective_score", "metadata", "rank"]


def rank_by(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def _metadata(**values: Column) -> Column:
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def _scored(hits: DataFrame, chunks: DataFrame, rows_at_most: int, weight: Column, metadata: Column) -> DataFrame:
    return (
        S.attach(hits, chunks, rows_at_most)
        .withColumn("source_weight", weight)
        .withColumn("effective_score", F.col("score") * F.col("source_weight"))
        .withColumn("source_uri", F.concat(F.lit("pgvector://"), "source_file"))
        .withColumn("metadata", metadata)
    )


def retrieve(questions: DataFrame, chunks: DataFrame, top_k: int = K.DEFAULT_TOP_K, min_score: float = 0.0,
             doc_type: str | None = None, questions_at_most: int | None = None) -> DataFrame:
    """Over-fetch twice ``top_k`` by cosine, weigh by source, cut by score, keep ``top_k``.

    ``questions``: ``qid, question_embedding[, strategy]``; the strategy picks the weight table.
    """
    pool = chunks if doc_type is None else chunks.where(F.col("doc_type") == doc_type)
    n = questions.count() if questions_at_most is None else questions_at_most
    if "strategy" not in questions.columns:
        questions = questions.withColumn("strategy", F.lit(""))
    hits = S.top_k(questions, pool, 2 * top_k).withColumnRenamed("rank", "cosine_rank")
    hits = hits.join(questions.select("qid", F.col("strategy").alias("q_strategy")), "qid")
    meta = _metadata(doc_type=F.col("doc_type"), strategy=F.col("strategy"), is_child=F.when(F.col("is_child"), "true"))
    scored = _scored(hits, pool, 2 * top_k * n, D.source_weight(F.col("source_file"), F.col("q_strategy")), meta)
    kept = scored.where(F.col("effective_score") >= min_score)
    ranked = rank_by(kept, F.desc("effective_score"), F.asc("cosine_rank"))
    return ranked.where(F.col("rank") <= top_k).select(*RESULT)


def retrieve_secondary(questions: DataFrame, chunks: DataFrame, top_k: int, questions_at_most: int) -> DataFrame:
    """Parents only, default weights, in cosine order."""
    pool = chunks.where(~F.coalesce("is_child", F.lit(False)))
    hits = S.top_k(questions, pool, top_k)
    return _scored(
        hits, pool, top_k * questions_at_most, D.source_weight(F.col("source_file")),
        _metadata(source=F.lit("pgvector_secondary")),
    ).select(*RESULT)


def keyword_rerank(results: DataFrame, questions: DataFrame, keyword_weight: float = K.KEYWORD_WEIGHT) -> DataFrame:
    """Blend effective score with keyword overlap; a question without keywords keeps its order."""
    words = questions.select("qid", Q.keywords(F.col("question")).alias("q_words"))
    overlap = Q.keyword_overlap(F.col("q_words"), Q.keywords(F.col("content")))
    blended = F.when(
        F.size("q_words") > 0, (1 - keyword_weight) * F.col("effective_score") + keyword_weight * overlap
    )
    rows = results.join(words, "qid").withColumn("boosted_score", blended)
    return rank_by(rows.withColumnRenamed("rank", "before"), F.desc("boosted_score"), F.asc("before")).drop("before", "q_words")


def _greedy(entries: Column, threshold: float, kept: Column | None = None) -> Column:
    """Entries, in order, unlike every entry kept before them."""
    start = F.slice(entries, 1, 0) if kept is None else kept

    def step(acc: Column, e: Column) -> Column:
        alike = F.exists(acc, lambda x: Q.jaccard(x["words"], e["words"]) >= threshold)
        return F.when(alike, acc).otherwise(F.array_append(acc, e))

    return F.aggregate(entries, start, step)


def _entries(rows: DataFrame, name: str) -> DataFrame:
    """Each question's ranked rows as one bounded array of ``(rank, chunk_id, words)``."""
    entry = F.struct("rank", "chunk_id", Q.prefix_words(F.col("content")).alias("words"))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias(name))


def deduplicate(results: DataFrame, threshold: float = K.DEDUP_THRESHOLD) -> DataFrame:
    """Drop rows whose opening words match those of a better-ranked kept row."""
    results = materialize(results)  # read twice; the search behind it should run once
    kept = _entries(results, "all").select("qid", F.explode(_greedy(F.col("all"), threshold)).alias("e"))
    keys = kept.select("qid", F.col("e.rank").alias("rank"))
    out = results.join(keys, ["qid", "rank"], "left_semi")
    return rank_by(out.withColumnRenamed("rank", "before"), F.asc("before")).drop("before")


def merge(primary: DataFrame, secondary: DataFrame, max_total: int, threshold: float = K.MERGE_THRESHOLD,
          preserve_boost: bool = False) -> DataFrame:
    """Add secondary rows unlike all rows kept so far, then rank all by effective score.

    The final order is by effective score, so a keyword rerank before it only settles ties;
    ``preserve_boost`` ranks by the boosted score where there is one.
    """
    primary, secondary = materialize(primary), materialize(secondary)
    both = _entries(primary, "first").join(_entries(secondary, "second"), "qid", "full_outer")
    none = F.slice(F.coalesce("first", "second"), 1, 0)
    first, second = F.coalesce("first", none), F.coalesce("second", none)
    added = F.slice(_greedy(second, threshold, first), F.size(first) + 1, F.greatest(F.size(second), F.lit(1)))
    extra = both.select("qid", F.explode(added).alias("e")).select("qid", F.col("e.rank").alias("rank"))
    boost = F.col("boosted_score") if "boosted_score" in primary.columns else F.lit(None).cast("double")
    rows = (
        primary.withColumn("boost", boost).withColumn("part", F.lit(0)).select(*RESULT, "boost", "part")
        .unionByName(
            secondary.join(extra, ["qid", "rank"], "left_semi").withColumn("boost", F.lit(None).cast("double"))
            .withColumn("part", F.lit(1)).select(*RESULT, "boost", "part")
        )
    )
    score = F.coalesce("boost", "effective_score") if preserve_boost else F.col("effective_score")
    ranked = rank_by(rows.withColumnRenamed("rank", "before"), F.desc(score), F.asc("part"), F.asc("before"))
    return ranked.where(F.col("rank") <= max_total).select(*RESULT)


def retrieve_with_strategy(questions: DataFrame, chunks: DataFrame, top_k: int = K.DEFAULT_TOP_K,
                           min_score: float = 0.0, preserve_boost: bool = False) -> DataFrame:
    """Retrieve for ``(qid, question, question_embedding, strategy)`` rows, each by its strategy.

    One search serves all strategies; the rerank and the second pass then touch only the
    questions whose strategy asks for them, if there are any.
    """
    asked = {r["strategy"]: r["n"] for r in questions.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(asked.values())
    primary = materialize(retrieve(questions, chunks, top_k, min_score, questions_at_most=n))

    def of(*names: str) -> tuple[DataFrame, DataFrame]:
        group = questions.where(F.col("strategy").isin(*names))
        return primary.join(group.select("qid"), "qid", "left_semi"), group

    parts = [of(*[s for s in asked if s not in ("keyword_boosted", "hybrid")] or [""])[0]]
    if "keyword_boosted" in asked:
        parts.append(keyword_rerank(*of("keyword_boosted")).select(*RESULT))
    if "hybrid" in asked:
        rows, group = of("hybrid")
        reranked = keyword_rerank(rows, group)
        if top_k >= 2:
            second = retrieve_secondary(group, chunks, top_k // 2, n)
            reranked = merge(reranked, second, top_k, preserve_boost=preserve_boost)
        parts.append(reranked.select(*RESULT))
    return reduce(DataFrame.unionByName, parts)


def retrieval_report(hits: DataFrame, top_k: int = K.DEFAULT_TOP_K) -> DataFrame:
    """Direct-retrieval listing: 4-digit scores, a 300-character preview, ranked by weighted score.

    ``hits``: ``qid, source_uri, score, content, rank`` as an external store returned them.
    """
    file = F.when(F.coalesce("source_uri", F.lit("")) == "", "unknown").otherwise(F.substring_index("source_uri", "/", -1))
    rows = hits.where(F.col("rank") <= top_k).select(
        "qid", file.alias("source_file"), "source_uri", F.round("score", 4).alias("score"),
        D.weight_chain(file, K.REPORT_SOURCE_WEIGHTS).alias("source_weight"),
        F.round(F.col("score") * D.weight_chain(file, K.REPORT_SOURCE_WEIGHTS), 4).alias("effective_score"),
        F.concat(F.substring("content", 1, 300), F.when(F.length("content") > 300, "...").otherwise(""))
        .alias("content_preview"), F.col("rank").alias("before"),
    )
    return rank_by(rows, F.desc("effective_score"), F.asc("before")).drop("before")
