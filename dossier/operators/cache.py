"""Semantic answer cache: lookup, hit counts, guarded insert, inspection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import similarity as N
from dossier.session import cut_lineage, materialize, shuffle_width

CACHE_TYPE = (
    "cache_id string, question_embedding array<float>, response_json string, question_type string, "
    "hit_count bigint, created_at timestamp, expires_at timestamp"
)
#: Pairs a candidate on average from which on they are written out.
DEGREE = 64


def live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def distinct_vectors(entries: DataFrame, entry_id: str) -> DataFrame:
    """Of entries with the same vector the one of the smallest id, which a search for one entry chooses among them.

    Entries that repeat a vector cost one comparison a question, not one each; the hash goes first, so that sorting compares numbers.
    """
    vector = F.col("embedding").cast("array<float>")
    known = entries.where(F.col("embedding").isNotNull()).groupBy(F.xxhash64(vector).alias("h"), vector.alias("embedding"))
    return materialize(known.agg(F.min(entry_id).alias(entry_id)).drop("h"))


def lookup(questions: DataFrame, cache: DataFrame, now: Column, threshold: float = K.CACHE_THRESHOLD) -> DataFrame:
    """Nearest live entry at or above the threshold: ``qid, cache_id, score``."""
    entries = live(cache, now).select("cache_id", F.col("question_embedding").alias("embedding"))
    known = distinct_vectors(entries, "cache_id")
    return N.top_k(questions, known, 1, chunk_id="cache_id", min_score=threshold).select("qid", "cache_id", "score")


def count_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    counted = hits.groupBy("cache_id").agg(F.count(F.lit(1)).alias("new_hits"))
    return cache.join(counted, "cache_id", "left").withColumn(
        "hit_count", F.col("hit_count") + F.coalesce("new_hits", F.lit(0))
    ).drop("new_hits").select(*cache.columns)


def inspect(cache: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    return (
        live(cache, now).select("cache_id", "question_type", "hit_count", "created_at", "expires_at")
        .orderBy(F.desc("hit_count"), "cache_id").limit(limit)
    )


def cacheable_response(response_json: Column) -> Column:
    """The response without its latency."""
    fields = F.from_json(response_json, "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, v: k != "latencyMs"))


def first_of_copies(candidates: DataFrame) -> DataFrame:
    """Of candidates with the same embedding only the first can be kept; drop the others early."""
    first = candidates.groupBy("embedding").agg(F.min("seq").alias("seq")).select("seq")
    return candidates.join(first, "seq", "left_semi")


def insert_new(candidates: DataFrame, cache: DataFrame, now: Column, threshold: float = K.CACHE_THRESHOLD,
               degree: int = DEGREE) -> DataFrame:
    """Candidates that enter the cache when inserted one after the other in ``seq`` order.

    ``candidates``: ``seq`` (unique long), ``embedding``. Copies are reduced to their first, and what is near a live
    entry goes. Then, all candidates at once: those without an earlier near one stay, those near such a one go, and so
    on with the rest, by tiled search that counts pairs but writes none, until a candidate has at most ``degree`` pairs
    on average. Those pairs are written and settled (``settle``).
    """
    ready = cut_lineage(first_of_copies(candidates.where(F.col("embedding").isNotNull()).select("seq", "embedding")))
    stored = live(cache, now).select("cache_id", F.col("question_embedding").alias("embedding"))
    rest = cut_lineage(_unlike(ready, stored, "cache_id", threshold))
    kept = []
    while True:
        earlier = materialize(N.earlier_pairs(rest, threshold, counted=True))
        size = earlier.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
        if size["pairs"] <= degree * size["rows"]:
            break
        firsts = cut_lineage(rest.join(earlier, rest["seq"] == earlier["b"], "left_anti"))
        kept.append(firsts)
        others = rest.join(earlier.select(F.col("b").alias("seq")), "seq", "left_semi")
        rest = cut_lineage(_unlike(others, firsts.select(F.col("seq").alias("first"), "embedding"), "first", threshold))
    if size["pairs"]:
        rest = rest.join(settle(N.earlier_pairs(rest, threshold)), "seq", "left_anti")
    for part in kept:
        rest = rest.unionByName(part)
    return rest


def _unlike(rows: DataFrame, known: DataFrame, known_id: str, threshold: float) -> DataFrame:
    """Rows that are near none of the known vectors."""
    asked = rows.select(F.col("seq").alias("qid"), F.col("embedding").alias("question_embedding"))
    near = N.top_k(asked, distinct_vectors(known, known_id), 1, chunk_id=known_id, min_score=threshold)
    return rows.join(near.select(F.col("qid").alias("seq")), "seq", "left_anti")


def settle(pairs: DataFrame) -> DataFrame:
    """``seq`` of the candidates that go: of each pair ``a`` (earlier), ``b`` the later goes if the earlier stays.

    Rounds over the pairs of the candidates that are still open. Pairs are split by ranges of ``b`` and streamed in its order; a task
    settles all candidates whose earlier neighbours are settled before, have no open neighbour, or lie in its own range. A chain that runs
    along ``seq`` is thus settled range by range, and all ranges work at once.
    """
    pairs, gone = materialize(pairs), None
    width = shuffle_width(pairs.sparkSession)
    while not pairs.isEmpty():
        open_ = pairs.select(F.col("b").alias("a")).distinct().withColumn("open", F.lit(True))
        marked = pairs.join(open_, "a", "left").select("b", "a", F.col("open").isNull().alias("stays"))
        ordered = marked.repartitionByRange(width, "b").sortWithinPartitions("b", "a")
        settled = materialize(ordered.mapInPandas(_settled, "seq long, stays boolean"))
        new = settled.where("not stays").select("seq")
        gone = new if gone is None else gone.unionByName(new)
        left = pairs.join(settled.select(F.col("seq").alias("b")), "b", "left_anti")
        pairs = materialize(left.join(new.select(F.col("seq").alias("a")), "a", "left_anti").select("a", "b"))
    return gone if gone is not None else pairs.select(F.col("b").alias("seq"))


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the pairs of one range of ``b`` decide; ``stays`` marks an ``a`` that is sure to stay."""
    known: dict[int, bool] = {}
    at, goes, waits = None, False, False

    def close() -> None:
        if at is not None and (goes or not waits):
            known[at] = not goes

    for rows in batches:
        before = len(known)
        for b, a, stays in rows.itertuples(index=False):
            if b != at:
                close()
                at, goes, waits = b, False, False
            if not goes:
                stays = known.get(a) if not stays else True
                goes, waits = bool(stays), waits or stays is None
        fresh = list(known.items())[before:]
        yield pd.DataFrame(fresh, columns=["seq", "stays"])
    before = len(known)
    close()
    yield pd.DataFrame(list(known.items())[before:], columns=["seq", "stays"])


def write(cache: DataFrame, candidates: DataFrame, now: Column, threshold: float = K.CACHE_THRESHOLD,
          ttl_days: int = K.CACHE_TTL_DAYS, min_confidence: float = K.CACHE_MIN_CONFIDENCE) -> DataFrame:
    """The cache with new answers added.

    ``candidates``: ``seq, embedding, response_json, question_type, confidence``; answers
    below the confidence gate are not considered, ``latencyMs`` is not stored.
    """
    able = candidates.where(F.col("confidence") >= min_confidence)
    chosen = insert_new(able, cache, now, threshold).select("seq")
    fresh = able.join(chosen, "seq", "left_semi").select(
        F.concat(F.lit("q"), F.col("seq").cast("string")).alias("cache_id"),
        F.col("embedding").cast("array<float>").alias("question_embedding"),
        cacheable_response(F.col("response_json")).alias("response_json"), "question_type", F.lit(0).cast("bigint").alias("hit_count"),
        now.alias("created_at"), (now + F.make_dt_interval(days=F.lit(ttl_days))).alias("expires_at"),
    )
    return cache.unionByName(fresh)
