"""Shards by balanced label propagation.

Documents with equal texts are linked. They start in shards by hash; in every round a document asks to move to the shard that
holds most of its group, and moves are granted up to the shards' free places. Then all documents
stand in order of shard and group, and equal stretches of that order are the final shards: counts differ by one at
most, and only groups on a stretch's border are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import unit_hash
from dossier.session import materialize

SHARDS = 24
ROUNDS = 8
#: Quota of linked documents in a shard during the rounds, in times its final size; the final cut takes back what is too much.
SLACK = 1.25
#: Bytes that every document takes beside its text.
OVERHEAD = 8


def _propagate(linked: DataFrame, capacity: int, shards: int, rounds: int) -> DataFrame:
    """doc, group, shard after the rounds; only sums by shard come to the driver."""
    state = linked
    for turn in range(rounds):
        held = state.groupBy("group", "shard").count()
        best = held.groupBy("group").agg(F.max(F.struct("count", (-F.col("shard")).alias("low"))).alias("b")).select("group", (-F.col("b.low")).alias("want"))
        asked = materialize(state.join(materialize(best), "group"))
        loads = {r["shard"]: r["count"] for r in asked.groupBy("shard").count().collect()}
        wants = {r["want"]: r["count"] for r in asked.where("shard <> want").groupBy("want").count().collect()}
        if not wants:
            break
        # Documents that ask to leave a shard make room in it; the final cut into equal stretches evens out what is too much.
        leave = {r["shard"]: r["count"] for r in asked.where("shard <> want").groupBy("shard").count().collect()}
        granted = {s: max(0.0, min(1.0, (SLACK * capacity - loads.get(s, 0) + leave.get(s, 0)) / n)) for s, n in wants.items()}
        chance = F.element_at(F.array(*[F.lit(float(granted.get(s, 0.0))) for s in range(shards)]), F.col("want") + 1)
        # One draw for all documents of a group: groups move whole.
        moves = unit_hash(F.col("group"), F.lit(turn)) < chance
        state = asked.select("row", "group", F.when(moves, F.col("want")).otherwise(F.col("shard")).alias("shard"))
    return materialize(state)


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null), group_size.

    Size is the text's UTF-8 bytes plus 8. Shards hold equal numbers of rows, one more or less; slots number a shard's rows from 0 without gaps.
    A null text has no bytes, checksum 0 and no group; empty texts are equal texts. A group that is larger than a shard is
    dealt by hash to as many parts as it fills. Repeated rows are rows of their own; an empty table gives an empty result;
    extra columns are ignored.
    """
    text = F.col(text_col)
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("shard", F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int")))
    n = rows.count()
    capacity = max(1, n // shards)
    # Written first, so that the join has a shuffle of its own on either side and Spark can split a group of very many copies.
    sizes = materialize(rows.where("text_key is not null").groupBy("text_key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("group_size") / F.lit(float(capacity))).cast("long"))
    linked = materialize(rows.join(sizes, "text_key").select("row", F.xxhash64("text_key", part).alias("group"), "shard", "group_size"))
    moved = _propagate(linked.drop("group_size"), capacity, shards, rounds)
    known = moved.join(linked.select("row", "group_size"), "row").select("row", "group", "group_size", F.col("shard").alias("moved"))
    placed = rows.drop("text_key").join(known, "row", "left").select(
        "doc_id", "size", "text_crc32", "row", F.coalesce("moved", "shard").alias("shard"), "group", F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
    order = ["shard", F.xxhash64("group"), "group", "row"]
    in_order = materialize(
        materialize(placed).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before, offsets = 0, []
    for r in in_order.groupBy("part").count().orderBy("part").collect():  # one number per partition
        offsets.append((r["part"], before))
        before += r["count"]
    spark = docs.sparkSession
    ranked = in_order.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
    rank = F.col("before") + F.col("at")
    small, larger = n // shards, n % shards
    edge = larger * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(larger + F.floor((rank - edge) / max(small, 1))).cast("int")
    first = F.when(F.col("shard") < larger, F.col("shard") * (small + 1)).otherwise(F.lit(edge) + (F.col("shard") - larger) * small)
    return ranked.select("doc_id", "size", "text_crc32", shard.alias("shard"), rank.alias("rank"), "group_size").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "group_size",
    )
