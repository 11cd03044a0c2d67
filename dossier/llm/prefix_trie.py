"""The trie of conversation prefixes as flat node tables behind minimal perfect hashes.

Every conversation is rebuilt (see `paths`), and each of its prefixes gets a digest of 128 bits: the exclusive or of
hashes of its turns with their places, a running aggregate. Equal digests are one node; that they are one sequence is
verified by the SHA-256 digests of their last turns (and so, depth by depth, of all turns), else the job stops.

Nodes are dealt to shards by subtree. Nodes with many members, the crown, are few by a bound; a subtree that hangs below the
crown has few members, and all of it goes to one shard. A shard builds a minimal perfect hash over its digests: a level of
bits at twice the keys' number keeps the keys that are alone at their place, the others go to the next level, and a key's
slot is the rank of its bit. Slots hold the digests, so every lookup is verified and a parent outside the shard shows as
such. Counts are scattered to numpy arrays by slot, and children add to their parents' slots from the deepest level up.
Crown nodes take their subtrees' sums in the same way, in a table of their own.

Defined cases: turns stand in order of turn, null first; turns of equal number by the SHA-256 of role and text. Null roles and texts
are empty. Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own. No
rows give no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.session import materialize, shuffle_width

#: Conversations in steps of so many lend their first one's opening turns; the checksum gives how many.
FAMILY, OPENINGS = 5, 9
#: A node of more members belongs to the crown; the bound grows so that the crown never holds more nodes than CROWN.
LIGHT, CROWN = 10_000, 1_000_000
#: Nodes that a shard is planned for, and ends' ids that are joined to one text before they are hashed.
SHARD_NODES, ID_BITS = 200_000, 12
LEVELS = 200


def _term(lane: int) -> Column:
    return F.xxhash64("a", "b", "depth", F.lit(lane))


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), a, b (120 bits of the turn's SHA-256), bytes: texts end here."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).select("conv", "turn", lane(1).alias("a"), lane(16).alias("b"), "bytes")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    return rows.select("conv", (F.row_number().over(order) - 1).cast("long").alias("pos"), "a", "b", "bytes")


def paths(own: DataFrame) -> DataFrame:
    """conv, depth, a, b, bytes, is_end, p1, p2: one row per prefix of a rebuilt conversation, the empty one included.

    Conversation c takes the first h turns of conversation c - c % 5, h = crc32(decimal c) % 9, then its own after its first h.
    """
    size = own.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    lender = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    plan = size.select("conv", "size", lender.alias("lender"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(OPENINGS)).alias("h"))
    plan = plan.join(size.select(F.col("conv").alias("lender"), F.col("size").alias("lent")), "lender", "left")
    same = F.col("lender") == F.col("conv")
    plan = materialize(plan.select(
        "conv", "lender", F.when(same, F.lit(0)).otherwise(F.col("h")).alias("h"),
        F.when(same, F.lit(0)).otherwise(F.least("h", F.coalesce("lent", F.lit(0)))).alias("taken"), "size",
    ).withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))
    kept = own.join(plan, "conv").where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "bytes", "length",
    )
    opening = own.where(F.col("pos") < OPENINGS - 1).withColumnRenamed("conv", "lender")
    lent = opening.join(plan.where("taken > 0"), "lender").where("pos < taken").select(
        "conv", (F.col("pos") + 1).alias("depth"), "a", "b", "bytes", "length",
    )
    zero = F.lit(0).cast("long")
    top = plan.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"), "length")
    path = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    lanes = [F.bit_xor(F.when(F.col("depth") > 0, _term(k)).otherwise(zero)).over(path).alias(f"p{k}") for k in (1, 2)]
    rows = kept.unionByName(lent).unionByName(top)
    return rows.select("conv", "depth", "a", "b", "bytes", (F.col("depth") == F.col("length")).alias("is_end"), *lanes)


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix: its digest and its parent's, depth, conv_id, n_convs, bytes."""
    found = rows.groupBy("p1", "p2", "depth").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("bytes").alias("bytes"),
        *[f(c).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("min", F.min), ("max", F.max))],
    )
    one = (F.col("min_a") == F.col("max_a")) & (F.col("min_b") == F.col("max_b"))
    checked = found.withColumn("a", F.when(one, F.col("min_a")).otherwise(F.raise_error(F.lit("two turn sequences share a digest")).cast("long")))
    checked = checked.withColumn("b", F.col("min_b"))
    return checked.select(
        "p1", "p2", "depth", "n_convs", "conv_id", "bytes",
        *[F.when(F.col("depth") > 0, F.col(f"p{k}").bitwiseXOR(_term(k))).alias(f"u{k}") for k in (1, 2)],
    )


def _mixed(p1: np.ndarray, p2: np.ndarray, depth: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = p1.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        for more in (p2.view(np.uint64), depth.view(np.uint64)):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) ^ more
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class SlotTable:
    """A minimal perfect hash over distinct keys (p1, p2, depth): slots 0 to n-1, each verified by the key it holds."""

    def __init__(self, *key: np.ndarray):
        n = len(key[0])
        self.levels: list[np.ndarray] = []
        left = np.arange(n)
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("equal keys in a shard")
            at = self._place(*[k[left] for k in key], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.ranks = [np.cumsum(bits) - 1 for bits in self.levels]
        self.starts = np.concatenate([[0], np.cumsum([bits.sum() for bits in self.levels])]).astype(np.int64)
        self.held: list[np.ndarray] | None = None
        slot = self.find(*key)
        self.held = [np.empty(n, k.dtype) for k in key]
        for held, k in zip(self.held, key):
            held[slot] = k
        if (self.find(*key) != slot).any() or (slot < 0).any():
            raise ValueError("a key's slot holds another key")

    @staticmethod
    def _place(p1: np.ndarray, p2: np.ndarray, depth: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(p1, p2, depth, level + 1) % np.uint64(size)).astype(np.int64)

    def find(self, *key: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for a key that is not in the table."""
        slot = np.full(len(key[0]), -1, np.int64)
        left = np.arange(len(slot))
        for level, bits in enumerate(self.levels):
            at = self._place(*[k[left] for k in key], level, len(bits))
            hit = bits[at]
            slot[left[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        if self.held is not None and len(self.held[0]):
            wrong = np.zeros(len(slot), bool)
            for held, k in zip(self.held, key):
                wrong |= held[np.maximum(slot, 0)] != k
            slot[wrong] = -1
        return slot


#: Columns of a shard's rows; n_children, n_leaves and saved come in with what lower shards have summed up.
NODE = "p1 long, p2 long, depth long, u1 long, u2 long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"
NAMES = [c.split()[0] for c in NODE.split(", ")]


def fold_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of all nodes of one shard; nodes whose parent lies outside are tops and have no parent_conv_id yet."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    c = {name: rows[name].combine_chunks().fill_null(0).to_numpy() for name in NAMES[:10]}
    table = SlotTable(c["p1"], c["p2"], c["depth"])
    slot = table.find(c["p1"], c["p2"], c["depth"])
    parent = table.find(c["u1"], c["u2"], c["depth"] - 1)
    parent[rows["u1"].combine_chunks().is_null().to_numpy(zero_copy_only=False)] = -1
    inside = parent >= 0
    n = len(slot)
    children, leaves, saved, up, depth, conv = (np.zeros(n, np.int64) for _ in range(6))
    children[slot], leaves[slot], saved[slot], up[slot], depth[slot], conv[slot] = (
        c["n_children"], c["n_leaves"], c["saved_tokens"], parent, c["depth"], c["conv_id"])
    np.add.at(children, parent[inside], 1)
    leaves[children == 0] += 1
    order = np.argsort(-depth, kind="stable")
    bounds = np.flatnonzero(np.diff(depth[order], prepend=depth[order[0]] + 1))
    for first, last in zip(bounds, [*bounds[1:], n]):
        level = order[first:last]
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    above = pa.array(conv[np.maximum(parent, 0)], mask=~inside)
    out = [rows[k].combine_chunks() for k in NAMES[:7]] + [pa.array(x[slot]) for x in (children, leaves, saved)] + [above]
    yield from pa.Table.from_arrays(out, names=NAMES).to_batches(max_chunksize=65_536)


def _ends(rows: DataFrame) -> DataFrame:
    """p1, p2, depth, ends_sha256: ids are joined in blocks first, and a node's blocks pass one hash in order."""
    key = ["p1", "p2", "depth"]
    blocks = rows.where("is_end").groupBy(*key, F.shiftright("conv", ID_BITS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], [*key, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if node == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256(ids.encode())
            yield flush()
        if at is not None:
            done.append((*at, state.hexdigest()))
            yield flush()

    ordered = blocks.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "ids")
    return ordered.mapInArrow(hashed, "p1 long, p2 long, depth long, ends_sha256 string")


def nodes(conversations: DataFrame, light: int = LIGHT, crown: int = CROWN, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = materialize(paths(materialize(turns(conversations))))
    found = materialize(distinct_nodes(rows))
    size = found.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n_convs"), F.lit(0)).alias("rows")).first()
    limit = max(light, size["rows"] // crown)  # members add up to the number of rows, so fewer than `crown` nodes have more than this
    heavy = found.where(F.col("n_convs") > limit)
    marks = heavy.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    sums = {"n_children": zero, "n_leaves": zero, "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}

    # A conversation's path leaves the crown at one place; that node names the shard of all nodes that the conversation stands for.
    leaving = rows.where("depth > 0").select(
        "conv", "depth", "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(_term(k)).alias(f"u{k}") for k in (1, 2)],
    ).join(F.broadcast(marks), ["u1", "u2", "depth"]).join(F.broadcast(heavy.select("p1", "p2", "depth")), ["p1", "p2", "depth"], "left_anti")
    leaving = leaving.select(F.col("conv").alias("conv_id"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    below = found.where(F.col("n_convs") <= limit).join(leaving, "conv_id", "left")
    below = below.withColumns(sums).withColumn("parent_conv_id", F.lit(None).cast("long"))
    shards = max(shuffle_width(spark), size["nodes"] // shard_nodes + 1)
    subtrees = materialize(below.repartition(shards, "t1", "t2").select(*NAMES).mapInArrow(fold_shard, NODE))

    tops = subtrees.where("parent_conv_id is null and depth > 0")
    hung = tops.groupBy("u1", "u2", (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("hung"),
    ).withColumnsRenamed({"u1": "p1", "u2": "p2"})
    own = heavy.join(hung, ["p1", "p2", "depth"], "left").select(
        *NAMES[:7], *[F.coalesce(c, zero).alias(c) for c in ("n_children", "n_leaves")],
        (sums["saved_tokens"] + F.coalesce("hung", zero)).alias("saved_tokens"), F.lit(None).cast("long").alias("parent_conv_id"),
    )
    upper = materialize(own.coalesce(1).mapInArrow(fold_shard, NODE))  # fewer than `crown` rows

    parents = marks.withColumnRenamed("parent_conv_id", "above")
    subtrees = subtrees.join(F.broadcast(parents), ["u1", "u2", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    whole = subtrees.select(*NAMES).unionByName(upper)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return whole.join(_ends(rows), ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
