"""What the operators of this subpackage share: byte views of text batches, word hashes, components, tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import materialize, ship

#: Bytes of text that one numpy pass works on; longer documents make a pass of their own.
SLICE_BYTES = 2_000_000

#: Multiplier of the word hash and its inverse modulo 2**64.
PRIME = 0x9E3779B97F4A7C15
PRIME_INVERSE = pow(PRIME, -1, 1 << 64)

#: ASCII upper case to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_POWERS: dict[str, np.ndarray] = {}


def _cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS.update(up=powers(PRIME, size), down=powers(PRIME_INVERSE, size))
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every span of bytes, mixed so that low bits can number buckets."""
    up, down = _cached_powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def word_spans(is_word: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; a run also ends where a row starts."""
    change = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cuts = row_starts[(row_starts > 0) & (row_starts < len(is_word))]
    cuts = cuts[is_word[cuts] & is_word[cuts - 1]]
    if len(cuts):
        cuts = cuts[np.diff(cuts, prepend=-1) != 0]  # rows of empty texts start at the same place; inside a run neither list has it
        starts, ends = np.insert(starts, np.searchsorted(starts, cuts), cuts), np.insert(ends, np.searchsorted(ends, cuts), cuts)
    return starts, ends


def matrix_components(linked: np.ndarray) -> np.ndarray:
    """The smallest row number that each row of a symmetric boolean matrix reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (id, component), component the smallest id.

    Ids without a link to another id are absent. Each round joins every node to its neighbour of
    the smallest hash (itself included), follows that choice once more, and goes on with the
    links between the nodes that are left; hashed order keeps chains short. Every round is written to the
    shared folder, so a lost executor costs one file read.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
    edges = materialize(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(
            both.groupBy(F.col("a").alias("id"))
            .agg(F.min(order(F.col("b"))).alias("near"))
            .select("id", F.least(F.col("near"), order(F.col("id")))["id"].alias("up"))
        )
        step = up.alias("x").join(up.select(F.col("id").alias("mid"), F.col("up").alias("top")), F.col("up") == F.col("mid"))
        up = materialize(step.select("id", F.coalesce("top", "up").alias("up")))
        left, right = up.toDF("a", "ua"), up.toDF("b", "ub")
        edges = materialize(
            edges.join(left, "a").join(right, "b").where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
        if roots is None:
            roots = up.toDF("id", "root")
        else:
            nxt = up.toDF("root", "next")
            roots = materialize(roots.join(nxt, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(smallest, "root").select("id", "component")


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


#: Bytes of words: ASCII letters and digits, and all that is not ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every word of some rows, in order; ASCII upper case counts as lower case."""
    base = offsets[0]
    data, offsets = LOWER[data[base:offsets[-1]]], offsets - base
    starts, ends = word_spans(WORD_BYTE[data], offsets[:-1])
    return np.searchsorted(offsets, starts, "right") - 1, span_hashes(data, starts, ends)
