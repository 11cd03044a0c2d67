"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits; the perfect binary Golay code of length 23 decodes any of its segments to one of 4096
codewords, and the words next to a segment decode to one or six of them. Two words that
differ in one bit at most therefore share a codeword: the one's own is among the other's near ones.
With four differing bits and three segments (22, 21, 21 bits), the two segments with the fewest
errors have two errors together at most. Either one of the three has none (its raw bits
are a key), or two have one each (own codeword of one, near codewords of the other, both ways, are keys).
Every linked pair shares a key; pairs that share a key are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import components, matrix_components
from dossier.session import materialize

WORDS_IN_SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of one key that are compared in one block; larger groups are cut into tiles.
BLOCK = 1024
#: Groups up to this size are compared pair by pair, larger ones give links to their smallest member.
SMALL = 8
#: Shingles of one text that are hashed at a time.
SHINGLES_AT_ONCE = 1 << 16

#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0b101011100011
#: Bit offset and width of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Bit i is set when more than half of the shingle hashes have it set; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS_IN_SHINGLE, len(words))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        some = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[some], ends[some])], "<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte:8 * byte + 8] += np.bincount(hashes[:, byte], minlength=256) @ _BITS
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(starts)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["doc_id", "fp"])


def _syndromes() -> np.ndarray:
    """The remainder of every 23-bit word by the generator."""
    rest = np.arange(1 << 23, dtype=np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GENERATOR << bit - 11), rest)
    return rest


def codeword_index() -> np.ndarray:
    """For every 23-bit word the number (0 to 4095) of the only codeword within three bits."""
    rest = _syndromes()
    errors = np.zeros(1 << 11, np.uint32)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            errors[rest[word]] = word
    return ((np.arange(1 << 23, dtype=np.uint32) ^ errors[rest]) >> 11).astype(np.uint16)


_INDEX: list[np.ndarray] = []


def keys_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint: arrays of row numbers and of keys, each once per row."""
    if not _INDEX:
        _INDEX.append(codeword_index())
    index, marks = _INDEX[0], marks.astype(np.uint64)
    rows, keys, row = [], [], np.arange(len(marks))
    raw, own, near = [], [], []
    for at, width in SEGMENTS:
        segment = (marks >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        raw.append(segment)
        own.append(index[segment].astype(np.int64))
        flips = np.concatenate([[0], 1 << np.arange(width)])
        near.append(np.sort(index[segment[:, None] ^ flips[None, :]].astype(np.int64), axis=1))
    for i in range(3):
        rows.append(row)
        keys.append(np.int64(i << 40) | raw[i])
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), start=3):
        both = np.concatenate([near[i] << 12 | own[j][:, None], own[i][:, None] << 12 | near[j]], axis=1)
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append(np.int64(tag << 40) | both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(marks), 4096):
            some = marks[at:at + 4096]
            rows, keys = keys_of(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], ["key", "fp"])


def links_of(keys: np.ndarray, marks: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal keys; keys are sorted. Large groups give links to their smallest members."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    at, group = np.flatnonzero(small), np.repeat(np.arange(len(sizes)), sizes)
    for lag in range(1, SMALL):
        at = at[at + lag < len(keys)]
        at = at[group[at] == group[at + lag]]
        x, y = marks[at], marks[at + lag]
        good = (x != y) & (np.bitwise_count(x ^ y) <= max_bits)
        a.append(x[good])
        b.append(y[good])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        group = np.unique(marks[start:start + size])
        root = matrix_components(np.bitwise_count(group[:, None] ^ group[None, :]) <= max_bits)
        far = root != np.arange(len(group))
        a.append(group[far])
        b.append(group[root[far]])
    return np.concatenate(a), np.concatenate(b)


def _link_rows(max_bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = marks = np.zeros(0, np.int64)

        def out(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            a, b = links_of(keys, marks.view(np.uint64), max_bits)
            pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            marks = np.concatenate([marks, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(keys):
                last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                yield out(keys[:last], marks[:last])
                keys, marks = keys[last:], marks[last:]
        yield out(keys, marks)

    return link


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a long), fingerprint (16 hex digits), component_id.

    Texts are taken whole. Null and empty texts, and texts of white space, have fingerprint 0, linked like any other. Equal fingerprints are one
    node, so copies are never paired. Repeated rows give repeated rows; an empty table gives an
    empty result; extra columns are ignored. `max_bits` may be 0 to 4.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find pairs of up to four differing bits")
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")
    )
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    keys = classes.select("fp").mapInArrow(_key_rows, "key long, fp long")
    hot = keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # A large group is cut into blocks by hash, and every two blocks meet in a tile of their own.
    block = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.xxhash64(F.col("key"), F.least(other, block), F.greatest(other, block)),
    )
    dealt = keys.join(hot, "key", "left").select(
        F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(tiles)).alias("key"), "fp",
    )
    grouped = dealt.repartition("key").sortWithinPartitions("key")
    links = materialize(grouped.mapInArrow(_link_rows(max_bits), "a long, b long"))
    # Components run over fingerprints; the answer is the smallest document of each.
    reached = components(links).toDF("fp", "root")
    nodes = classes.join(reached, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = nodes.join(smallest, "root").select("fp", "component_id")
    return rows.join(known, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that are the smallest of their component; rows with a null id stay."""
    found = near_duplicates(docs, max_bits).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
