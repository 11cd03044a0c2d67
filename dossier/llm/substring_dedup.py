"""Substring dedup by content-defined chunking.

A gear hash rolls over the words of each text, four words deep; a chunk ends at the word whose value is the least of some window of
neighbouring words, so cuts depend on a few words around them and an insertion moves no cut but the nearest. The digest of
four neighbouring chunks names a piece of text. Every window holds a cut, hence a passage of MIN_WORDS words that two texts share
holds one whole piece at least, the same in both, whatever its words are. Pieces that more than one document holds are joined back to their
places. A stretch of overlapping pieces that the same other document holds is a passage if it is long enough. All other pieces open a
check: the windows of MIN_WORDS words that hold such a piece, wherever it stands, are counted, and those of more than one document are passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import _cached_powers, slices, span_hashes, text_bytes, word_spans
from dossier.session import materialize

#: Chunks that one digest covers, and words that the gear value of a word depends on.
CHUNKS_IN_PIECE, DEPTH = 4, 4
#: Words of a passage.
MIN_WORDS = 50
#: A piece's number of words stands above its number of bytes.
BYTES_BITS = 40


def cut_window(min_words: int) -> int:
    """Words of a cut window: as many as leave a shared passage of `min_words` words CHUNKS_IN_PIECE whole chunks.

    The first DEPTH - 1 words of a passage have values of their own context; of the rest, cuts are the same in all
    its copies except within a window's length of either end, and one cut comes in every window.
    """
    return max(1, (min_words - DEPTH + 3) // (CHUNKS_IN_PIECE + 3))


def word_values(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words between white space."""
    starts, ends = word_spans(~((data == 32) | ((data >= 9) & (data <= 13))), row_starts)
    return starts, ends, span_hashes(data, starts, ends)


def cuts(hashes: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the words that end a chunk: of every window of words within a text the last one of the least gear value."""
    value = hashes.copy()
    for age in range(1, DEPTH):
        value[age:] += np.where(row[age:] == row[:-age], hashes[:-age] << np.uint64(16 * age), np.uint64(0))
    count = len(value) - window + 1
    if count < 1:
        return np.zeros(0, np.int64)
    least, at = value[:count].copy(), np.arange(count)
    for k in range(1, window):
        new = value[k:k + count] <= least
        least[new], at[new] = value[k:k + count][new], np.flatnonzero(new) + k
    picked = np.zeros(len(value), bool)
    picked[at[row[:count] == row[window - 1:]]] = True
    return np.flatnonzero(picked)


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every range of words."""
    up, down = _cached_powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    h = (total[last] - total[first]) * down[first]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def pieces(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Every run of neighbouring chunks within a text: digest, document, place, extent."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    starts, ends, hashes = word_values(data, offsets[:-1])
    row = np.searchsorted(offsets, starts, "right") - 1
    cut = cuts(hashes, row, window)
    head = cut[:-CHUNKS_IN_PIECE] if len(cut) > CHUNKS_IN_PIECE else cut[:0]
    tail = cut[CHUNKS_IN_PIECE:]
    same = row[head] == row[tail]
    head, tail = head[same] + 1, tail[same] + 1
    row_of = row[head] if len(head) else np.zeros(0, np.int64)
    start = starts[head]
    return {
        "digest": sequence_hashes(hashes, head, tail).view(np.int64), "doc_id": ids[row_of],
        # Two numbers in one, for shuffles that carry a row per piece.
        "place": (head - np.searchsorted(row, row_of)) << 32 | start - offsets[row_of], "extent": (tail - head) << BYTES_BITS | ends[tail - 1] - start,
    }


def _piece_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for first, last in slices(offsets):
                found = pieces(ids[first:last], data, offsets[first:last + 1], window)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found.values()], list(found))

    return rows


def _digest_rows(window: int):
    """Digests with their numbers of places and of documents, those of one slice of the table counted before they leave it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _piece_rows(window)(batches):
            digest, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((ids, digest))
            digest, ids = digest[order], ids[order]
            head = np.flatnonzero(np.diff(digest, prepend=digest[:1] - 1))
            new = np.ones(len(digest), np.int64)
            new[1:] = (digest[1:] != digest[:-1]) | (ids[1:] != ids[:-1])
            end = np.append(head, len(digest))[1:]
            docs = np.add.reduceat(new, head) if len(head) else new
            out = (digest[head], (end - head) << 32 | docs, ids[head], ids[end - 1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["digest", "n", "first", "most"])

    return rows


def _overlapping(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the first ranges of runs whose ranges overlap; ranges are in order of row and start."""
    reach = np.maximum.accumulate(end + (row << 40))
    head = np.ones(len(row), bool)
    head[1:] = start[1:] + (row[1:] << 40) >= reach[:-1]
    return np.flatnonzero(head)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of a column of lists of structs."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


_RANGE = "doc_id long, start long, end long, first long, last long, is_first boolean, holders long"
_NAMES = ["doc_id", "start", "end", "first", "last", "is_first", "holders"]


def _stretches(min_words: int):
    """Pieces of a document to stretches of the same other document that are long enough, and a row that names all other pieces."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, (place, extent, holders, new, digest, other) = _flat(batch.column(1))
            start, first = place & 0xFFFFFFFF, place >> 32
            order = np.lexsort((start, row))
            row, start, first, extent, holders, new, digest, other = (x[order] for x in (row, start, first, extent, holders, new, digest, other))
            if not len(row):
                continue
            last = first + (extent >> BYTES_BITS)
            end = start + (extent & (1 << BYTES_BITS) - 1)
            # Neighbouring pieces share chunks, so starts and ends both ascend within a text.
            begins = np.ones(len(row), bool)
            begins[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (first[1:] >= last[:-1])
            head = np.flatnonzero(begins)
            tail = np.append(head[1:], len(row)) - 1
            of = np.cumsum(begins) - 1
            # A piece that comes back within a stretch may be one place of the other document.
            by_digest = np.lexsort((digest, of))
            again = np.zeros(len(head), bool)
            twice = (digest[by_digest][1:] == digest[by_digest][:-1]) & (of[by_digest][1:] == of[by_digest][:-1])
            again[of[by_digest][1:][twice]] = True
            sure = (last[tail] - first[head] >= min_words) & ~again
            columns = [ids[row[head]], start[head], end[tail], first[head], last[tail], np.logical_and.reduceat(new, head), np.maximum.reduceat(holders, head)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[sure]) for x in columns), pa.nulls(int(sure.sum()), pa.list_(pa.int64()))], [*_NAMES, "digests"])
            unsure = np.flatnonzero(~sure[of])
            if len(unsure):
                cut = np.flatnonzero(np.diff(row[unsure], prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(unsure)), pa.int32()), pa.array(digest[unsure]))
                none = np.zeros(len(cut), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[unsure[cut]]]), *[pa.array(none)] * 4, pa.array(none > 0), pa.array(none), lists], [*_NAMES, "digests"])

    return merge


def _window_rows(width: int):
    """Every window of `width` words that holds one of a document's pieces: its hash, document and place."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            row, (place, extent) = _flat(batch.column(2))
            bounds = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, doc_id in enumerate(ids):
                own = data[offsets[i]:offsets[i + 1]]
                starts, ends, hashes = word_values(own, np.zeros(1, np.int64))
                count = len(starts) - width + 1
                if count < 1:
                    continue
                some = slice(bounds[i], bounds[i + 1])
                first = place[some] >> 32
                low, high = np.clip(first + (extent[some] >> BYTES_BITS) - width, 0, count - 1), np.clip(first, 0, count - 1)
                held = np.zeros(count + 1, np.int64)
                np.add.at(held, np.minimum(low, high), 1)
                np.add.at(held, high + 1, -1)
                at = np.flatnonzero(np.cumsum(held)[:-1] > 0)
                start, end = starts[at], ends[at + width - 1]
                columns = [sequence_hashes(hashes, at, at + width).view(np.int64), np.full(len(at), doc_id), start, end, at, at + width]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["window", *_NAMES[:5]])

    return windows


def _passages(min_words: int):
    """Ranges of a document to passages: ranges that overlap become one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, fields = _flat(batch.column(1))
            order = np.lexsort((fields[0], row))
            row, start, end, first, last, new, holders = (x[order] for x in (row, *fields))
            if not len(row):
                continue
            head = _overlapping(row, start, end)
            words = np.maximum.reduceat(last, head) - np.minimum.reduceat(first, head)
            keep = words >= min_words
            out = [
                batch.column(0).to_numpy(zero_copy_only=False)[row[head]], start[head], np.maximum.reduceat(end, head), words,
                np.logical_and.reduceat(new, head), np.maximum.reduceat(holders, head),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], ["doc_id", "start", "end", "n_words", "is_first", "holders"])

    return merge


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least `min_words` words that more than one document holds: doc_id, start, end (bytes), n_words, is_first, holders.

    One row per passage and place. `is_first` says that no document with a smaller id has one of its pieces, so a dedup that cuts the other rows keeps one copy; `holders` is the largest number of
    places of one piece. Words are separated by white space, of whatever kind. Every document with a passage is found; a long passage is reported without the parts of chunks at
    its two ends, some ten words each. Null and empty texts have no passages; texts are taken whole; a
    passage that only one text repeats is not reported. Rows with a null id are left out, repeated rows are copies if their ids differ, an empty table gives an
    empty result, and extra columns are ignored.
    """
    window = cut_window(min_words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    counted = rows.mapInArrow(_digest_rows(window), "digest long, n long, first long, most long")
    # A document is within one slice, so the slices' numbers of documents add up.
    repeated = counted.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("most").alias("most")).where("first < most")
    # Written once, so that the join below has two shuffles of its own and can split a digest that very many places share.
    repeated = materialize(repeated.select("digest", F.shiftright("n", 32).alias("holders"), "first", "most"))
    places = rows.mapInArrow(_piece_rows(window), "digest long, doc_id long, place long, extent long")
    new = F.col("doc_id") == F.col("first")
    hits = materialize(places.join(repeated, "digest").select(
        "digest", "doc_id", "place", "extent", "holders", new.alias("new"), F.when(new, F.col("most")).otherwise(F.col("first")).alias("other"),
    ))
    per_doc = lambda found, *columns: found.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("found"))
    found = per_doc(hits, "place", "extent", "holders", "new", "digest", "other")
    runs = materialize(found.mapInArrow(_stretches(min_words), f"{_RANGE}, digests array<long>"))
    asked = materialize(runs.select(F.explode("digests").alias("digest")).distinct())
    near = per_doc(hits.join(asked, "digest", "left_semi"), "place", "extent")
    windows = materialize(rows.join(materialize(near), "doc_id").mapInArrow(
        _window_rows(min_words), "window long, doc_id long, start long, end long, first long, last long",
    ))
    shared = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("holders"))
    shared = materialize(shared.where("least < most").drop("most"))
    verified = windows.join(shared, "window").withColumn("is_first", F.col("doc_id") == F.col("least"))
    sure = runs.where("digests is null")
    ranges = sure.select(*_NAMES).unionByName(verified.select(*_NAMES))
    out = "doc_id long, start long, end long, n_words long, is_first boolean, holders long"
    return per_doc(ranges, *_NAMES[1:]).mapInArrow(_passages(min_words), out)
