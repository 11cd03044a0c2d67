"""Ranked lexical search by NRA: lists sorted by impact are read in order, never probed.

Tasks cut whole texts into terms and write, per document, its length and the counts of those terms that a query holds.
From the numbers of all documents follow the terms' weights, and with them every posting's impact. Each task then takes its documents
in blocks, sorts a block's postings of a term by impact, and reads an item's lists downwards together: a document's
lower bound is the sum of the impacts read, its upper bound adds, for every list that has not shown it, the impact that the list
stands at. An unread document cannot come in once the lists' standing impacts sum to less than the k-th lower bound (a task's
earlier blocks count for that bound); from there on only documents whose upper bound still reaches the k-th lower one matter,
and reading goes on until none of them has an open interval. Ties at the k-th place stay in until then, so the final cut by doc_id
is exact. Tasks give at most k documents an item; a ranked cut over them is the result.

Defined cases: a null or termless text is in no list and does not count; rows with the same item_id are one item with the terms of
all; an item without a term or a hit has no rows. Repeated documents are documents of their own; equal scores go by ascending
doc_id, null first. No documents or no items give no rows. Extra columns are ignored. Items are taken in passes of about ITEM_TERMS
terms, so what is sent to the tasks is bounded whatever the number of items; a pass reads all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import LOWER, WORD_BYTE, slices, span_hashes, text_bytes, word_spans
from dossier.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of items in a pass; documents and postings in a block; the share by which the reading depth falls each time.
ITEM_TERMS, BLOCK_DOCS, BLOCK_POSTINGS, DEPTH = 500_000, 16_384, 2_000_000, 0.6


class Vocabulary:
    """Terms of a pass by number, found by hash and verified by their bytes."""

    def __init__(self, terms: list[str]):
        coded = [t.encode() for t in terms]
        ends = np.cumsum([0, *map(len, coded)])
        data = np.frombuffer(b"".join(coded), np.uint8)
        hashes = span_hashes(data, ends[:-1], ends[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.starts, self.lengths = hashes[self.order], data, ends[:-1], np.diff(ends)

    def __len__(self) -> int:
        return len(self.lengths)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and the terms' numbers."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[word]]
        size = ends[word] - starts[word]
        same = size == self.lengths[term]
        word, term, size = word[same], term[same], size[same]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = data[np.repeat(starts[word], size) + within] != self.data[np.repeat(self.starts[term], size) + within]
        good = np.ones(len(word), bool)
        good[np.repeat(np.arange(len(word)), size)[differs]] = False
        return word[good], term[good]


def counted(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, n (terms of the text), terms and tfs (those of the vocabulary with their counts); texts without a term go."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for first, last in slices(offsets):
            text = LOWER[data[offsets[first]:offsets[last]]]
            rows = offsets[first:last + 1] - offsets[first]
            starts, ends = word_spans(WORD_BYTE[text], rows[:-1])
            row = np.searchsorted(rows, starts, "right") - 1
            n = np.bincount(row, minlength=last - first)
            word, term = vocabulary.find(text, starts, ends)
            key, tf = np.unique(row[word] * max(1, len(vocabulary)) + term, return_counts=True)
            kept = np.flatnonzero(n > 0)
            at = np.searchsorted(key, np.append(kept, last - first) * max(1, len(vocabulary))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (key % max(1, len(vocabulary)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(kept)), pa.array(n[kept]), *lists], ["doc_id", "n", "terms", "tfs"])


class Best:
    """An item's k best documents of a task so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def bar(self) -> int:
        """The score that a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.append(self.score, score), np.append(self.doc, doc), np.append(self.null, null)
        best = np.lexsort((doc, ~null, -score))[:self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """NRA over one item's lists of (documents, falling impacts): the documents that can be among the k best, and their exact scores.

    bar: a score, one at least, below which no document counts.
    """
    lower, shown = np.zeros(docs, np.int64), np.zeros((len(lists), docs), bool)
    place = np.zeros(len(lists), np.int64)
    stands = np.array([impact[0] for _, impact in lists], np.int64)
    depth, open_to_all, inside = stands.max(initial=0) * DEPTH, True, np.ones(docs, bool)
    while True:
        for t, (doc, impact) in enumerate(lists):
            end = len(impact) - np.searchsorted(impact[::-1], depth, "left")
            if end > place[t]:
                new, more = doc[place[t]:end], impact[place[t]:end]
                if not open_to_all:
                    kept = inside[new]
                    new, more = new[kept], more[kept]
                lower[new] += more
                shown[t, new] = True
                place[t], stands[t] = end, impact[end] if end < len(impact) else 0
        limit = bar if docs < k else max(bar, int(np.partition(lower, docs - k)[docs - k]))
        rest = int(stands.sum())
        if open_to_all and rest < limit:
            open_to_all, inside = False, lower > 0
        if not open_to_all:
            some = np.flatnonzero(inside)
            upper = lower[some] + rest - stands @ shown[:, some]
            inside[some[upper < limit]] = False
            if (upper == lower[some])[upper >= limit].all():
                found = some[upper >= limit]
                return found, lower[found]
        depth = depth * DEPTH if depth >= 1 else 0


def ranked(batches: Iterator[pa.RecordBatch], query: dict, k: int) -> Iterator[pa.RecordBatch]:
    """item, doc_id, score: the k best documents of a task for each item."""
    weight, n_docs, n_terms, item_terms, item_at = (query[x] for x in ("weight", "docs", "terms", "item_terms", "item_at"))
    best = [Best(k) for _ in range(len(item_at) - 1)]

    def block(rows: pa.Table) -> None:
        doc_id, n = rows["doc_id"].combine_chunks(), rows["n"].to_numpy()
        terms, tf = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), pc.list_value_length(terms).to_numpy())
        term = terms.flatten().to_numpy().astype(np.int64)
        m = 50 + 50 * n * n_docs // n_terms
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((-impact, term))
        order = order[impact[order] > 0]
        doc, term, impact = doc[order], term[order], impact[order]
        at = np.searchsorted(term, np.arange(len(weight) + 1))
        null, ids = doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy()
        for i, found in enumerate(best):
            lists = [(doc[at[t]:at[t + 1]], impact[at[t]:at[t + 1]]) for t in item_terms[item_at[i]:item_at[i + 1]] if at[t + 1] > at[t]]
            if lists and sum(int(x[0]) for _, x in lists) >= found.bar():
                which, score = resolve(lists, len(n), k, found.bar())
                found.add(score, ids[which], null[which])

    held, docs, postings = [], 0, 0
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            held.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                block(pa.Table.from_batches(held))
                held, docs, postings = [], 0, 0
    if docs:
        block(pa.Table.from_batches(held))
    for i, found in enumerate(best):
        if len(found.score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.score), i, np.int32)), pa.array(found.doc, mask=found.null), pa.array(found.score)], ["item", "doc_id", "score"])


def _one_pass(docs: DataFrame, entries: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    rows = entries.collect()
    items = {}
    for r in rows:
        items.setdefault(r["item_id"], []).append(r["term"])
    if not items:
        return None
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    vocabulary = spark.sparkContext.broadcast(Vocabulary(terms))
    index = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: counted(batches, vocabulary.value), "doc_id long, n long, terms array<int>, tfs array<int>"))
    total = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    holders = {r["term"]: r["count"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    query = spark.sparkContext.broadcast({
        "weight": weight, "docs": total["docs"], "terms": total["terms"], "item_terms": np.array([number[t] for x in items.values() for t in x]),
        "item_at": np.cumsum([0, *map(len, items.values())]),
    })
    found = index.where(F.size("terms") > 0).mapInArrow(lambda batches: ranked(batches, query.value, k), "item int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {entries.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "item").drop("item")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k best documents with a score above 0."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWERED), F.lit(TERM), F.lit(0))
    entries = items.select("item_id", F.explode(words).alias("term")).distinct()
    passes = entries.count() // item_terms + 1
    parts = [_one_pass(docs, entries.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p), k) for p in range(passes)]
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long"
    found = docs.sparkSession.createDataFrame([], kinds)
    for part in parts:
        found = found.unionByName(part) if part is not None else found
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
