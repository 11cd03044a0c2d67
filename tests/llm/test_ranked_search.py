"""Rankings against a full count, and the reading itself against full sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dossier.llm import ranked_search

SCHEMA = "doc_id long, text string, score long, item_id long, n int, terms string"
TERM = re.compile(ranked_search.TERM)


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    holders = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c, n in counted:
            m = 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holders[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def drawn(seed, n, words):
    draw = random.Random(seed)
    rank = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(words)]
    text = lambda: draw.choice([" ", "-", "\n"]).join(draw.choices(rank, [1 / (i + 1) for i in range(words)], k=draw.randrange(0, 40)))
    return [(i, text()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], SCHEMA)


@pytest.mark.parametrize("block, item_terms", [(16_384, 500_000), (40, 30)])
def test_ranking_equals_full_count(spark, monkeypatch, block, item_terms):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    docs = drawn(1, 400, 60) + [(500, None), (501, ""), (502, " ,;"), (503, "w1 " * 40_000), (7, "w3 w4 w5"), (7, "w3 w4 w5"), (None, "w3 w4 w5"), (504, "漢字 w2" * 3)]
    items = [(i, t) for i, t in drawn(2, 12, 70)] + [(90, None), (91, "nowhere"), (92, "w3 w4"), (92, "W5"), (None, "w2 w9"), (93, "w3w4w5"), (94, "漢字")]
    renamed = frame(spark, items).drop("item_id").withColumnRenamed("doc_id", "item_id")
    for k in (5, 50):
        got = ranked_search.search(frame(spark, docs).repartition(3), renamed, k, item_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, k)


def test_many_ties_go_by_doc_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(1000, "other")] * 400
    items = [(1, "words here"), (2, "other same")]
    renamed = frame(spark, items).drop("item_id").withColumnRenamed("doc_id", "item_id")
    got = ranked_search.search(frame(spark, docs).repartition(4), renamed)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 50)


def test_no_rows(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b")])
    assert ranked_search.search(none, some).count() == 0 == ranked_search.search(some, none).count()
    assert ranked_search.search(frame(spark, [(1, None), (2, " ")]), some).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_reading_stops_with_exact_scores(seed):
    draw = np.random.default_rng(seed)
    docs, k = int(draw.integers(1, 300)), int(draw.integers(1, 20))
    lists, whole = [], np.zeros(docs, np.int64)
    for _ in range(draw.integers(1, 12)):
        doc = draw.permutation(docs)[:draw.integers(1, docs + 1)]
        impact = -np.sort(-draw.integers(1, draw.choice([3, 50, 10**9]), len(doc)))
        whole[doc] += impact
        lists.append((doc, impact))
    bar = int(draw.choice([1, np.sort(whole)[-min(k, docs)] + draw.integers(-1, 2)]))
    found, score = ranked_search.resolve(lists, docs, k, max(bar, 1))
    assert (whole[found] == score).all()
    need = max(bar, 1, np.sort(whole)[-k] if docs >= k else 0)
    assert set(np.flatnonzero(whole >= need)) <= set(found.tolist())


def test_a_hash_alone_does_not_make_a_term(monkeypatch):
    monkeypatch.setattr(ranked_search, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    vocabulary = ranked_search.Vocabulary(["ab"])
    data = np.frombuffer(b"ab ac abc ab", np.uint8)
    word, term = vocabulary.find(data, np.array([0, 3, 6, 10]), np.array([2, 5, 9, 12]))
    assert word.tolist() == [0, 3] and term.tolist() == [0, 0]
