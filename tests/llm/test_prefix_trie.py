"""Trie nodes against a trie of Python dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from dossier.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, p1 int, bytes int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    talks = {}
    for c, t, r, x in rows:
        if c is not None:
            talks.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    talks = {c: [x[3:] for x in sorted(t)] for c, t in talks.items()}
    members = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(talks.get(c - c % 5, [])[:h] + talks[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole)))
    out = []
    for node, found in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = lambda x: [y for y in members if len(y) == len(x) + 1 and y[:len(x)] == x]
        out.append((
            min(c for c, _ in found), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(found), len(children(node)),
            sum(not children(x) for x in below), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
            hashlib.sha256(",".join(str(c) for c, n in sorted(found) if n == len(node)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def drawn(seed, n):
    draw = random.Random(seed)
    texts = ["", None, "ja", "nein", "漢字", "Word " * 3000]
    rows = [(c, t, draw.choice(["user", "tool", None]), draw.choice(texts)) for c in draw.sample(range(-20, 80), n) for t in range(draw.randrange(1, 7))]
    rows += [(c, t, "user", "copy") for c in range(200, 260) for t in range(9)] + [(c, t, "user", f"{c}") for c in range(300, 303) for t in range(12)]
    rows += [(7, None, "user", "a"), (7, None, "user", "b"), (7, 3, None, None), (7, 3, None, None), (None, 1, "user", "lost"), (90, 0, "user", "short")]
    return rows


@pytest.mark.parametrize("light, crown", [(10_000, 1_000_000), (3, 1_000_000), (1, 40), (30, 1_000_000)])
def test_nodes_equal_brute_force(spark, light, crown):
    rows = drawn(4, 30)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.nodes(df, light, crown)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_blocks_of_ids_hash_as_one_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rows = drawn(9, 12)
    got = prefix_trie.nodes(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), light=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_no_rows(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "user", "x", "", 1, 1)], SCHEMA)).count() == 0


def test_a_conversation_whose_opening_nobody_lends_is_empty(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert [tuple(r)[:5] for r in prefix_trie.nodes(spark.createDataFrame([(c, 0, "user", "x", "", 1, 1)], SCHEMA)).collect()] == [(c, 0, None, 1, 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_perfect_and_verified(n):
    draw = np.random.default_rng(n)
    key = [draw.integers(-2**62, 2**62, n), draw.integers(-2**62, 2**62, n), draw.integers(0, 9, n)]
    table = prefix_trie.SlotTable(*key)
    assert sorted(table.find(*key).tolist()) == list(range(n))
    other = [draw.integers(-2**62, 2**62, 500), draw.integers(-2**62, 2**62, 500), draw.integers(0, 9, 500)]
    assert (table.find(*other) == -1).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="equal keys"):
        prefix_trie.SlotTable(np.array([1, 1]), np.array([2, 2]), np.array([3, 3]))


def test_two_sequences_under_one_digest_stop_the_job(spark):
    rows = spark.createDataFrame([(1, 1, 5, 6, 2, True, 9, 9), (2, 1, 7, 6, 2, True, 9, 9)], "conv long, depth long, a long, b long, bytes long, is_end boolean, p1 long, p2 long")
    with pytest.raises(Exception, match="share a digest"):
        prefix_trie.distinct_nodes(rows).collect()
