"""Passages of exactly fifty words, of words short and long, against all windows of fifty words."""

import random

import numpy as np
import pytest

from dossier.llm import substring_dedup

WORDS = {
    "figures": lambda draw: draw.choice("0123456789"), "letters": lambda draw: draw.choice("abcdefghijklmnopqrstuvwxyz"),
    "short": lambda draw: "".join(draw.choices("abcdefghij", k=draw.randrange(1, 4))), "two": lambda draw: draw.choice(["ja", "nein"]),
    "prose": lambda draw: "".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 12))), "long": lambda draw: "x" * draw.randrange(1, 3000),
}


def holders(rows):
    seen = {}
    for d, t in rows:
        words = (t or "").split()
        for k in range(len(words) - 49):
            seen.setdefault(tuple(words[k:k + 50]), set()).add(d)
    return {d for found in seen.values() if len(found) > 1 for d in found}


@pytest.mark.parametrize("kind", WORDS)
def test_every_passage_of_fifty_words_is_found(spark, kind):
    draw, rows = random.Random(kind), []
    some = lambda n: [WORDS[kind](draw) for _ in range(n)]
    for pair in range(40):
        passage = some(50 - pair % 2)  # every other pair shares one word too few
        for space in (" ", "\n\t"):
            rows.append((len(rows), space.join(some(draw.randrange(60)) + passage + some(draw.randrange(60)))))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "ab " * 49, "cd " * 50, "cd " * 500, "e f " * 400, "g " + "e f " * 30, "h " * 49 + "i"])]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"] for r in got} == holders(rows)
    assert all(r["n_words"] >= 50 and len(rows[r["doc_id"]][1].encode()[r["start"]:r["end"]].split()) == r["n_words"] for r in got)


@pytest.mark.parametrize("min_words, window", [(50, 7), (20, 2), (8, 1), (1, 1)])
def test_cut_windows_leave_a_whole_piece(min_words, window):
    assert substring_dedup.cut_window(min_words) == window


def test_cuts_of_a_shared_passage_agree_inside_it():
    draw = np.random.default_rng(2)
    for _ in range(200):
        passage = draw.integers(0, 2**63, 50).astype(np.uint64)
        cut = []
        for _ in range(2):
            before = draw.integers(0, 2**63, draw.integers(0, 30)).astype(np.uint64)
            whole = np.concatenate([before, passage, draw.integers(0, 2**63, draw.integers(0, 30)).astype(np.uint64)])
            at = substring_dedup.cuts(whole, np.zeros(len(whole), int), 7) - len(before)
            cut.append({x for x in at.tolist() if 9 <= x <= 43})
        assert cut[0] == cut[1] and len(cut[0]) > substring_dedup.CHUNKS_IN_PIECE
