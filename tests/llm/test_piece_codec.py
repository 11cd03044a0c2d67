"""Ids and texts against the library itself."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from dossier.llm import piece_codec
from dossier.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "   " * 7, "a", " a  b ", "\t\n x", "▁", "▁▁x ▁", "漢字 仮名", "\U0001f600\U0001f600 é ÿ ſ", "<s></s><unk><0x41>", "a\u0000b", "--------", "  \n    def f(x):\n        return x",
        "x" * 5000, "ab" * 3000, " " * 999, "the " * 4000, "ation" * 50]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.load_vocabulary(PATH)


def drawn(vocabulary, n, seed=11):
    draw = random.Random(seed)
    pieces = [p for p, k in zip(vocabulary.pieces, vocabulary.kinds) if k == "n"]
    for _ in range(n):
        yield draw.choice([
            lambda: "".join(draw.choices(HARD[4:12] + [" ", "  "], k=draw.randrange(1, 12))),
            lambda: "".join(draw.choices(pieces, k=draw.randrange(1, 10))),
            lambda: "".join(p[:draw.randrange(1, len(p) + 1)] for p in draw.choices(pieces, k=draw.randrange(1, 10))),
            lambda: "".join(draw.choices("ab  ", k=draw.randrange(1, 60))),
        ])()


def test_ids_and_texts_equal_the_library(spark, model, vocabulary):
    texts = HARD + list(drawn(vocabulary, 3000)) + [None]
    rows = [(i, t, "extra", [1]) for i, t in enumerate(texts)] + [(0, "twice", "extra", None), (0, "twice", "extra", None), (None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    got = piece_codec.decode(piece_codec.encode(docs, vocabulary), vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        want = model.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == model.decode(want), repr(r["text"])


def test_any_ids_decode_as_in_the_library(spark, model, vocabulary):
    draw = random.Random(3)
    lists = [[], [0], [1, 2], [1, 28705, 259], [3 + 0xC3, 1, 3 + 0xA9], [3 + 0xC3, 3 + 0xA9], [3 + 0xFF, 28705]]
    lists += [draw.choices(range(32000), k=3) + draw.choices(range(259), k=draw.randrange(8)) for _ in range(500)]
    for one in lists[7:]:
        draw.shuffle(one)
    df = spark.createDataFrame([(x,) for x in [*lists, None]], "ids array<int>")
    for r in piece_codec.decode(df, vocabulary).collect():
        assert r["decoded"] == (None if r["ids"] is None else model.decode(r["ids"])), r["ids"]
    with pytest.raises(Exception, match="outside the vocabulary"):
        piece_codec.decode(spark.createDataFrame([([32000],)], "ids array<int>"), vocabulary).collect()


def test_small_lookup_tables_change_nothing(model, vocabulary, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT", 2)
    encoder = piece_codec.Encoder(vocabulary)
    for text in drawn(vocabulary, 300, seed=5):
        assert memoryview(encoder.encode(text)).cast("i").tolist() == model.encode(text)


def test_query_gives_digests_of_ids_and_text(spark, model):
    small = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_piece_codec"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = model.encode(r["text"] or "")
        one = got[r["doc_id"]]
        assert one["n_tokens"] == len(ids) and one["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert one["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_no_rows(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert piece_codec.digests(none, vocabulary).count() == 0
