"""SentencePiece BPE ids of whole texts, and texts of ids.

A sequence of pieces is the library's result exactly if every two neighbours, put together and merged anew,
come out as the same two pieces. Encoding therefore walks forward: it takes the longest piece that starts at
a place (found for all places by one Aho-Corasick pass), falls back to that piece's shorter prefixes where the
pair with the piece before does not hold, and steps back where none holds; a bit per place remembers those
from which no way leads on, so that none is tried twice. No piece holds a space after another character, hence
a text falls apart before every run of spaces and the parts are encoded alone; equal parts are looked up.

Decoding takes every piece's bytes from one flat table and joins them.

Defined cases: a null text counts as empty; an empty text has no ids; a character without a piece becomes the
pieces of its bytes; rows are independent, so repeated rows give equal results, and all other columns stay as
they are. The two new columns replace columns of their names. Null ids decode to null, ids outside the
vocabulary raise an error. Only the vocabulary (some hundred kilobytes) is sent to the tasks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import slices, text_bytes

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Entries of a task's lookup tables before they are emptied, and the longest part that is kept in one.
KEPT, KEPT_CHARS = 600_000, 48
UNKNOWN_TEXT = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores; kind is n (text), b (byte), c (control) or u (unknown)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file. Only BPE models that keep the text as it is, put a space before it and fall back to bytes are taken."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "u" if model.is_unknown(i) else "c" if model.is_control(i) else "b" if model.is_byte(i) else "n"
    found = Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), "".join(map(kind, ids)))
    texts = [p for p, k in zip(found.pieces, found.kinds) if k == "n"]
    probe = "  a　ﬁ é \t b "
    known = set(texts)
    if (
        model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or found.kinds.count("b") != 256
        or any(model.is_unused(i) for i in ids) or any(SPACE in p.lstrip(SPACE) for p in texts) or any(c not in known for p in texts for c in p)
    ):
        raise ValueError(f"{path}: this codec needs a byte-fallback model without text normalisation")
    return found


class Encoder:
    """Ids of texts; lives in a task and keeps what it has already worked out."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.text, self.score = vocabulary.pieces, vocabulary.scores
        self.id = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if k == "n"}
        self.byte = [i for i, k in enumerate(vocabulary.kinds) if k == "b"]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.text]
        self.shorter = [self._prefix(p) if k == "n" else -1 for p, k in zip(vocabulary.pieces, vocabulary.kinds)]
        self.characters = frozenset(p for p in self.id if len(p) == 1)
        self.base = len(self.text)
        self.holds: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}

    def _prefix(self, piece: str) -> int:
        return next((self.id[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.id), -1)

    def merged(self, text: str) -> list[int]:
        """Merge characters that all have pieces: the best score first, then the leftmost."""
        parts = [self.id[c] for c in text]
        while True:
            best, at, new = -np.inf, -1, -1
            for k in range(len(parts) - 1):
                both = self.id.get(self.text[parts[k]] + self.text[parts[k + 1]])
                if both is not None and self.score[both] > best:
                    best, at, new = self.score[both], k, both
            if at < 0:
                return parts
            parts[at:at + 2] = [new]

    def _pair_holds(self, a: int, b: int) -> bool:
        if len(self.holds) >= KEPT * 8:
            self.holds.clear()
        found = self.holds[a * self.base + b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return found

    def known(self, part: str) -> list[int]:
        """Ids of a part whose characters all have pieces."""
        size, lengths, shorter, base, holds = len(part), self.length, self.shorter, self.base, self.holds
        longest = [0] * size
        for end, i in self.automaton.iter(part):
            longest[end - lengths[i] + 1] = i  # ends ascend, so the longest is written last
        failed = bytearray(size // 8 + 1)
        out: list[int] = []
        at, piece, last = 0, longest[0], -1
        while True:
            end = at + lengths[piece]
            if failed[end >> 3] >> (end & 7) & 1:
                fits = False
            elif last < 0:
                fits = True
            else:
                fits = holds.get(last * base + piece)
                if fits is None:
                    fits = self._pair_holds(last, piece)
            if fits:
                out.append(piece)
                if end == size:
                    return out
                at, last, piece = end, piece, longest[end]
                continue
            piece = shorter[piece]
            while piece < 0:  # nothing goes on from here: the piece before must be a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= lengths[piece]
                piece = shorter[piece]
                last = out[-1] if out else -1

    def part(self, part: str) -> bytes:
        """Ids of a part as int32 bytes; characters without a piece never merge, so they split it."""
        found = self.parts.get(part)
        if found is not None:
            return found
        if self.characters.issuperset(part):
            ids = self.known(part)
        else:
            ids, start = [], 0
            for k, c in enumerate(part):
                if c not in self.characters:
                    if k > start:
                        ids += self.known(part[start:k])
                    ids += [self.byte[b] for b in c.encode()]
                    start = k + 1
            if start < len(part):
                ids += self.known(part[start:])
        found = array("i", ids).tobytes()
        if len(part) <= KEPT_CHARS:
            if len(self.parts) >= KEPT:
                self.parts.clear()
            self.parts[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        get, part = self.parts.get, self.part
        return b"".join([get(p) or part(p) for p in PART.findall(SPACE + text.replace(" ", SPACE))])


_TOOLS: dict[type, tuple[Vocabulary, object]] = {}


def _tool(kind: type, vocabulary: Vocabulary):
    """The worker's encoder or decoder of this vocabulary; tasks of the same worker share it."""
    found = _TOOLS.get(kind)
    if found is None or found[0] != vocabulary:
        found = _TOOLS[kind] = (vocabulary, kind(vocabulary))
    return found[1]


class Decoder:
    """Texts of id lists, by the library's rules."""

    def __init__(self, vocabulary: Vocabulary):
        self.kinds = np.frombuffer(vocabulary.kinds.encode(), np.uint8)
        shown = {"n": lambda p: p.replace(SPACE, " ").encode(), "c": lambda p: b"", "u": lambda p: UNKNOWN_TEXT.encode(),
                 "b": lambda p: bytes([int(p[3:5], 16)])}
        self.bytes = [shown[k](p) for p, k in zip(vocabulary.pieces, vocabulary.kinds)]
        self.table = pa.array(self.bytes, pa.large_binary())
        self.spaced = np.array([k == "n" and p.startswith(SPACE) for p, k in zip(vocabulary.pieces, vocabulary.kinds)])

    def one(self, ids: np.ndarray) -> str:
        """Any ids: bytes that make no character show as U+FFFD each, and the first text piece loses one space."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if self.kinds[i] == ord("b"):
                run += self.bytes[i]
                first = False
                continue
            out.append(_characters(run))
            run.clear()
            text = self.bytes[i].decode()
            if first and self.spaced[i]:
                text = text[1:]
            first = first and self.kinds[i] == ord("c")
            out.append(text)
        return "".join([*out, _characters(run)])

    def batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids that lie one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.kinds)):
            raise ValueError("an id lies outside the vocabulary")
        taken = self.table.take(pa.array(ids))
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64)[taken.offset:taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        begin, end = at[offsets[:-1]].copy(), at[offsets[1:]]
        view = memoryview(data) if data is not None else memoryview(b"")
        rows = np.flatnonzero(np.diff(offsets) > 0)
        heads = ids[offsets[rows]]
        begin[rows[self.spaced[heads]]] += 1
        controls = np.flatnonzero(self.kinds[ids] == ord("c"))  # they keep bytes on their two sides apart
        odd = {*rows[self.kinds[heads] != ord("n")].tolist(), *(np.searchsorted(offsets, controls, "right") - 1).tolist()}
        texts = []
        for r in range(len(begin)):
            try:
                if r not in odd:
                    texts.append(str(view[begin[r]:end[r]], "utf-8"))
                    continue
            except UnicodeDecodeError:
                pass
            texts.append(self.one(ids[offsets[r]:offsets[r + 1]]))
        return pa.array(texts, pa.string())


def _characters(run: bytearray) -> str:
    out, at = [], 0
    while at < len(run):
        for n in range(1, 5):
            try:
                out.append(run[at:at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(name)
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of df and the ids of their texts."""
    kept, schema = _with_column(df, ids, T.ArrayType(T.IntegerType(), False))
    shared, names = df.sparkSession.sparkContext.broadcast(vocabulary), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tool(Encoder, shared.value)
        for batch in batches:
            column = batch.column(names.index(text))
            for first, last in slices(text_bytes(column)[1]):
                rows = [encoder.encode(t or "") for t in column.slice(first, last - first).to_pylist()]
                at = np.cumsum([0, *map(len, rows)]) // 4
                found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, found], [*names, ids])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of df and the texts of their ids."""
    kept, schema = _with_column(df, text, T.StringType())
    shared, names = df.sparkSession.sparkContext.broadcast(vocabulary), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tool(Decoder, shared.value)
        for batch in batches:
            column = batch.column(names.index(ids))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = column.flatten()
            for first, last in slices(offsets, 500_000):
                part = flat.slice(offsets[first], offsets[last] - offsets[first]).to_numpy(zero_copy_only=False)
                found = decoder.batch(part, offsets[first:last + 1] - offsets[first])
                if column.null_count:
                    found = pc.if_else(column.slice(first, last - first).is_null(), pa.scalar(None, pa.string()), found)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, found], [*names, text])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of the text they decode to."""
    coded = decode(encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
