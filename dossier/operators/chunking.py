"""Chunkers: one document row to many chunk rows, without a shuffle.

Each chunker is an array expression, exploded once, so a chunk never leaves the
task that read its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import text as T

CHUNK_TYPE = "array<struct<content:string,parent_content:string,is_child:boolean>>"


def _chunk(content: Column, parent: Column | None = None) -> Column:
    return F.struct(
        content.alias("content"),
        (parent if parent is not None else F.lit(None).cast("string")).alias("parent_content"),
        F.lit(parent is not None).alias("is_child"),
    )


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` words as strings; none for no words."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        steps = F.ceil((F.size(w) - size) / F.lit(step)).cast("int")
        last = F.greatest(steps, F.lit(0)) * step
        joined = F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "),
        )
        return F.when(F.size(w) > 0, joined).otherwise(F.array().cast("array<string>"))

    return T.let(tokens, cut)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    return F.transform(windows(T.words(text), size, overlap), lambda c: _chunk(c))


def hierarchical_chunks(text: Column) -> Column:
    """Each parent window followed by its child windows; a child equal to its parent is left out."""

    def family(parent: Column) -> Column:
        children = F.filter(
            windows(F.split(parent, " "), K.CHILD_WORDS, K.CHILD_OVERLAP), lambda c: c != parent
        )
        return F.concat(F.array(_chunk(parent)), F.transform(children, lambda c: _chunk(c, parent)))

    return F.flatten(F.transform(windows(T.words(text), K.PARENT_WORDS, K.CHILD_OVERLAP), family))


def sentences(text: Column) -> Column:
    parts = F.split(text, f"(?U)(?<=[.!?]){T.SPACE}+(?=[A-Z])")
    cut = F.transform(
        parts,
        lambda s: F.when(F.length(s) > K.SENTENCE_LINE_SPLIT_CHARS, F.split(s, T.LINE_BREAK)).otherwise(F.array(s)),
    )
    return F.filter(F.transform(F.flatten(cut), T.strip), lambda s: s != "")


def sentence_spans(lengths: Column, window_chars: int = K.SENTENCE_WINDOW_CHARS) -> Column:
    """Closed windows as (first, last) sentence indexes, found in one pass over the lengths.

    A window closes when its characters reach the limit; the next one starts again at
    its last sentence, or behind it if it held only one.
    """
    start = F.struct(
        F.lit(0).alias("first"), F.lit(0).alias("chars"), F.lit(0).alias("at"),
        F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
    )

    def step(acc: Column, n: Column) -> Column:
        chars = acc["chars"] + n + 1
        closes = chars >= window_chars
        span = F.struct(acc["first"].alias("first"), acc["at"].alias("last"))
        alone = acc["first"] == acc["at"]
        reopened = F.when(alone, 0).otherwise(n + 1)
        # A single reopened sentence that alone reaches the limit closes at once.
        again = closes & ~alone & (n + 1 >= window_chars)
        only = F.struct(acc["at"].alias("first"), acc["at"].alias("last"))
        spans = (
            F.when(again, F.concat(acc["spans"], F.array(span, only)))
            .when(closes, F.array_append(acc["spans"], span))
            .otherwise(acc["spans"])
        )
        first = (
            F.when(again | (closes & alone), acc["at"] + 1)
            .when(closes, acc["at"])
            .otherwise(acc["first"])
        )
        return F.struct(
            first.cast("int").alias("first"),
            F.when(again, 0).when(closes, reopened).otherwise(chars).cast("int").alias("chars"),
            (acc["at"] + 1).cast("int").alias("at"),
            spans.alias("spans"),
        )

    def finish(acc: Column) -> Column:
        # The open window is emitted, then once more its last sentence alone.
        last = acc["at"] - 1
        rest = F.struct(acc["first"].alias("first"), last.alias("last"))
        tail = F.struct(last.alias("first"), last.alias("last"))
        return (
            F.when(acc["first"] < last, F.concat(acc["spans"], F.array(rest, tail)))
            .when(acc["first"] == last, F.array_append(acc["spans"], rest))
            .otherwise(acc["spans"])
        )

    return F.aggregate(lengths, start, step, finish)


def sentence_chunks(text: Column) -> Column:
    def cut(s: Column) -> Column:
        return F.transform(
            sentence_spans(F.transform(s, F.length)),
            lambda p: _chunk(F.array_join(F.slice(s, p["first"] + 1, p["last"] - p["first"] + 1), " ")),
        )

    return T.let(sentences(text), cut)


def chunk_array(text: Column, strategy: Column) -> Column:
    """Chunks of a text under its strategy; an unknown strategy is cut like ``fixed_512``."""
    chunks = (
        F.when(strategy == "hierarchical", hierarchical_chunks(text))
        .when(strategy == "sentence", sentence_chunks(text))
        .when(strategy == "fixed_256", fixed_chunks(text, *K.FIXED_WINDOWS["fixed_256"]))
        .otherwise(fixed_chunks(text, *K.FIXED_WINDOWS["fixed_512"]))
    )
    blank = T.strip(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, F.array().cast(CHUNK_TYPE)).otherwise(chunks.cast(CHUNK_TYPE))


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    return T.explode_rows(df, keep, chunks, "c", "chunk_index").select(
        *keep, "chunk_index", "c.content", "c.parent_content", "c.is_child"
    )


def chunk_documents(df: DataFrame, text: str = "extracted_text", strategy: str = "chunking_strategy",
                    keep: list[str] | None = None) -> DataFrame:
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    return explode_chunks(df, chunk_array(F.col(text), F.col(strategy)), keep)
