"""Question columns: keywords, overlap, prefix similarity, class, time sensitivity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import text as T


def keywords(text: Column) -> Column:
    tokens = F.filter(T.find_all(F.lower(text), "[a-z0-9][a-z0-9_-]*"), lambda t: F.length(t) > 2)
    return F.array_except(F.array_distinct(tokens), F.array(*[F.lit(w) for w in K.STOPWORDS]))


def keyword_overlap(question_words: Column, chunk_words: Column) -> Column:
    hits = F.size(F.array_intersect(question_words, chunk_words))
    return F.when(F.size(question_words) > 0, hits / F.size(question_words)).otherwise(0.0)


def prefix_words(content: Column) -> Column:
    return F.array_distinct(T.words(F.lower(F.substring(content, 1, K.PREFIX_CHARS))))


def jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def classify_by_pattern(question: Column) -> Column:
    chain = None
    for kind, pattern in K.QUESTION_PATTERNS:
        hit = question.rlike("(?iU)" + pattern)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise(K.DEFAULT_QUESTION_TYPE)


def classification_prompt(question: Column) -> Column:
    """Asks a model for one of the question types; the question comes last."""
    kinds = ", ".join(K.QUESTION_TYPES)
    return F.concat(F.lit(f"Name the type of the question below. Reply with one of these words alone: {kinds}.\n\nQuestion: "), question)


def classify(question: Column, override: Column | None = None, model_answer: Column | None = None) -> Column:
    """The caller's type, else a valid model answer, else the pattern rules."""
    options = []
    if override is not None:
        options.append(F.when(override != "", override))
    if model_answer is not None:
        answer = F.rtrim(F.lower(T.strip(model_answer)), F.lit("."))
        options.append(F.when(answer.isin(K.QUESTION_TYPES), answer))
    return F.coalesce(*options, classify_by_pattern(question))


def is_time_sensitive(question: Column, terms: str = K.TIME_SENSITIVE_TERMS) -> Column:
    return question.rlike(T.term_pattern(terms))


def denied_phrase(text: Column) -> Column:
    """First phrase of the word policy found in the text, else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), p) for p in K.DENIED_PHRASES])
