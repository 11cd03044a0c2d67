"""Language ID by Bayesian fusion of evidence.

The posterior of a language is proportional to its prior at the document's host, times the likelihood of the text, of
the language that the markup declares and of the address's suffix. Text likelihoods are
counts of byte trigrams by language. Host priors come from grouped sums of what the texts alone say, smoothed
from the whole corpus down the parts of the host name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import LOWER, slices, text_bytes
from dossier.session import materialize

#: Buckets of byte trigrams.
BUCKETS = 1 << 13
#: Neighbouring trigrams share bytes, so their joint evidence counts this much.
TEXT_WEIGHT = 0.3
#: Documents' worth of prior that a host takes from its parent.
PRIOR_WEIGHT = 10.0
#: Probability that a declared language or a country suffix names the true one.
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.7
#: The name of "no known language", with uniform trigrams, and its prior weight.
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.01
MIN_POSTERIOR = 0.5

#: Country suffixes and the language each speaks for (fixed values).
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en",
    "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "se": "sv", "jp": "ja", "ru": "ru",
}


#: Bytes that trigrams are made of: letters, all that is not ASCII, and the space. Digits and signs say nothing of a language.
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[[32, *range(97, 123), *range(128, 256)]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at every byte of some rows, and where each row's trigrams start; those with digits or signs are left out."""
    own = LOWER[data[offsets[0]:offsets[-1]]].astype(np.uint32)
    if len(own) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = own[:-2] * np.uint32(0x9E3779B1) + own[1:-1] * np.uint32(0x85EBCA77) + own[2:] * np.uint32(0xC2B2AE3D)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)
    ends = offsets[1:] - offsets[0]
    plain = LETTER_BYTE[own]
    letter = plain & (own != 32)
    inside = plain[:-2] & plain[1:-1] & plain[2:] & (letter[:-2] | letter[1:-1] | letter[2:])
    for back in (1, 2):  # a trigram must not reach into the next row
        cross = ends - back
        inside[cross[(cross >= 0) & (cross < len(code))]] = False
    total = np.concatenate([[0], np.cumsum(inside)])
    return code[inside], total[np.minimum(offsets - offsets[0], len(code))]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and bucket over a whole task: at most one row per language and bucket."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        language = np.array(batch.column(0).to_pylist(), object)
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets):
            code, at = trigrams(data, offsets[a:b + 1])
            names, number = np.unique(language[a:b].astype(str), return_inverse=True)
            both = np.repeat(number, np.diff(at)) * BUCKETS + code
            found = np.bincount(both, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, found):
                counts[name] = counts.get(name, 0) + row
    for name, row in counts.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(row[some])], ["language", "bucket", "n"])


def train(labelled: DataFrame, language_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-likelihood of every bucket under each, from all labelled rows; the last is UNKNOWN."""
    rows = labelled.select(F.col(language_col).alias("language"), F.col(text_col).alias("text")).where("language is not null and language <> ''")
    counted = rows.mapInArrow(_count_rows, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most BUCKETS rows per language
    languages = sorted(found["language"].unique())
    table = np.full((len(languages) + 1, BUCKETS), 0.5)
    number = {name: i for i, name in enumerate(languages)}
    table[found["language"].map(number).to_numpy(int), found["bucket"].to_numpy(int)] += found["n"].to_numpy(float)
    table[-1] = 1.0
    return [*languages, UNKNOWN], np.log(table / table.sum(axis=1, keepdims=True))


def _likelihood_rows(model: np.ndarray):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            parts, sizes = [], []
            for a, b in slices(offsets):
                code, at = trigrams(data, offsets[a:b + 1])
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(row[code])])[at]) for row in model]
                parts.append(np.stack(sums, axis=1))
                sizes.append(np.diff(at))
            x = np.concatenate(parts) * TEXT_WEIGHT if parts else np.zeros((0, len(model)))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(model), dtype=np.int32), x.ravel())
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], lists, pa.array(n)], ["id", "host", "declared", "suffix", "likelihood", "n_trigrams"],
            )

    return measure


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def _sums(x: Column, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(x[i]), F.lit(0.0)) for i in range(n)])


def _host_priors(texts: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """Prior of every host, and of the whole corpus. The host a.b.c takes from b.c, that from c, that from the corpus."""
    start = [(1 - UNKNOWN_PRIOR) / max(n - 1, 1)] * (n - 1) + [UNKNOWN_PRIOR]
    hosts = materialize(texts.groupBy("host").agg(_sums(F.col("share"), n).alias("sums"), F.count(F.lit(1)).alias("docs")))
    whole = hosts.agg(_sums(F.col("sums"), n).alias("sums"), F.sum("docs").alias("docs")).first()
    docs = whole["docs"] or 0
    smooth = lambda sums, prior, docs: [(s + PRIOR_WEIGHT * p) / (docs + PRIOR_WEIGHT) for s, p in zip(sums, prior)]
    corpus = smooth(whole["sums"], start, docs)
    named = hosts.where("host is not null and host <> ''")
    parts = F.split("host", r"\.")
    # Suffixes of the host name from the shortest on; all of them count.
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    exploded = named.select("host", "sums", "docs", F.posexplode(levels).alias("depth", "level"))
    counts = exploded.groupBy("level").agg(_sums(F.col("sums"), n).alias("level_sums"), F.sum("docs").alias("level_docs"))
    steps = exploded.select("host", "depth", "level").join(counts, "level").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("depth", "level_sums", "level_docs"))).alias("steps"),  # one per part of the name
    )
    fold = lambda prior, step: F.zip_with(
        prior, step["level_sums"], lambda p, s: (s + F.lit(PRIOR_WEIGHT) * p) / (step["level_docs"] + F.lit(PRIOR_WEIGHT)),
    )
    return steps.select("host", F.aggregate("steps", F.array(*[F.lit(p) for p in corpus]), fold).alias("prior")), corpus


def _named_evidence(value: Column, languages: list[str], trust: float) -> Column:
    """Log-likelihood of a named language: the trust if it is the one, else the rest in equal parts; unknown names say nothing."""
    other = math.log((1 - trust) / max(len(languages) - 1, 1))
    known = F.array(*[F.when(value == name, F.lit(math.log(trust))).otherwise(F.lit(other)) for name in languages])
    return F.when(value.isin(languages), known).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


def markup_language(html: Column) -> Column:
    """The language that the html element declares, without its region."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\x22']?([a-z]{2,3})", 1))


def markup_text(html: Column) -> Column:
    """What a page says: scripts, styles, comments and tags go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z#0-9]{1,10};", " ")


def identify(
    rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text: Column, host: Column | None = None,
    declared: Column | None = None, suffix: Column | None = None,
) -> DataFrame:
    """One row per input row: id, language, posterior, text_language, accepted.

    Evidence that is null, empty or unknown says nothing; a null or empty text leaves the other evidence. A row is accepted when
    a known language has at least half of the posterior and the text has at least one trigram. Ties go to the first language by name.
    Repeated rows give repeated rows and an empty table an empty result; extra columns are ignored.
    """
    languages, table = model
    none = F.lit(None).cast("string")
    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(
        F.col(id_col).alias("id"), text.alias("text"), *[(c if c is not None else none).alias(n) for c, n in ((host, "host"), (declared, "declared"), (suffix, "suffix"))],
    )
    n = len(languages)
    start = [math.log((1 - UNKNOWN_PRIOR) / max(n - 1, 1))] * (n - 1) + [math.log(UNKNOWN_PRIOR)]
    texts = materialize(picked.mapInArrow(
        _likelihood_rows(table), f"id {kind}, host string, declared string, suffix string, likelihood array<double>, n_trigrams long",
    ).withColumn("share", _softmax(F.zip_with("likelihood", F.array(*[F.lit(s) for s in start]), lambda a, b: a + b))))
    priors, corpus = _host_priors(texts, n)
    log_prior = F.transform(F.coalesce("prior", F.array(*[F.lit(p) for p in corpus])), lambda p: F.log(p))
    joined = texts.join(priors, "host", "left")
    total = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    spoken = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.col("suffix"))
    score = total(total("likelihood", log_prior), total(
        _named_evidence(F.col("declared"), languages, DECLARED_TRUST), _named_evidence(spoken, languages, SUFFIX_TRUST),
    ))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    out = joined.withColumn("posteriors", _softmax(score))
    return out.select(
        "id", best(F.col("posteriors")).alias("language"), F.array_max("posteriors").alias("posterior"), best(F.col("share")).alias("text_language"),
        ((F.col("n_trigrams") > 0) & (best(F.col("posteriors")) != UNKNOWN) & (F.array_max("posteriors") >= MIN_POSTERIOR)).alias("accepted"),
    )


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Documents: their text, and their source as the host. Models come from `labelled` (or `docs`) by its column lang."""
    model = train(docs if labelled is None else labelled)
    return identify(docs, model, "doc_id", F.col("text"), host=F.lower("source")).withColumnRenamed("id", "doc_id")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pages: the text and language of the markup, the host and suffix of the address."""
    host = host_of(F.col("url"))
    found = identify(
        pages, train(labelled), "page_id", markup_text(F.col("html")), host=host, declared=markup_language(F.col("html")),
        suffix=F.substring_index(host, ".", -1),
    )
    return found.withColumnRenamed("id", "page_id")
