"""Document statistics, type, chunking strategy, evidence weights and key handling."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import text as T

FENCE = r"```[\s\S]*?```"


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])


# -- Keys and names ---------------------------------------------------------

def repo_prefix(key: Column) -> Column:
    parts = F.split(key, "/")
    return F.when(
        F.size(parts) >= 2, F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/"))
    ).otherwise(key)


def derived_key(prefix: Column, key: Column, suffix: str, raw: str = "raw", derived: str = "derived") -> Column:
    relative = F.rtrim(key.substr(F.length(prefix) + 1, F.length(key)), F.lit("/"))
    at = F.instr(prefix, f"{raw}/")
    repo = F.when(
        at > 0,
        F.concat(prefix.substr(F.lit(1), at - 1), prefix.substr(at + len(raw) + 1, F.length(prefix))),
    ).otherwise(prefix)
    return F.concat(F.lit(f"{derived}/"), F.rtrim(repo, F.lit("/")), F.lit("/"), relative, F.lit(suffix))


def file_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def extractor_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(ends_with_any(low, K.DIAGRAM_SUFFIXES), "plantuml")
        .when(ends_with_any(low, [".yaml", ".yml"]), "yaml")
        .when(ends_with_any(low, [".md", ".markdown", ".mdx"]), "markdown")
        .otherwise("text")
    )


def file_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(ends_with_any(name, K.DIAGRAM_SUFFIXES), "plantuml")
        .when(ends_with_any(name, [".yaml", ".yml"]), "yaml")
        .when(ends_with_any(name, [".md", ".markdown"]), "markdown")
        .when(low.endswith(".pdf"), "pdf")
        .when(ends_with_any(low, [".docx", ".doc"]), "docx")
        .otherwise("text")
    )


# -- Evidence weights -------------------------------------------------------

def weight_chain(source: Column, table: dict[str, float]) -> Column:
    low = F.lower(source)
    chain = None
    for key, weight in table.items():
        if key == "default":
            continue
        hit = F.contains(low, F.lit(key.lower()))
        chain = F.when(hit, weight) if chain is None else chain.when(hit, weight)
    return chain.otherwise(table["default"]).cast("double")


def source_weight(source: Column, strategy: Column | None = None) -> Column:
    """Weight of a source; with a strategy column, from that strategy's table if it has one."""
    default = weight_chain(source, K.SOURCE_WEIGHTS)
    if strategy is None:
        return default
    chain = None
    for name, table in K.STRATEGY_SOURCE_WEIGHTS.items():
        value = weight_chain(source, table)
        chain = F.when(strategy == name, value) if chain is None else chain.when(strategy == name, value)
    return chain.otherwise(default)


def ingest_weight(name: Column) -> Column:
    chain = None
    for known, weight in K.KNOWN_FILE_WEIGHTS.items():
        chain = F.when(name == known, weight) if chain is None else chain.when(name == known, weight)
    return chain.otherwise(source_weight(name))


# -- Statistics and classification ------------------------------------------

def text_metrics(text: Column) -> dict[str, Column]:
    """Eight metrics; empty or null text gives zeros.

    A pattern runs only on texts that hold a character it cannot match without.
    """
    body = F.coalesce(text, F.lit(""))

    def holds(mark: str) -> Column:
        return F.contains(body, F.lit(mark))

    lines = F.split(body, T.LINE_BREAK)
    full = F.filter(lines, lambda x: T.strip(x) != "")
    blocks = F.when(holds("```"), T.find_all(body, FENCE)).otherwise(F.array().cast("array<string>"))
    block_chars = F.length(F.array_join(blocks, ""))
    prose = F.when(holds("`"), F.regexp_replace(F.regexp_replace(body, FENCE, " "), "`[^`]+`", " ")).otherwise(body)
    sentences = F.size(F.filter(F.split(prose, "[.!?]+"), lambda x: T.strip(x) != ""))
    prose_words = T.word_count(F.regexp_replace(prose, "[.!?]+", " "))

    def lines_part(ls: Column) -> Column:
        return F.length(F.array_join(ls, "")) / F.greatest(F.size(ls), F.lit(1))

    return {
        "heading_count": F.when(holds("#"), F.size(F.filter(lines, lambda x: x.rlike("(?U)^#{1,6}" + T.SPACE)))).otherwise(0),
        "code_block_count": F.size(blocks),
        "code_char_ratio": F.bround(block_chars / F.greatest(F.length(body), F.lit(1)), 3),
        "avg_sentence_len": F.bround(prose_words / F.greatest(sentences, F.lit(1)), 1),
        "avg_line_len": F.bround(T.let(full, lines_part), 1),
        "word_count": T.word_count(body),
        "has_yaml_keys": holds(":") & body.rlike(r"(?dmU)^\s*\w[\w_-]+:\s+\S"),
        "has_plantuml": holds("@") & body.rlike(r"(?iU)^\s*@start(uml|c4|mindmap|wbs)"),
    }


def text_stats(text: Column) -> Column:
    """The metrics of a text as a struct."""
    return F.struct(*[value.alias(metric) for metric, value in text_metrics(text).items()])


def doc_type(name: Column, stats: Column | Mapping[str, Column], aws_signals: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(ends_with_any(low, K.DIAGRAM_SUFFIXES + [".derived.json"]) | stats["has_plantuml"], "diagram_derived")
        .when(ends_with_any(low, K.CODE_SUFFIXES) | (stats["code_char_ratio"] > 0.35), "code")
        .when(ends_with_any(low, [".yaml", ".yml", ".json"]) | stats["has_yaml_keys"], "structured_data")
        .when((stats["heading_count"] >= 3) & (aws_signals >= 2), "technical_spec")
        .when(ends_with_any(low, [".pdf", ".docx", ".doc"]), "technical_spec")
        .otherwise("narrative")
    )


def chunking_strategy(kind: Column) -> Column:
    chain = None
    for name, strategy in K.CHUNKING_BY_TYPE.items():
        chain = F.when(kind == name, strategy) if chain is None else chain.when(kind == name, strategy)
    return chain.otherwise(K.DEFAULT_CHUNKING)


def analyze(df: DataFrame, text: str = "extracted_text", name: str = "source_file",
            signals: str | None = "expertise_signals") -> DataFrame:
    """Add ``text_stats, doc_type, chunking_strategy, type_confidence``.

    Without a column of signals the services are looked for in the text, and only where their number decides.
    """
    if signals is None:
        aws = F.size(T.find_aws_services(F.col(text)))
    else:
        aws = F.size(F.filter(F.col(signals), lambda s: s["signal_type"] == "aws_service"))
    # Each metric is a column for itself: one that nothing but the type reads is computed only where the type needs it.
    metrics = {f"_{metric}": value for metric, value in text_metrics(F.col(text)).items()}
    stats = {metric[1:]: F.col(metric) for metric in metrics}
    return (
        df.withColumns(metrics)
        .withColumns({
            "text_stats": F.struct(*[value.alias(metric) for metric, value in stats.items()]),
            "doc_type": doc_type(F.col(name), stats, aws),
        })
        .withColumn("chunking_strategy", chunking_strategy(F.col("doc_type")))
        .withColumn("type_confidence", F.lit(1.0)).drop(*metrics)
    )


def routing_summary(df: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "doc_type", "chunking_strategy")
    return df.groupBy(key.alias("routing_key")).agg(F.count(F.lit(1)).alias("files"))
