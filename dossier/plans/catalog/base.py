"""Registry, table access and the derived inputs shared by the queries.

The driver tables hold prose, vectors, events and orders. The inputs the operators need
(files of a repository, chunks, feedback, a property graph) are derived from whole tables
by SQL that both Spark and the checking engine read, so both sides start from the same rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier import constants as K
from dossier.session import ship

Runner = Callable[[SparkSession, str], DataFrame]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        @functools.wraps(run)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portable(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL written for both engines; ``{name}`` is a driver table or a given frame."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    known = {n: frames[n] if n in frames else table(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **known)


def plain(sql: str) -> str:
    """The same SQL for the checking engine, where tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_list(key: str, values: list[str]) -> str:
    """A value picked by ``key`` modulo the list's length."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} % {len(values)} {arms} ELSE {values[-1]} END"


NL = "chr(10)"
ID = "CAST(doc_id AS STRING)"
AWS = case_list("doc_id", ["'AWS Lambda'", "'Amazon S3'", "'aws lambda'", "'Amazon Route 53'", "'AWS Step Functions'"])
TECH = case_list("doc_id", ["'Python'", "'Node.js'", "'C++11'", "'GraphQL'", "'Kafka and rest'", "'pgvector'", "'Go'"])
PAT = case_list("doc_id", ["'event-driven'", "'event driven'", "'serverless'", "'RAG'", "'blue-green'", "'retry'"])

# Nineteen kinds of file, so that every branch by name is taken.
NAMES = [
    "'architecture.md'", "'CLAUDE.md'", "'README.md'", "'readme.md'", "'repo-signals.yaml'",
    f"'notes_' || {ID} || '.md'", f"'diagram_' || {ID} || '.puml'", f"'c4_diagram_' || {ID} || '.plantuml'",
    f"'module_' || {ID} || '.py'", f"'article_' || {ID} || '.txt'", f"'resume_' || {ID} || '.pdf'",
    f"'brief_' || {ID} || '.docx'", f"'config_' || {ID} || '.yml'", f"'blog_' || {ID} || '.mdx'",
    f"'data_' || {ID} || '.json'", f"'decoder_' || {ID} || '.markdown'", f"'REPORT_' || {ID} || '.PDF'",
    f"'plain_' || {ID} || '.rst'", f"'old_' || {ID} || '.DOC'",
]
MARKDOWN = (
    f"'# Overview ' || {ID} || {NL} || '<!-- draft' || {NL} || 'note -->' || {NL} || '![shot](img.png)' || {NL}"
    f" || 'See [the guide](http://x.example/g) on ' || {AWS} || ', Amazon SQS and ' || {TECH} || '.' || {NL} || {NL}"
    f" || {NL} || {NL} || '## Details of ' || lang || {NL} || text || {NL} || {NL} || '### Code' || {NL}"
    f" || '```python' || {NL} || 'print(1)' || {NL} || '```' || {NL} || '```' || {NL} || 'plain ' || {PAT} || {NL}"
    f" || '```' || {NL}"
)
DIAGRAM = (
    f"'@startuml' || {NL} || '!include <awslib/Compute/' || replace({AWS}, ' ', '_') || '>' || {NL}"
    f" || 'component \"Web ' || {ID} || '\" as w' || {NL} || 'actor User' || {NL} || 'database Store' || {NL}"
    f" || 'Person(adm, \"Admin ' || lang || '\")' || {NL} || 'User --> Web : asks' || {NL} || 'Web -> Store' || {NL}"
    f" || 'note uses ' || {AWS} || ' with ' || {TECH} || {NL} || text || {NL} || '@enduml' || {NL}"
)
MANIFEST = (
    f"'repo_name: ' || source || {NL} || 'owner: dev' || {NL} || 'skills:' || {NL} || '  - Python' || {NL}"
    f" || '  - name: ' || {TECH} || {NL} || 'patterns:' || {NL} || '  - ' || {PAT} || {NL} || 'aws_services:' || {NL}"
    f" || '  - name: ' || {AWS} || {NL} || 'limits:' || {NL} || '  sizes: [1, 2]' || {NL} || 'body: |' || {NL}"
    f" || '  ' || replace(text, {NL}, {NL} || '  ') || {NL}"
)
PLAIN = f"text || {NL} || {NL} || {NL} || {NL} || 'Runs on ' || {AWS} || ' in a ' || {PAT} || ' way with ' || {TECH} || '.'"

CORPUS = f"""
SELECT doc_id, lang, repo, 'raw/' || repo || '/d' || {ID} || '/' || name AS source_key, name AS source_file,
  CASE WHEN kind IN (0, 1, 2, 3, 5, 13, 15) THEN {MARKDOWN}
       WHEN kind IN (6, 7) THEN {DIAGRAM}
       WHEN kind IN (4, 12) THEN {MANIFEST}
       ELSE {PLAIN} END AS content
FROM (SELECT doc_id, text, lang, source, source AS repo, doc_id % 19 AS kind, {case_list('doc_id', NAMES)} AS name
      FROM {{documents}}) d
"""


def spread(df: DataFrame) -> DataFrame:
    """Share rows out when a table is fewer files than the session has cores; else leave it alone.

    Parsing text costs far more than moving it once. A table of many files is already split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, repo, source_key, source_file, content``: one file per document."""
    return spread(portable(spark, sf_dir, CORPUS))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "lang", "source"))))


CORPUS_CTE = f"corpus AS ({plain(CORPUS)})"

def sql_strip(x: str) -> str:
    return f"trim({x}, '{K.WHITESPACE}')"


def sql_ascii(x: str) -> str:
    """Letters and digits outside ASCII become ASCII ones, so that word edges agree."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\PL]', 'x', 'g'), '[^\\x00-\\x7F\\PN]', '1', 'g')"


def sql_weight(x: str, table_: dict[str, float]) -> str:
    arms = " ".join(
        f"WHEN contains(lower({x}), '{k.lower()}') THEN {w}::DOUBLE" for k, w in table_.items() if k != "default"
    )
    return f"(CASE {arms} ELSE {table_['default']}::DOUBLE END)"
