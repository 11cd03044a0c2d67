"""Queries over keys, names, events and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import documents as D
from dossier.plans.catalog.base import CORPUS_CTE, corpus, plain, portable, query
from dossier.sources import files, requests

EVENT_BODY = """
SELECT event_id, '{{"Records":[{{"s3":{{"bucket":{{"name":"' || CASE WHEN event_id % 7 = 0 THEN '' ELSE 'artifacts' END
  || '"}},"object":{{"key":"raw/' || event_type || '/user+' || CAST(user_id AS STRING) || '%2Fe' || CAST(event_id AS STRING)
  || '.md"}}}}}},{{"s3":{{"bucket":{{"name":"artifacts"}},"object":{{"key":"raw/' || event_type || '/"}}}}}}]}}' AS body
FROM events
"""


@query("o05_parse_events", f"""
WITH e AS ({EVENT_BODY.replace('{{', '{').replace('}}', '}')}),
r AS (SELECT unnest(CAST(json_extract(body, '$.Records') AS JSON[])) AS r FROM e)
SELECT json_extract_string(r, '$.s3.bucket.name') AS bucket,
       url_decode(replace(json_extract_string(r, '$.s3.object.key'), '+', ' ')) AS source_key
FROM r WHERE json_extract_string(r, '$.s3.bucket.name') <> '' AND json_extract_string(r, '$.s3.object.key') <> ''
""")
def parse_events(spark, sf_dir):
    bodies = portable(spark, sf_dir, EVENT_BODY.replace("FROM events", "FROM {events}"))
    return files.parse_events(bodies)


@query("o06_repo_prefix", f"""
WITH {CORPUS_CTE}
SELECT doc_id, array_to_string(string_split(source_key, '/')[1:2], '/') || '/' AS repo_prefix FROM corpus
""")
def repo_prefix(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.repo_prefix(F.col("source_key")).alias("repo_prefix"))


@query("o07_derived_key", f"""
WITH {CORPUS_CTE}
SELECT doc_id, 'derived/' || repo || '/' || substr(source_key, length('raw/' || repo || '/') + 1) || '.derived.json' AS derived_key
FROM corpus
""")
def derived_key(spark, sf_dir):
    key = F.col("source_key")
    return corpus(spark, sf_dir).select(
        "doc_id", D.derived_key(D.repo_prefix(key), key, ".derived.json").alias("derived_key")
    )


@query("o08_repo_discovery", f"""
WITH {CORPUS_CTE}
SELECT DISTINCT 'raw/' || split_part(source_key, '/', 2) || '/' AS repo_prefix FROM corpus
""")
def repo_discovery(spark, sf_dir):
    return files.discover_repos(corpus(spark, sf_dir).select("source_key"))


PAGE_PATHS = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'docs/' WHEN 1 THEN '.github/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN ''
  WHEN 4 THEN 'src/.cache/' ELSE 'dist/' END || 'p' || CAST(page_id AS STRING) || CASE page_id % 5 WHEN 0 THEN '.md'
  WHEN 1 THEN '.PUML' WHEN 2 THEN '.pdf' WHEN 3 THEN '.tar.rst' ELSE '' END AS path
FROM {pages}
"""


@query("o09_scan_filter", f"""
WITH p AS ({plain(PAGE_PATHS)})
SELECT page_id, path FROM p
WHERE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN
  ('.md', '.markdown', '.mdx', '.yaml', '.yml', '.puml', '.plantuml', '.pu', '.wsd', '.txt', '.rst')
  AND NOT list_has_any(string_split(path, '/'), ['.git', '.github', 'node_modules', '__pycache__', '.venv', 'venv',
    '.mypy_cache', '.pytest_cache', 'dist', 'build', '.tox'])
  AND NOT list_bool_or([false] || list_transform(string_split(path, '/'), lambda x: starts_with(x, '.')))
""")
def scan_filter(spark, sf_dir):
    return portable(spark, sf_dir, PAGE_PATHS).where(files.is_uploadable(F.col("path")))


@query("o10_direct_selection", f"""
WITH {CORPUS_CTE} SELECT source_key FROM corpus WHERE starts_with(source_key, 'raw/src1/')
""")
def direct_selection(spark, sf_dir):
    return files.select_keys(corpus(spark, sf_dir).select("source_key"), "raw/src1/")


REQUESTS = """
SELECT conv_id, turn, conv_id % 5 = 0 AS is_base64,
  CASE WHEN conv_id % 5 = 0 THEN {base64} ELSE body END AS body
FROM (SELECT conv_id, turn, '{{"question": "' || replace(replace(replace(text, '\\', ' '), '"', ' '), chr(10), ' ')
  || '", "topK": ' || CASE WHEN turn = 3 THEN '"many"' ELSE CAST(conv_id % 60 AS STRING) END
  || ', "minConfidence": 0.25' || CASE WHEN conv_id % 11 = 0 THEN '' ELSE '}}' END AS body
  FROM {conversations}) b
"""
DUCK_REQUESTS = REQUESTS.replace("{{", "{").replace("}}", "}").replace("{conversations}", "conversations").replace(
    "{base64}", "base64(encode(body))")


@query("o11_parse_requests", f"""
WITH q AS ({DUCK_REQUESTS}),
d AS (SELECT conv_id, turn, CASE WHEN is_base64 THEN decode(from_base64(body)) ELSE body END AS raw FROM q),
p AS (SELECT conv_id, turn, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.question') END AS question,
  CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract_string(raw, '$.topK') AS INTEGER) ELSE 10 END AS top_k FROM d)
SELECT conv_id, turn, question, CAST(top_k AS BIGINT) AS top_k,
  CASE WHEN coalesce(trim(question), '') = '' THEN 'Invalid request' WHEN length(question) > 2000 THEN 'Question too long'
       WHEN top_k IS NULL OR top_k NOT BETWEEN 1 AND 50 THEN 'Invalid topK' END AS problem
FROM p
""")
def parse_requests(spark, sf_dir):
    sql = REQUESTS.replace("{base64}", "base64(CAST(body AS BINARY))").replace("'\\'", "'\\\\'")
    parsed = requests.parse_requests(portable(spark, sf_dir, sql), encoded="is_base64")
    return parsed.select("conv_id", "turn", "question", F.col("top_k").cast("bigint").alias("top_k"), "problem")
