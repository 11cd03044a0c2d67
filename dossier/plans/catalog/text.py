"""Queries over text: cleaning, finders, diagrams, identifiers, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import documents as D
from dossier.functions import text as T
from dossier.operators import extraction as X
from dossier.plans.catalog.base import AWS, PAT, TECH, CORPUS_CTE, corpus, documents, literal, query, sql_ascii, sql_strip, sql_weight, table


def rx(pattern: str) -> str:
    return literal(pattern)


def ends(x: str, suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in suffixes) + ")"


KIND = (
    f"CASE WHEN {ends('lower(source_file)', K.DIAGRAM_SUFFIXES)} THEN 'plantuml' "
    f"WHEN {ends('lower(source_file)', ['.yaml', '.yml'])} THEN 'yaml' "
    f"WHEN {ends('lower(source_file)', ['.md', '.markdown', '.mdx'])} THEN 'markdown' ELSE 'text' END"
)
FILE_TYPE = (
    f"CASE WHEN {ends('source_file', K.DIAGRAM_SUFFIXES)} THEN 'plantuml' "
    f"WHEN {ends('source_file', ['.yaml', '.yml'])} THEN 'yaml' "
    f"WHEN {ends('source_file', ['.md', '.markdown'])} THEN 'markdown' "
    f"WHEN {ends('lower(source_file)', ['.pdf'])} THEN 'pdf' "
    f"WHEN {ends('lower(source_file)', ['.docx', '.doc'])} THEN 'docx' ELSE 'text' END"
)


def sql_squeeze(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


CLEAN_MD = sql_squeeze(
    r"regexp_replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), "
    r"'!\[.*?\]\(.*?\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
)
MD_CTE = f"{CORPUS_CTE}, md AS (SELECT *, {CLEAN_MD} AS cleaned FROM corpus WHERE {KIND} = 'markdown')"


def markdown(spark, sf_dir):
    return corpus(spark, sf_dir).where(D.extractor_kind(F.col("source_file")) == "markdown")


@query("o22_extractor_dispatch", f"WITH {CORPUS_CTE} SELECT doc_id, {KIND} AS extractor FROM corpus")
def extractor_dispatch(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.extractor_kind(F.col("source_file")).alias("extractor"))


@query("o23_file_type", f"WITH {CORPUS_CTE} SELECT doc_id, {FILE_TYPE} AS file_type FROM corpus")
def file_type(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.file_type(F.col("source_file")).alias("file_type"))


@query("o24_markdown_clean", f"""
WITH {MD_CTE} SELECT doc_id, length(cleaned) AS chars, md5(cleaned) AS text_md5 FROM md
""")
def markdown_clean(spark, sf_dir):
    rows = markdown(spark, sf_dir).select("doc_id", T.clean_markdown(F.col("content")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("o25_headings", f"""
WITH {MD_CTE} SELECT doc_id, unnest(regexp_extract_all(content, '(?m)^#{{1,4}}\\s+(.+)$', 1)) AS heading FROM md
""")
def headings(spark, sf_dir):
    return T.explode_rows(markdown(spark, sf_dir), ["doc_id"], T.headings(F.col("content")), "heading")


FENCE = "(?s)```([\\pL\\pN_]*)\\n(.*?)```"


@query("o26_code_blocks", f"""
WITH {MD_CTE}, b AS (
  SELECT doc_id, unnest(regexp_extract_all(content, {rx(FENCE)}, 1)) AS lang,
         unnest(regexp_extract_all(content, {rx(FENCE)}, 2)) AS code FROM md)
SELECT doc_id, CASE WHEN lang = '' THEN 'text' ELSE lower(lang) END AS lang, {sql_strip('code')} AS code
FROM b WHERE {sql_strip('code')} <> ''
""")
def code_blocks(spark, sf_dir):
    rows = T.explode_rows(markdown(spark, sf_dir), ["doc_id"], T.code_blocks(F.col("content")), "b")
    return rows.select("doc_id", "b.lang", "b.code")


@query("o27_markdown_summary", f"""
WITH {MD_CTE}, p AS (
  SELECT doc_id, source_file, regexp_extract_all(content, '(?m)^#{{1,4}}\\s+(.+)$', 1)[1:5] AS h,
    list_filter(list_transform(string_split(cleaned, chr(10)), lambda x: {sql_strip('x')}),
                lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS line FROM md)
SELECT doc_id, concat_ws(' | ', 'File: ' || source_file, 'Sections: ' || array_to_string(h, ', '),
  {sql_strip("regexp_replace(line, '[ ' || chr(9) || ']+', ' ', 'g')")}) AS summary FROM p
""")
def markdown_summary(spark, sf_dir):
    content = F.col("content")
    return markdown(spark, sf_dir).select(
        "doc_id", T.markdown_summary(content, T.clean_markdown(content), F.col("source_file")).alias("summary")
    )


@query("o27_shorten", """
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) <= 300 THEN line
  WHEN regexp_extract(line, '^(.{1,294})(?: |$)', 1) = '' THEN '[...]'
  ELSE regexp_extract(line, '^(.{1,294})(?: |$)', 1) || ' [...]' END AS short FROM d
""")
def shorten(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.shorten(F.col("text")).alias("short"))


def sql_found(x: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({sql_ascii(x)}, {rx(pattern)}))"


AWS_RX = rf"(?i)\b(Amazon|AWS)\s+({K.AWS_SERVICE_TERMS})\b"
TECH_RX = rf"(?i)\b({K.TECHNOLOGY_TERMS})\b"
PAT_RX = rf"(?i)\b({K.PATTERN_TERMS})\b"


def finder_query(name, pattern, finder):
    @query(name, f"WITH {CORPUS_CTE} SELECT doc_id, unnest({sql_found('content', pattern)}) AS value FROM corpus")
    def run(spark, sf_dir):
        return T.explode_rows(corpus(spark, sf_dir), ["doc_id"], finder(F.col("content")), "value")


finder_query("o28_aws_services", AWS_RX, T.find_aws_services)
finder_query("o29_technologies", TECH_RX, T.find_technologies)
finder_query("o30_patterns", PAT_RX, T.find_patterns)


def sql_signals(source: str, text: str) -> str:
    """Signal rows of a relation with ``doc_id`` and a text column."""
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS signal_type, unnest({sql_found(text, pattern)}) AS value, lower({text}) AS low FROM {source}"
        for kind, pattern in [("aws_service", AWS_RX), ("technology", TECH_RX), ("pattern", PAT_RX)]
    )
    return (
        "SELECT doc_id, signal_type, value, "
        "CAST((length(low) - length(replace(low, lower(value), ''))) // length(value) AS BIGINT) AS frequency "
        f"FROM ({parts})"
    )


@query("o31_build_signals", f"WITH {CORPUS_CTE} {sql_signals('corpus', 'content')}")
def build_signals(spark, sf_dir):
    signals = T.build_signals(F.col("content"), F.col("source_file"), F.lit(1.0))
    rows = T.explode_rows(corpus(spark, sf_dir), ["doc_id"], signals, "s")
    return rows.select("doc_id", "s.signal_type", "s.value", F.col("s.frequency").cast("bigint").alias("frequency"))


# The corpus itself seldom names a service, so frequent words stand in as a caller's term list.
COMMON_TERMS = "this|that|with|from|the rest|and|pour|nicht"


@query("o31_custom_terms", f"""
SELECT doc_id, unnest(list_distinct(regexp_extract_all({sql_ascii('text')}, '(?i)\\b({COMMON_TERMS})\\b'))) AS value
FROM documents
""")
def custom_terms(spark, sf_dir):
    found = T.found(F.col("text"), T.term_pattern(COMMON_TERMS))
    return T.explode_rows(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], found, "value")


# -- YAML: structure comes from a parser, so rows only ----------------------

def manifests(spark, sf_dir):
    rows = corpus(spark, sf_dir).where(D.extractor_kind(F.col("source_file")) == "yaml")
    parsed = rows.withColumn("parsed", X.read_yaml("content"))
    e = X.extract_yaml(F.col("parsed"), F.col("content"), F.col("source_file"), F.lit(0.7))
    return parsed.select("doc_id", e.alias("e")).select("doc_id", "e.*")


# What the parser must make of the generated manifests: nine known lines, then the block text with one line break at its end.
@query("o32_yaml_flatten", f"""
WITH {CORPUS_CTE}, y AS (SELECT doc_id, repo, text FROM corpus JOIN documents USING (doc_id) WHERE {KIND} = 'yaml'),
l AS (SELECT doc_id, list_concat(['repo_name: ' || repo, 'owner: dev', 'skills[0]: Python', 'skills[1].name: ' || {TECH}, 'patterns[0]: ' || {PAT},
    'aws_services[0].name: ' || {AWS}, 'limits.sizes[0]: 1', 'limits.sizes[1]: 2'],
  string_split('body: ' || rtrim(text, chr(10)) || CASE WHEN rtrim(text, chr(10)) = '' THEN '' ELSE chr(10) END, chr(10))) AS lines FROM y)
SELECT doc_id, unnest(range(len(lines)))::INTEGER AS line_no, unnest(lines) AS line FROM l
""")
def yaml_flatten(spark, sf_dir):
    return T.explode_rows(manifests(spark, sf_dir), ["doc_id"], F.split("extracted_text", "\n"), "line", "line_no")


YAML_TERMS = f"""
WITH {CORPUS_CTE}, y AS (SELECT * FROM corpus WHERE {KIND} = 'yaml'),
k AS (SELECT doc_id, 1 AS n, 'skill' AS signal_type, 'Python' AS value FROM y
  UNION ALL SELECT doc_id, 1, 'skill', regexp_extract(content, '  - name: (.+)', 1) FROM y
  UNION ALL SELECT doc_id, 1, 'pattern', regexp_extract(content, 'patterns:\\n  - (.+)', 1) FROM y
  UNION ALL SELECT doc_id, 1, 'aws_service', regexp_extract(content, 'aws_services:\\n  - name: (.+)', 1) FROM y),
s AS (SELECT doc_id, signal_type, value, CAST(n AS BIGINT) AS frequency FROM k
  UNION ALL SELECT doc_id, signal_type, value, frequency FROM ({sql_signals('y', 'content')}))
SELECT doc_id, signal_type, value, frequency FROM s
"""


@query("o33_yaml_signals", YAML_TERMS)
def yaml_signals(spark, sf_dir):
    rows = T.explode_rows(manifests(spark, sf_dir), ["doc_id"], F.col("expertise_signals"), "s")
    return rows.select("doc_id", "s.signal_type", "s.value", F.col("s.frequency").cast("bigint").alias("frequency"))


@query("o34_yaml_metadata", f"""
WITH {CORPUS_CTE}
SELECT doc_id, repo AS repo_name, 'dev' AS owner, 'YAML config: ' || source_file
  || '. Keys: repo_name, owner, skills, patterns, aws_services, limits, body.' AS summary
FROM corpus WHERE {KIND} = 'yaml'
""")
def yaml_metadata(spark, sf_dir):
    meta = F.col("metadata")
    return manifests(spark, sf_dir).select(
        "doc_id", meta["repo_name"].alias("repo_name"), meta["owner"].alias("owner"), "summary"
    )


# -- Diagrams ---------------------------------------------------------------

PUML_CTE = f"{CORPUS_CTE}, pu AS (SELECT * FROM corpus WHERE {KIND} = 'plantuml')"
NOQ = "trim({x}, '\"')"


def sql_unquote(x: str) -> str:
    return f"trim({sql_strip(x)}, '\"')"


SQL_COMPONENTS = (
    f"list_concat(list_filter(list_transform(regexp_extract_all(content, {rx('(?i)' + X.COMPONENT)}, 1), "
    f"lambda x: {sql_unquote('x')}), lambda x: length(x) > 1), "
    f"list_filter(list_transform(regexp_extract_all(content, {rx('(?i)' + X.C4_ELEMENT)}, 2), "
    f"lambda x: {sql_strip('x')}), lambda x: x <> ''))"
)
SQL_RELATIONS = (
    "list_transform(list_filter(list_transform(list_zip("
    + ", ".join(f"regexp_extract_all(content, {rx('(?m)' + X.ARROW)}, {g})" for g in (1, 2, 3))
    + f"), lambda z: {{'a': {sql_unquote('z[1]')}, 'b': {sql_unquote('z[2]')}, 'l': {sql_strip('z[3]')}}}), "
    "lambda r: length(r.a) > 1 AND length(r.b) > 1), "
    "lambda r: r.a || ' → ' || r.b || CASE WHEN r.l <> '' THEN ' [' || r.l || ']' ELSE '' END)"
)


def diagrams(spark, sf_dir):
    return corpus(spark, sf_dir).where(D.extractor_kind(F.col("source_file")) == "plantuml")


@query("o35_plantuml_parts", f"""
WITH {PUML_CTE}, p AS (
  SELECT doc_id, content, {SQL_COMPONENTS} AS components, {SQL_RELATIONS} AS relations FROM pu)
SELECT doc_id, 'component' AS part, CAST(unnest(range(len(components))) AS BIGINT) AS pos, unnest(components) AS value FROM p
UNION ALL
SELECT doc_id, 'relation', CAST(unnest(range(len(relations))) AS BIGINT), unnest(relations) FROM p
UNION ALL
SELECT doc_id, 'service', CAST(0 AS BIGINT), unnest(list_distinct(list_concat(
  list_transform(regexp_extract_all(content, {rx('(?i)' + X.SPRITE)}, 2), lambda x: 'AWS ' || translate(x, '_-', '  ')),
  {sql_found('content', AWS_RX)}))) FROM p
UNION ALL SELECT doc_id, 'type', CAST(0 AS BIGINT), 'sequence or component' FROM p
""")
def plantuml_parts(spark, sf_dir):
    content, zero = F.col("content"), F.lit(0).cast("bigint").alias("pos")
    rows = diagrams(spark, sf_dir)
    listed = [
        T.explode_rows(rows, ["doc_id"], values, "value", "pos")
        .select("doc_id", F.lit(part).alias("part"), F.col("pos").cast("bigint").alias("pos"), "value")
        for part, values in [("component", X.diagram_components(content)), ("relation", X.diagram_relations(content))]
    ]
    found = T.explode_rows(rows, ["doc_id"], X.diagram_services(content), "value")
    services = found.select("doc_id", F.lit("service").alias("part"), zero, "value")
    kinds = rows.select("doc_id", F.lit("type").alias("part"), zero, X.diagram_type(content).alias("value"))
    return listed[0].unionByName(listed[1]).unionByName(services).unionByName(kinds)


@query("o36_plantuml_prose", f"""
WITH {PUML_CTE}, p AS (
  SELECT doc_id, source_file, content, {SQL_COMPONENTS} AS c, {SQL_RELATIONS} AS r FROM pu),
o AS (SELECT doc_id, string_agg(v, ', ' ORDER BY place) AS listed FROM (
    SELECT doc_id, v, min(n) AS place FROM (SELECT doc_id, unnest(c) AS v, unnest(range(len(c))) AS n FROM p) y
    GROUP BY doc_id, v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(n)) <= 20) z GROUP BY doc_id)
SELECT p.doc_id, 'Architecture diagram (sequence or component) from ' || source_file || '.' || chr(10)
  || 'Components/services: ' || listed || '.' || chr(10) || 'Data flows and relationships:' || chr(10)
  || array_to_string(list_transform(r[1:15], lambda x: '  - ' || x), chr(10)) AS prose
FROM p JOIN o USING (doc_id)
""")
def plantuml_prose(spark, sf_dir):
    content = F.col("content")
    none = F.array().cast("array<string>")
    prose = X.diagram_prose(
        X.diagram_type(content), X.diagram_components(content), X.diagram_relations(content), none, F.lit(""),
        F.col("source_file"),
    )
    return diagrams(spark, sf_dir).select(
        "doc_id", F.regexp_replace(prose, "\n\nRaw PlantUML source:\n$", "").alias("prose")
    )


@query("o37_plain_text", f"""
WITH {CORPUS_CTE}, t AS (SELECT doc_id, source_file, {sql_squeeze('content')} AS t FROM corpus WHERE {KIND} = 'text')
SELECT doc_id, md5(t) AS text_md5, 'Text file ' || source_file || ': ' || substr(string_split(t, chr(10))[1], 1, 200) AS summary
FROM t
""")
def plain_text(spark, sf_dir):
    rows = corpus(spark, sf_dir).where(D.extractor_kind(F.col("source_file")) == "text")
    e = rows.select("doc_id", X.extract_plain(F.col("content"), F.col("source_file"), F.lit(1.0)).alias("e"))
    return e.select("doc_id", F.md5(F.col("e.extracted_text").cast("binary")).alias("text_md5"), "e.summary")


# -- Identifiers and weights ------------------------------------------------

@query("o38_slug", r"""
SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages
""")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("o39_stable_ids", r"""
WITH p AS (SELECT p_partkey, 'pattern_' || trim(regexp_replace(lower(p_name || '--' || p_brand), '[^a-z0-9]', '_', 'g'), '_') AS node_id FROM part)
SELECT p_partkey, node_id, node_id || '__strengthens__' || node_id AS edge_id FROM p
""")
def stable_ids(spark, sf_dir):
    node = T.stable_id("Pattern", F.concat("p_name", F.lit("--"), "p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", node.alias("node_id"), T.edge_id(node, F.lit("STRENGTHENS"), node).alias("edge_id")
    )


@query("o40_fingerprint", "SELECT doc_id, md5(substr(text, 1, 500)) AS text_hash FROM documents")
def fingerprint(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.fingerprint(F.col("text")).alias("text_hash"))


STRATEGIES = K.STRATEGY_PRIORITY


@query("o41_source_weights", f"WITH {CORPUS_CTE} " + " UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS strategy, {sql_weight('source_file', K.STRATEGY_SOURCE_WEIGHTS.get(s, K.SOURCE_WEIGHTS))} AS weight FROM corpus"
    for s in STRATEGIES
))
def source_weights(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])))
    return rows.select("doc_id", "strategy", D.source_weight(F.col("source_file"), F.col("strategy")).alias("weight"))


SQL_INGEST_WEIGHT = (
    "CASE source_file " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in K.KNOWN_FILE_WEIGHTS.items())
    + f" ELSE {sql_weight('source_file', K.SOURCE_WEIGHTS)} END"
)


@query("o42_ingest_weight", f"WITH {CORPUS_CTE} SELECT doc_id, {SQL_INGEST_WEIGHT} AS weight FROM corpus")
def ingest_weight(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.ingest_weight(F.col("source_file")).alias("weight"))
