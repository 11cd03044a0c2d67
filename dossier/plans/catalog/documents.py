"""Queries over document statistics, types and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import documents as D
from dossier.functions import text as T
from dossier.operators import chunking as C
from dossier.plans.catalog.base import CORPUS_CTE, corpus, documents, query, sql_strip
from dossier.plans.catalog.text import AWS_RX, ends, sql_found

# -- Statistics -------------------------------------------------------------

PROSE = r"regexp_replace(regexp_replace(content, '```[\s\S]*?```', ' ', 'g'), '`[^`]+`', ' ', 'g')"
STATS_CTE = f"""{CORPUS_CTE},
parts AS (SELECT *, string_split(content, chr(10)) AS lines, regexp_extract_all(content, '```[\\s\\S]*?```') AS blocks,
  {PROSE} AS prose, {sql_found('content', AWS_RX)} AS aws FROM corpus),
sized AS (SELECT *, list_filter(lines, lambda x: {sql_strip('x')} <> '') AS full_lines,
  len(list_filter(string_split_regex(prose, '[.!?]+'), lambda x: {sql_strip('x')} <> '')) AS sentences,
  len(regexp_extract_all(regexp_replace(prose, '[.!?]+', ' ', 'g'), '\\S+')) AS prose_words FROM parts),
stats AS (SELECT *, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^#{{1,6}}\\s'))) AS BIGINT) AS heading_count,
  CAST(len(blocks) AS BIGINT) AS code_block_count,
  round_even(length(array_to_string(blocks, ''))::DOUBLE / greatest(length(content), 1), 3) AS code_char_ratio,
  round_even(prose_words::DOUBLE / greatest(sentences, 1), 1) AS avg_sentence_len,
  round_even(length(array_to_string(full_lines, ''))::DOUBLE / greatest(len(full_lines), 1), 1) AS avg_line_len,
  CAST(len(regexp_extract_all(content, '\\S+')) AS BIGINT) AS word_count,
  regexp_matches(content, '(?m)^\\s*[\\pL\\pN_][\\pL\\pN_-]+:\\s+\\S') AS has_yaml_keys,
  regexp_matches(content, '(?i)^\\s*@start(uml|c4|mindmap|wbs)') AS has_plantuml FROM sized),
typed AS (SELECT *, CASE
  WHEN {ends('lower(source_file)', K.DIAGRAM_SUFFIXES + ['.derived.json'])} OR has_plantuml THEN 'diagram_derived'
  WHEN {ends('lower(source_file)', K.CODE_SUFFIXES)} OR code_char_ratio > 0.35 THEN 'code'
  WHEN {ends('lower(source_file)', ['.yaml', '.yml', '.json'])} OR has_yaml_keys THEN 'structured_data'
  WHEN heading_count >= 3 AND len(aws) >= 2 THEN 'technical_spec'
  WHEN {ends('lower(source_file)', ['.pdf', '.docx', '.doc'])} THEN 'technical_spec'
  ELSE 'narrative' END AS doc_type FROM stats),
chosen AS (SELECT *, CASE doc_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CHUNKING_BY_TYPE.items())}
  ELSE 'hierarchical' END AS chunking_strategy FROM typed)"""
STAT_NAMES = ["heading_count", "code_block_count", "code_char_ratio", "avg_sentence_len", "avg_line_len", "word_count",
              "has_yaml_keys", "has_plantuml"]
LONGS = {"heading_count", "code_block_count", "word_count"}


def analyzed(spark, sf_dir):
    aws = T.bare_signals(T.find_aws_services(F.col("content")), "aws_service")
    rows = corpus(spark, sf_dir).withColumn("expertise_signals", aws)
    return D.analyze(rows, text="content")


@query("o43_text_stats", f"WITH {STATS_CTE} SELECT doc_id, {', '.join(STAT_NAMES)} FROM stats")
def text_stats(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("doc_id", D.text_stats(F.col("content")).alias("s"))
    return rows.select("doc_id", *[
        (F.col(f"s.{n}").cast("bigint") if n in LONGS else F.col(f"s.{n}")).alias(n) for n in STAT_NAMES
    ])


@query("o44_doc_type", f"WITH {STATS_CTE} SELECT doc_id, doc_type FROM typed")
def doc_type(spark, sf_dir):
    return analyzed(spark, sf_dir).select("doc_id", "doc_type")


@query("o45_chunking_strategy", f"WITH {STATS_CTE} SELECT doc_id, chunking_strategy FROM chosen")
def chunking_strategy(spark, sf_dir):
    return analyzed(spark, sf_dir).select("doc_id", "chunking_strategy")


@query("o46_analyze_document", f"""
WITH {STATS_CTE} SELECT doc_id, doc_type, chunking_strategy, word_count, 1.0::DOUBLE AS type_confidence FROM chosen
""")
def analyze_document(spark, sf_dir):
    return analyzed(spark, sf_dir).select(
        "doc_id", "doc_type", "chunking_strategy", F.col("text_stats.word_count").cast("bigint").alias("word_count"),
        "type_confidence",
    )


@query("o47_routing_summary", f"""
WITH {STATS_CTE} SELECT doc_type || ':' || chunking_strategy AS routing_key, count(*) AS files FROM chosen GROUP BY 1
""")
def routing_summary(spark, sf_dir):
    return D.routing_summary(analyzed(spark, sf_dir))


# -- Chunks -----------------------------------------------------------------

def sql_windows(source: str, words: str, size: int, overlap: int, keep: str = "doc_id") -> str:
    """``keep, pos, content`` windows over a word list column."""
    step = size - overlap
    count = f"CASE WHEN len({words}) <= {size} THEN least(len({words}), 1) ELSE CAST(ceil((len({words}) - {size})::DOUBLE / {step}) AS BIGINT) + 1 END"
    return (
        f"SELECT {keep}, pos, array_to_string({words}[pos * {step} + 1 : pos * {step} + {size}], ' ') AS content "
        f"FROM (SELECT *, unnest(range({count})) AS pos FROM {source}) w_"
    )


WORDS_CTE = "w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS words FROM documents)"


def digest(rows):
    return rows.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("content").cast("bigint").alias("chars"),
        F.md5(F.col("content").cast("binary")).alias("content_md5"), "is_child",
    )


DIGEST = "length(content) AS chars, md5(content) AS content_md5"


def chunked(spark, sf_dir, chunks):
    return C.explode_chunks(documents(spark, sf_dir, "doc_id", "text"), chunks, ["doc_id"])


@query("o48_word_windows", f"""
WITH {WORDS_CTE}, c AS ({sql_windows('w', 'words', 100, 20)})
SELECT doc_id, CAST(pos AS BIGINT) AS pos, content FROM c
""")
def word_windows(spark, sf_dir):
    cut = C.windows(T.words(F.col("text")), 100, 20)
    rows = T.explode_rows(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], cut, "content", "pos")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def fixed_query(name, strategy):
    size, overlap = K.FIXED_WINDOWS[strategy]

    @query(name, f"""
    WITH {WORDS_CTE}, c AS ({sql_windows('w', 'words', size, overlap)})
    SELECT doc_id, CAST(pos AS BIGINT) AS chunk_index, {DIGEST}, false AS is_child FROM c
    """)
    def run(spark, sf_dir):
        return digest(chunked(spark, sf_dir, C.fixed_chunks(F.col("text"), size, overlap)))


fixed_query("o49_fixed_512", "fixed_512")
fixed_query("o49_fixed_256", "fixed_256")

HIERARCHICAL = f"""p AS ({sql_windows('w', 'words', K.PARENT_WORDS, K.CHILD_OVERLAP)}),
pw AS (SELECT doc_id, pos AS parent_pos, content AS parent, string_split(content, ' ') AS words FROM p),
ch AS ({sql_windows('pw', 'words', K.CHILD_WORDS, K.CHILD_OVERLAP, 'doc_id, parent_pos, parent')}),
hier AS (SELECT doc_id, pos AS parent_pos, -1 AS pos, content, false AS is_child FROM p
  UNION ALL SELECT doc_id, parent_pos, pos, content, true FROM ch WHERE content <> parent),
hier_out AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY parent_pos, pos) - 1 AS chunk_index,
  content, is_child FROM hier)"""


@query("o50_hierarchical", f"""
WITH {WORDS_CTE}, {HIERARCHICAL} SELECT doc_id, chunk_index, {DIGEST}, is_child FROM hier_out
""")
def hierarchical(spark, sf_dir):
    return digest(chunked(spark, sf_dir, C.hierarchical_chunks(F.col("text"))))


def sentences_cte(source: str, text: str) -> str:
    return f"""sp AS (SELECT doc_id, unnest(list_concat([]::VARCHAR[], parts)) AS part, unnest(range(len(parts))) AS part_no FROM (
  SELECT doc_id, string_split(regexp_replace({text}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM {source})),
sl AS (SELECT doc_id, part_no, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (
  SELECT doc_id, part_no, CASE WHEN length(part) > 600 THEN string_split_regex(part, '\\r\\n|[\\n\\r\\x0b\\x0c]') ELSE [part] END AS ls FROM sp)),
sent AS (SELECT doc_id, {sql_strip('line')} AS sentence,
  row_number() OVER (PARTITION BY doc_id ORDER BY part_no, line_no) - 1 AS i FROM sl WHERE {sql_strip('line')} <> '')"""


SENTENCE_WINDOWS = """pre AS (SELECT doc_id, i, sentence, length(sentence) + 1 AS n,
    sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS total FROM sent),
ended AS (SELECT a.doc_id, a.i, coalesce(b.i + 1, a.total) AS j, a.total
    FROM (SELECT *, upto - n + 512 AS target FROM pre) a ASOF LEFT JOIN (SELECT doc_id, i, upto FROM pre) b
    ON a.doc_id = b.doc_id AND a.target <= b.upto),
nxt AS (SELECT doc_id, i, j, total, i + greatest(1, j - i - 1) AS k FROM ended),
win AS (SELECT doc_id, i, j, k, 0 AS chunk_index FROM nxt WHERE i = 0
    UNION ALL SELECT n.doc_id, n.i, n.j, n.k, w.chunk_index + 1 FROM win w JOIN nxt n ON n.doc_id = w.doc_id AND n.i = w.k),
sent_out AS (SELECT w.doc_id, w.chunk_index, string_agg(p.sentence, ' ' ORDER BY p.i) AS content
    FROM win w JOIN pre p ON p.doc_id = w.doc_id AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2)"""


@query("o51_sentences", f"""
WITH {sentences_cte('documents', 'text')} SELECT doc_id, CAST(i AS BIGINT) AS i, sentence FROM sent
""")
def sentences(spark, sf_dir):
    cut = C.sentences(F.col("text"))
    rows = T.explode_rows(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], cut, "sentence", "i")
    return rows.withColumn("i", F.col("i").cast("bigint"))


@query("o52_sentence_windows", f"""
WITH RECURSIVE {sentences_cte('documents', 'text')}, {SENTENCE_WINDOWS}
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, {DIGEST}, false AS is_child FROM sent_out
""")
def sentence_windows(spark, sf_dir):
    return digest(chunked(spark, sf_dir, C.sentence_chunks(F.col("text"))))


@query("o53_chunk_by_strategy", f"""
WITH RECURSIVE {STATS_CTE},
w AS (SELECT doc_id, chunking_strategy, regexp_extract_all(content, '\\S+') AS words FROM chosen),
w512 AS (SELECT * FROM w WHERE chunking_strategy = 'fixed_512'), w256 AS (SELECT * FROM w WHERE chunking_strategy = 'fixed_256'),
wh AS (SELECT * FROM w WHERE chunking_strategy = 'hierarchical'), st AS (SELECT doc_id, content FROM chosen WHERE chunking_strategy = 'sentence'),
{HIERARCHICAL.replace("FROM w)", "FROM wh)").replace("FROM w)", "FROM wh)").replace(" FROM w) w_", " FROM wh) w_")},
{sentences_cte('st', 'content')}, {SENTENCE_WINDOWS},
allc AS (SELECT doc_id, chunk_index, content, is_child FROM hier_out
  UNION ALL SELECT doc_id, chunk_index, content, false FROM sent_out
  UNION ALL SELECT doc_id, pos, content, false FROM ({sql_windows('w512', 'words', 512, 50)})
  UNION ALL SELECT doc_id, pos, content, false FROM ({sql_windows('w256', 'words', 256, 25)}))
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, {DIGEST}, is_child FROM allc
""")
def chunk_by_strategy(spark, sf_dir):
    rows = analyzed(spark, sf_dir).select("doc_id", "content", "chunking_strategy")
    return digest(C.chunk_documents(rows, text="content", keep=["doc_id"]))


@query("o54_token_count", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS tokens FROM documents
""")
def token_count(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", T.word_count(F.col("text")).cast("bigint").alias("tokens")
    )
