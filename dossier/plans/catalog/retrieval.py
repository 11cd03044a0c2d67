"""Queries over vectors, retrieval and the answer cache.

Every document is a chunk with a vector of the table, dealt in turn; benchmark items are
the questions, each with the vector of its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import questions as Q
from dossier.functions import vectors as V
from dossier.operators import ann, cache
from dossier.operators import retrieval as R
from dossier.operators import similarity as S
from dossier.plans.catalog.base import NAMES, case_list, documents, plain, portable, query, sql_weight, table
from dossier.session import checkpoint_dir

CHUNKS = f"""
SELECT doc_id AS chunk_id, embedding, text AS content, {case_list('doc_id', NAMES)} AS source_file,
  {case_list('label', ["'narrative'", "'code'", "'technical_spec'"])} AS doc_type, 'sentence' AS strategy, doc_id % 3 = 0 AS is_child
FROM (SELECT *, doc_id % (SELECT count(*) FROM {{embeddings}}) AS v FROM {{documents}}) d JOIN {{embeddings}} e ON e.vec_id = d.v
"""
QUESTIONS = f"""
SELECT item_id AS qid, text AS question, embedding AS question_embedding,
  {case_list('item_id', [f"'{s}'" for s in K.STRATEGY_PRIORITY])} AS strategy
FROM {{benchmark}} b JOIN {{embeddings}} e ON b.item_id = e.vec_id
"""
EACH_VECTOR = "SELECT vec_id AS qid, embedding AS question_embedding FROM {embeddings}"
TOP_K = 10


def chunks(spark, sf_dir):
    return portable(spark, sf_dir, CHUNKS)


def questions(spark, sf_dir):
    return portable(spark, sf_dir, QUESTIONS)


def label_means(spark, sf_dir):
    """One question per label: the mean of its vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = rows.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("question_embedding")
    ).withColumnRenamed("label", "qid")


def sql_cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 12)"


BASE_CTE = f"ch AS ({plain(CHUNKS)}), q AS ({plain(QUESTIONS)})"
MEANS_CTE = """m AS (SELECT label, d, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings) z GROUP BY 1, 2),
means AS (SELECT label AS qid, list(x ORDER BY d)::FLOAT[] AS question_embedding FROM m GROUP BY 1)"""


def cand(name: str, q: str, c: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.qid, c.*, {sql_cos('q.question_embedding', 'c.embedding')} AS score,
  row_number() OVER (PARTITION BY q.qid ORDER BY {sql_cos('q.question_embedding', 'c.embedding')} DESC, c.chunk_id) AS cr
  FROM {q} q, {c} c WHERE {where}) z WHERE cr <= {k})"""


def by_strategy(source: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {sql_weight(source, t)}" for s, t in K.STRATEGY_SOURCE_WEIGHTS.items())
    return f"(CASE q_strategy {arms} ELSE {sql_weight(source, K.SOURCE_WEIGHTS)} END)"


def ranked(name: str, source: str, weight: str, k: int, min_score: float) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY effective_score DESC, cr) AS rank
  FROM (SELECT *, score * source_weight AS effective_score FROM (SELECT *, {weight} AS source_weight FROM {source}) a) b
  WHERE effective_score >= {min_score}::DOUBLE) c WHERE rank <= {k})"""


PRIMARY = (
    cand("cand", "q", "ch", 2 * TOP_K) + ", candq AS (SELECT cand.*, q.strategy AS q_strategy, question FROM cand JOIN q USING (qid)), "
    + ranked("prim", "candq", by_strategy("source_file"), TOP_K, 0.0)
)
RESULT = "qid, chunk_id, round(score, 6) AS score, source_weight, round(effective_score, 6) AS effective_score, rank"


def shown(rows):
    return rows.select(
        "qid", "chunk_id", F.round("score", 6).alias("score"), "source_weight",
        F.round("effective_score", 6).alias("effective_score"), F.col("rank").cast("bigint").alias("rank"),
    )


# -- Vectors ----------------------------------------------------------------

EMBED_SQL = """
w AS (SELECT {key}, unnest(regexp_extract_all(lower(substr(text, 1, 8000)), '\\S+')) AS word FROM {source}),
b AS (SELECT {key}, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % 1024 AS dim, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT {key}, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT)::DOUBLE AS x FROM b)"""


@query("o65_embed_text", "WITH " + EMBED_SQL.format(key="doc_id", source="documents") + """
SELECT doc_id, count(*) AS dims_used, round(sum(x), 6) AS total, round(max(x), 6) AS largest FROM v GROUP BY doc_id
""")
def embed_text(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", V.embed(F.col("text"), V.HashingEmbedder()).alias("v"))
    long = rows.select("doc_id", F.explode_outer("v").alias("x")).where(F.col("x") != 0)
    x = F.col("x").cast("double")
    return long.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("dims_used"), F.round(F.sum(x), 6).alias("total"), F.round(F.max(x), 6).alias("largest")
    )


@query("o66_embed_batch", "WITH " + EMBED_SQL.format(key="conv_id, turn", source="conversations") + """
SELECT conv_id, turn, dim, round(x, 6) AS x FROM v
""")
def embed_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", V.embed(F.col("text"), V.HashingEmbedder()).alias("v"))
    long = rows.select("conv_id", "turn", F.posexplode_outer("v").alias("dim", "x")).where(F.col("x") != 0)
    return long.select("conv_id", "turn", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("o67_cosine", f"""
SELECT a.vec_id, round({sql_cos('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


ALL_TOP = f"""WITH eq AS ({plain(EACH_VECTOR)}), ec AS (SELECT vec_id AS chunk_id, embedding FROM embeddings),
{cand('top', 'eq', 'ec', TOP_K)} SELECT qid, chunk_id, round(score, 6) AS score, cr AS rank FROM top"""


def hits(rows):
    return rows.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vector_chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("o68_top_k", ALL_TOP)
def top_k(spark, sf_dir):
    return hits(S.top_k(portable(spark, sf_dir, EACH_VECTOR), vector_chunks(spark, sf_dir), TOP_K))


@query("o69_doc_type_filter", f"""
WITH {BASE_CTE}, {cand('top', 'q', 'ch', TOP_K, "c.doc_type = 'code'")} SELECT qid, chunk_id, round(score, 6) AS score, cr AS rank FROM top
""")
def doc_type_filter(spark, sf_dir):
    pool = chunks(spark, sf_dir).where(F.col("doc_type") == "code")
    return hits(S.top_k(questions(spark, sf_dir), pool, TOP_K))


@query("o70_weighted_top_k", f"""
WITH {BASE_CTE}, {MEANS_CTE}, {cand('cand', 'means', 'ch', 2 * TOP_K)},
{ranked('out', 'cand', sql_weight('source_file', K.SOURCE_WEIGHTS), TOP_K, 0.1)} SELECT {RESULT} FROM out
""")
def weighted_top_k(spark, sf_dir):
    return shown(R.retrieve(label_means(spark, sf_dir), chunks(spark, sf_dir), TOP_K, min_score=0.1))


STOP = "[" + ", ".join(f"'{w}'" for w in K.STOPWORDS) + "]"


def sql_keywords(x: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_-]*')), "
        f"lambda t: length(t) > 2 AND NOT list_contains({STOP}, t))"
    )


@query("o71_keywords", f"SELECT item_id, unnest({sql_keywords('text')}) AS keyword FROM benchmark")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(Q.keywords(F.col("text"))).alias("keyword"))


def sql_overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0 END"


@query("o72_keyword_overlap", f"""
WITH k AS (SELECT doc_id, {sql_keywords('text')} AS kw FROM documents), b AS (SELECT item_id, {sql_keywords('text')} AS kw FROM benchmark)
SELECT doc_id, item_id, round({sql_overlap('b.kw', 'k.kw')}, 6) AS overlap
FROM b JOIN (SELECT *, doc_id % (SELECT count(*) FROM benchmark) AS turn FROM k) k ON k.turn = b.item_id
""")
def keyword_overlap(spark, sf_dir):
    """Every document with one benchmark item, dealt in turn."""
    items = table(spark, sf_dir, "benchmark")
    turn = F.col("doc_id") % items.agg(F.count(F.lit(1))).scalar()
    docs = table(spark, sf_dir, "documents").select("doc_id", turn.alias("item_id"), F.col("text").alias("content"))
    pair = items.join(docs, "item_id")
    overlap = Q.keyword_overlap(Q.keywords(F.col("text")), Q.keywords(F.col("content")))
    return pair.select("doc_id", "item_id", F.round(overlap, 6).alias("overlap"))


RERANK = f"""rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY boosted DESC NULLS LAST, before) AS rank FROM (
  SELECT * EXCLUDE (rank), rank AS before, CASE WHEN len(kw) > 0 THEN 0.75::DOUBLE * effective_score + 0.25::DOUBLE * ({sql_overlap('kw', 'ckw')}) END AS boosted
  FROM (SELECT *, {sql_keywords('question')} AS kw, {sql_keywords('content')} AS ckw FROM prim) a) b)"""


@query("o73_keyword_rerank", f"""
WITH {BASE_CTE}, {PRIMARY}, {RERANK} SELECT qid, chunk_id, round(boosted, 6) AS boosted_score, rank FROM rr
""")
def keyword_rerank(spark, sf_dir):
    q = questions(spark, sf_dir)
    rows = R.keyword_rerank(R.retrieve(q, chunks(spark, sf_dir), TOP_K), q)
    return rows.select("qid", "chunk_id", F.round("boosted_score", 6).alias("boosted_score"), F.col("rank").cast("bigint").alias("rank"))


SECONDARY = (
    cand("cand2", "q", "ch", TOP_K // 2, "NOT c.is_child")
    + f", sec AS (SELECT *, score * source_weight AS effective_score, cr AS rank FROM (SELECT *, {sql_weight('source_file', K.SOURCE_WEIGHTS)} AS source_weight FROM cand2) z)"
)


@query("o74_secondary_pass", f"WITH {BASE_CTE}, {SECONDARY} SELECT {RESULT} FROM sec")
def secondary_pass(spark, sf_dir):
    q = questions(spark, sf_dir)
    return shown(R.retrieve_secondary(q, chunks(spark, sf_dir), TOP_K // 2, q.count()))


def sql_prefix(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(substr({x}, 1, 150)), '\\S+'))"


def sql_jaccard(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / "
        f"len(list_distinct(list_concat({a}, {b}))) END)"
    )


@query("o75_prefix_similarity", f"""
WITH p AS (SELECT doc_id, {sql_prefix('text')} AS w FROM documents)
SELECT a.doc_id, round({sql_jaccard('a.w', 'b.w')}, 6) AS similarity FROM p a JOIN p b ON b.doc_id = a.doc_id + 20
""")
def prefix_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", Q.prefix_words(F.col("text")).alias("w"))
    other = rows.select((F.col("doc_id") - 20).alias("doc_id"), F.col("w").alias("v"))
    return rows.join(other, "doc_id").select("doc_id", F.round(Q.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


def greedy(name: str, seed: str, source: str, threshold: float) -> str:
    """Rows of ``source`` (qid, rank, words), in order, unlike the words kept so far, starting from ``seed``."""
    return f"""{name} AS (SELECT qid, 0::BIGINT AS rank, false AS keep, kept FROM {seed}
  UNION ALL SELECT s.qid, s.rank, NOT dup, CASE WHEN dup THEN kept ELSE list_append(kept, words) END
  FROM (SELECT s.*, g.kept, len(list_filter(g.kept, lambda x: {sql_jaccard('x', 's.words')} >= {threshold}::DOUBLE)) > 0 AS dup
    FROM {name} g JOIN {source} s ON s.qid = g.qid AND s.rank = g.rank + 1) s)"""


MERGE = f"""
secw AS (SELECT qid, rank, {sql_prefix('content')} AS words FROM sec),
seeds AS (SELECT q.qid, coalesce(list({sql_prefix('content')} ORDER BY rank) FILTER (content IS NOT NULL), []) AS kept FROM q LEFT JOIN rr USING (qid) GROUP BY 1),
{greedy('walk', 'seeds', 'secw', K.MERGE_THRESHOLD)},
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY effective_score DESC, part, before) AS rank FROM (
    SELECT qid, chunk_id, score, source_weight, effective_score, 0 AS part, rank AS before FROM rr
    UNION ALL SELECT s.qid, chunk_id, score, source_weight, effective_score, 1, s.rank FROM sec s JOIN walk w ON w.qid = s.qid AND w.rank = s.rank AND w.keep) a) b
  WHERE rank <= {TOP_K})"""


@query("o76_hybrid_merge", f"WITH RECURSIVE {BASE_CTE}, {PRIMARY}, {RERANK}, {SECONDARY}, {MERGE} SELECT {RESULT} FROM merged")
def hybrid_merge(spark, sf_dir):
    q, pool = questions(spark, sf_dir), chunks(spark, sf_dir)
    primary = R.keyword_rerank(R.retrieve(q, pool, TOP_K), q)
    return shown(R.merge(primary, R.retrieve_secondary(q, pool, TOP_K // 2, q.count()), TOP_K))


def dedup_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE {BASE_CTE}, {PRIMARY},
primw AS (SELECT qid, rank, {sql_prefix('content')} AS words FROM prim), seeds AS (SELECT DISTINCT qid, []::VARCHAR[][] AS kept FROM prim),
{greedy('walk', 'seeds', 'primw', threshold)}
SELECT p.qid, p.chunk_id, row_number() OVER (PARTITION BY p.qid ORDER BY p.rank) AS rank FROM prim p JOIN walk w ON w.qid = p.qid AND w.rank = p.rank AND w.keep"""


def dedup(spark, sf_dir, threshold):
    rows = R.deduplicate(R.retrieve(questions(spark, sf_dir), chunks(spark, sf_dir), TOP_K), threshold)
    return rows.select("qid", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query("o77_dedup", dedup_sql(K.DEDUP_THRESHOLD))
def dedup_default(spark, sf_dir):
    return dedup(spark, sf_dir, K.DEDUP_THRESHOLD)


@query("o77_dedup_loose", dedup_sql(0.08))
def dedup_loose(spark, sf_dir):
    return dedup(spark, sf_dir, 0.08)


@query("o78_strategy_dispatch", f"""
WITH RECURSIVE {BASE_CTE}, {PRIMARY}, {RERANK}, {SECONDARY}, {MERGE}
SELECT {RESULT} FROM prim WHERE q_strategy NOT IN ('keyword_boosted', 'hybrid')
UNION ALL SELECT {RESULT} FROM rr WHERE q_strategy = 'keyword_boosted'
UNION ALL SELECT {RESULT} FROM merged WHERE qid IN (SELECT qid FROM q WHERE strategy = 'hybrid')
""")
def strategy_dispatch(spark, sf_dir):
    return shown(R.retrieve_with_strategy(questions(spark, sf_dir), chunks(spark, sf_dir), TOP_K))


@query("o79_list_index_exact", ALL_TOP)
def list_index_exact(spark, sf_dir):
    index = ann.build_index(vector_chunks(spark, sf_dir), lists=16, iterations=3)
    return hits(ann.search(portable(spark, sf_dir, EACH_VECTOR), index, TOP_K, nprobe=2, exact=True))


@query("o79_stored_index", ALL_TOP)
def stored_index(spark, sf_dir):
    """An index over the even vectors is stored, the odd ones are appended, and both are searched."""
    rows, path = vector_chunks(spark, sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/indexes/{uuid.uuid4().hex}"
    even = F.pmod("chunk_id", F.lit(2)) == 0
    ann.save_index(ann.build_index(rows.where(even), lists=16, iterations=3), path)
    index = ann.add_vectors(spark, path, rows.where(~even))
    return hits(ann.search(portable(spark, sf_dir, EACH_VECTOR), index, TOP_K, nprobe=2, exact=True))


@query("o80_retrieval_report", f"""
WITH {BASE_CTE}, {cand('cand', 'q', 'ch', TOP_K)},
w AS (SELECT *, 's3://store/' || source_file AS source_uri, {sql_weight('source_file', K.REPORT_SOURCE_WEIGHTS)} AS source_weight FROM cand)
SELECT qid, source_file, source_uri, round(score, 4) AS score, source_weight, round(score * source_weight, 4) AS effective_score,
  substr(content, 1, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END AS content_preview,
  row_number() OVER (PARTITION BY qid ORDER BY round(score * source_weight, 4) DESC, cr) AS rank FROM w
""")
def retrieval_report(spark, sf_dir):
    q, pool = questions(spark, sf_dir), chunks(spark, sf_dir)
    found = S.attach(S.top_k(q, pool, TOP_K), pool, TOP_K * q.count())
    rows = R.retrieval_report(found.withColumn("source_uri", F.concat(F.lit("s3://store/"), "source_file")), TOP_K)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


# -- Cache ------------------------------------------------------------------

NOW = "TIMESTAMP '2024-01-05 00:00:00'"
CACHE = """
SELECT CAST(event_id AS STRING) AS cache_id, embedding AS question_embedding, '' AS response_json,
  CASE label % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'project' ELSE 'architecture' END AS question_type, user_id AS hit_count,
  CAST(ts AS TIMESTAMP) AS created_at, CAST(date_trunc('day', ts) AS TIMESTAMP) + label * INTERVAL '1' DAY AS expires_at
FROM (SELECT *, event_id % (SELECT count(*) FROM {embeddings}) AS v FROM {events}) v JOIN {embeddings} e ON e.vec_id = v.v
"""
DUCK_CACHE = plain(CACHE)


def stored_cache(spark, sf_dir):
    return portable(spark, sf_dir, CACHE)


def now():
    return F.expr(NOW)


LOW = 0.3


def lookup_sql(threshold: float) -> str:
    return f"""c AS ({DUCK_CACHE}), eq AS ({plain(EACH_VECTOR)}),
found AS (SELECT * FROM (SELECT qid, cache_id, {sql_cos('question_embedding_q', 'question_embedding')} AS score FROM c,
    (SELECT qid, question_embedding AS question_embedding_q FROM eq) e WHERE expires_at > {NOW}) z WHERE score >= {threshold}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cache_id) = 1)"""


@query("o81_cache_lookup", f"WITH {lookup_sql(K.CACHE_THRESHOLD)} SELECT qid, cache_id, round(score, 6) AS score FROM found")
def cache_lookup(spark, sf_dir):
    rows = cache.lookup(portable(spark, sf_dir, EACH_VECTOR), stored_cache(spark, sf_dir), now())
    return rows.withColumn("score", F.round("score", 6))


@query("o81_cache_lookup_loose", f"WITH {lookup_sql(LOW)} SELECT qid, cache_id, round(score, 6) AS score FROM found")
def cache_lookup_loose(spark, sf_dir):
    rows = cache.lookup(portable(spark, sf_dir, EACH_VECTOR), stored_cache(spark, sf_dir), now(), LOW)
    return rows.withColumn("score", F.round("score", 6))


@query("o82_hit_counts", f"""
WITH {lookup_sql(LOW)}, n AS (SELECT cache_id, count(*) AS n FROM found GROUP BY 1)
SELECT cache_id, hit_count + coalesce(n, 0) AS hit_count FROM c LEFT JOIN n USING (cache_id)
""")
def hit_counts(spark, sf_dir):
    entries = stored_cache(spark, sf_dir)
    found = cache.lookup(portable(spark, sf_dir, EACH_VECTOR), entries, now(), LOW)
    return cache.count_hits(entries, found).select("cache_id", "hit_count")


@query("o84_cache_insert", f"""
WITH RECURSIVE c AS (SELECT * FROM ({DUCK_CACHE}) z WHERE expires_at > {NOW}),
e AS (SELECT seq, embedding, row_number() OVER (ORDER BY seq) AS i FROM (
  SELECT 2 * vec_id AS seq, embedding FROM embeddings UNION ALL SELECT 2 * vec_id + 1, list_reverse(embedding) FROM embeddings) z),
free AS MATERIALIZED (SELECT i, seq, EXISTS (SELECT 1 FROM c WHERE {sql_cos('c.question_embedding', 'e.embedding')} >= {LOW}::DOUBLE) AS taken FROM e),
nb AS MATERIALIZED (SELECT a.i, list(b.i) AS earlier FROM e a JOIN e b ON b.i < a.i AND {sql_cos('a.embedding', 'b.embedding')} >= {LOW}::DOUBLE GROUP BY 1),
step AS MATERIALIZED (SELECT f.i, f.seq, f.taken, coalesce(nb.earlier, []) AS earlier FROM free f LEFT JOIN nb USING (i)),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT s.i, CASE WHEN s.taken OR list_has_any(s.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, s.i) END
  FROM walk w JOIN step s ON s.i = w.i + 1)
SELECT e.seq FROM e WHERE list_contains((SELECT kept FROM walk ORDER BY i DESC LIMIT 1), e.i)
""")
def cache_insert(spark, sf_dir):
    entries = stored_cache(spark, sf_dir)
    # Every vector asks twice: as it is, which the cache may know, and turned round, which it does not hold.
    rows, seq = table(spark, sf_dir, "embeddings"), F.col("vec_id") * 2
    asked = rows.select(seq.alias("seq"), "embedding").unionByName(rows.select((seq + 1).alias("seq"), F.reverse("embedding").alias("embedding")))
    return cache.insert_new(asked, entries, now(), LOW).select("seq")


@query("o86_cache_inspect", f"""
SELECT cache_id, question_type, hit_count, CAST(CAST(expires_at AS DATE) AS STRING) AS expires_on FROM ({DUCK_CACHE}) c
WHERE expires_at > {NOW} ORDER BY hit_count DESC, cache_id LIMIT 20
""")
def cache_inspect(spark, sf_dir):
    rows = cache.inspect(stored_cache(spark, sf_dir), now())
    return rows.select("cache_id", "question_type", "hit_count", F.to_date("expires_at").cast("string").alias("expires_on"))
