"""One query per operator, over its whole table and with production parameters, and the SQL where it says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import (
    decontamination, embedding_neardup, language_id, license_scan, mixing, piece_codec, pii_surrogates, prefix_trie, quality, ranked_search,
    sharding, simhash_neardup, substring_dedup,
)
from dossier.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


@query("op1_embedding_neardup", """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s USING (vec_id) LEFT JOIN degree d USING (vec_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_simhash_neardup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


@query("language_of_pages")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_pii_surrogates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_entities(table(spark, sf_dir, "documents"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", """
WITH turns AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), talks AS (
  SELECT c, c - (c % 5 + 5) % 5 AS lender, list(t ORDER BY p) AS t, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::UBIGINT)),
      lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT))))) % 9 AS h
  FROM turns GROUP BY c
), whole AS (
  SELECT a.c, list_concat(coalesce(b.t[1:a.h::BIGINT], []), a.t[a.h::BIGINT + 1:]) AS w FROM talks a LEFT JOIN talks b ON b.c = a.lender
), prefixes AS (SELECT c, len(w) AS size, unnest(range(0, len(w) + 1)) AS d, w FROM whole
), nodes AS (
  SELECT w[1:d] AS n, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d) AS ends
  FROM prefixes GROUP BY 1, 2
), linked AS (
  SELECT a.*, a.n[1:a.d - 1] AS up, (SELECT count(*) FROM nodes k WHERE k.d = a.d + 1 AND k.n[1:k.d - 1] = a.n) AS n_children FROM nodes a
), below AS (
  SELECT a.n, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
    sum(CASE WHEN b.d > 0 THEN (b.n_convs - 1) * strlen(b.n[b.d].x) ELSE 0 END)::BIGINT AS saved_tokens
  FROM linked a JOIN linked b ON b.d >= a.d AND b.n[1:a.d] = a.n GROUP BY 1, 2
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM linked a JOIN below b ON a.n = b.n AND a.d = b.d LEFT JOIN nodes p ON p.d = a.d - 1 AND p.n = a.up
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


@query("op12_ranked_search", r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2), len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1
), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN tf USING (t) JOIN df USING (t) JOIN len USING (doc_id), total GROUP BY 1, 2
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored
WHERE score > 0 QUALIFY rank <= 50
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_piece_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = piece_codec.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_codec.digests(table(spark, sf_dir, "documents"), vocabulary)
