"""The registered queries op1 to op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, decontam, divergence, embed_dedup, minhash, periodic, pivot_search, quality, quotes, repair, secret_scan, token_trie, toxicity
from touchline.llm.common import modest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clusters(_table(spark, sf_dir, "documents"), minhash.Settings(words=4))


def op4_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.clusters(_table(spark, sf_dir, "embeddings"))


def op5_token_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.token_counts(_table(spark, sf_dir, "documents"))


def op6_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(_table(spark, sf_dir, "conversations"))


def op7_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(_table(spark, sf_dir, "documents"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_quality_gam, op2_secret_scan, op3_minhash_dedup, op4_embedding_passes, op5_token_trie, op6_quote_threads,
    op7_repair_token_files, op8_latent_decontamination, op9_toxicity_mil, op10_bpe_backtracking,
    op11_periodic_runs, op12_source_divergence, op13_pivot_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: DuckDB SQL of the queries that SQL can express; near-duplicates by brute force over all shared shingles and all pairs.
ORACLES: dict[str, str] = {
    "op3_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), nodes AS (
  SELECT md5(array_to_string(list_sort(s), chr(1))) AS node, min(doc_id) AS rep, any_value(len(s)) AS n, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 1
), shingles AS (
  SELECT rep, n, hash(x) AS x FROM (SELECT rep, n, unnest(s) AS x FROM nodes)
), pairs AS (
  SELECT a.rep AS u, b.rep AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs
), reach AS (
  SELECT rep AS node, rep AS seen FROM nodes
  UNION
  SELECT r.node, b.v FROM reach r JOIN edges b ON b.u = r.seen
), labels AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY 1
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN nodes n ON len(s.s) > 0 AND n.node = md5(array_to_string(list_sort(s.s), chr(1))) LEFT JOIN labels l ON l.node = n.rep
""",
    "op4_embedding_passes": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen
), labels AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.u = v.vec_id) AS BIGINT) AS n_links, c.component AS component_id, c.component = v.vec_id AS kept
FROM v JOIN labels c ON c.node = v.vec_id
""",
    "op6_quote_threads": quotes.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_pivot_search": pivot_search.ORACLE,
}
