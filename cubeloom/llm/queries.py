"""The registered queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as lines
from . import embedding_dedup, minhash, mixing, oracles, packing, quality, secret_scan, staging, token_counts, topk, toxicity

log = logging.getLogger("cubeloom")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    reduced = lines.keep_lines(docs, lines.line_dedup(docs))
    return reduced.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal vectors; the recall of a sample, found by brute force, is logged."""
    vectors = _table(spark, sf_dir, "embeddings")
    result = staging.stage(embedding_dedup.near_duplicate_vectors(vectors), "vector-result")
    recall = embedding_dedup.audit_recall(vectors, result)
    log.log(logging.INFO if recall >= 0.9 else logging.WARNING, "op3_embedding_dedup: %.5f of the sampled vectors' links were found", recall)
    return result


#: Vocabulary that token counts use by default, beside blank-separated words.
BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_totals(spark: SparkSession, docs: DataFrame, tokenizers: list[token_counts.Tokenizer]) -> DataFrame:
    """Totals after a history of batches: documents come without a language, get it by revision, come twice and lose the second copy; batches are sent again, before and after compaction."""
    counts = staging.stage(token_counts.count_tokens(docs, tokenizers), "token-counts")
    totals = token_counts.TokenTotals(spark, staging.new_path(spark, "token-totals"))
    bare = counts.withColumn("lang", F.lit(None).cast("string"))
    load, languages = token_counts.inserts(bare), token_counts.revisions(bare, counts)
    applied = [
        totals.apply("load", load),
        totals.apply("languages", languages),
        totals.apply("languages", languages),
        totals.apply("second-copy", token_counts.inserts(counts)),
        totals.apply("second-copy-gone", token_counts.deletes(counts)),
    ]
    totals.compact()
    applied.append(totals.apply("load", load))
    if applied != [True, True, False, True, True, False]:
        raise RuntimeError(f"batches were not applied once each: {applied}")
    return totals.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = BPE_FILE) -> DataFrame:
    tokenizers = [token_counts.Tokenizer("words-1"), token_counts.Tokenizer.from_file("byte-bpe-50k-1", vocabulary)]
    return token_totals(spark, _table(spark, sf_dir, "documents"), tokenizers)


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 with the tokenizer that SQL can state."""
    return token_totals(spark, _table(spark, sf_dir, "documents"), [token_counts.Tokenizer("words-1")])


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4).drop("text_hash", "chosen")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_embedding_dedup, op4_token_counts, word_totals, op5_exact_topk, op6_quality, op7_toxicity, op8_minhash_dedup, op9_packing, op10_mixing)}


_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_MIX_SQL = r"""
WITH measured AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         strlen(regexp_replace(coalesce(text, ''), '[\x00-@\[-`{-\x7F]', '', 'g')) AS letters,
         strlen(coalesce(text, '')) AS bytes,
         (('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), keyed AS (
  SELECT *, -ln(u) / greatest(0.05::DOUBLE, letters::DOUBLE / greatest(bytes, 1)) AS es_key FROM measured
), sources AS (
  SELECT source, skey, sum(size)::BIGINT AS source_size FROM keyed GROUP BY ALL
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM sources
), stepped AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER w, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((total - capped) / open_weight, cap / weight) AS l
  FROM stepped WHERE (total - capped) / open_weight <= cap / weight
), targets AS (
  SELECT skey, source_size, least(cap, coalesce(l * weight, cap)) AS target FROM weighed, level
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         floor(t.target / greatest(t.source_size, 1)) AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.skey ORDER BY k.es_key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t USING (skey)
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""


_TOPK_SQL = """
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), sound AS (
  SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))
), ints AS (
  SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts SEMI JOIN sound USING (vec_id)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), "op2_line_dedup": _LINES_SQL, "op5_exact_topk": _TOPK_SQL, "op10_mixing": _MIX_SQL}
