"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skriba.llm.decontam import decontaminate
from skriba.llm.lm_score import language_model_scores
from skriba.llm.media import media_table
from skriba.llm.mixing import mix_sources
from skriba.llm.near_dup import near_duplicates
from skriba.llm.pii import personal_data
from skriba.llm.substring_dedup import substring_dedup
from skriba.llm.token_output import token_table
from skriba.llm.toxicity import toxicity
from skriba.llm.url_filter import url_verdicts

END_ID = 2


def vocabulary() -> str:
    """Path of the public vocabulary that token output encodes with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark, sf_dir):
    """Zstandard shards with seek tables, read back document by document."""
    return token_table(_table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def op2_toxicity(spark, sf_dir):
    """Toxicity scores by the clause grammar."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    """Personal data by anchor expansion."""
    return personal_data(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark, sf_dir):
    """Near-duplicate components on shingles of four words."""
    return near_duplicates(_table(spark, sf_dir, "documents"), 4, 80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_media(spark, sf_dir):
    """Payloads as grey images in content-addressed tar shards."""
    return media_table(_table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    """Sources mixed to their target words."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op7_decontamination(spark, sf_dir):
    """Documents with windows of benchmark items."""
    judged = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_substring_dedup(spark, sf_dir):
    """Words kept when repeated windows of twenty words go."""
    return substring_dedup(_table(spark, sf_dir, "documents"), 20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_url_filter(spark, sf_dir):
    """Verdicts on pages by rules and by trust and distrust of their hosts."""
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op10_lm_score(spark, sf_dir):
    """Hierarchical Pitman-Yor scores."""
    return language_model_scores(_table(spark, sf_dir, "documents"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS k FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN sides b ON b.a = r.node
), least_ AS (
  SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least_ l ON l.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_DECONTAMINATION_SQL = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, k, n, item_id FROM dw JOIN win USING (s, n)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  coalesce(i.sha, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

_SUBSTRING_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)
), ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM win
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM ranked WHERE r > 1)
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY p)) AS sha FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, coalesce(k.sha, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_output, op2_toxicity, op3_pii, op4_near_duplicates, op5_media, op6_mixing, op7_decontamination, op8_substring_dedup, op9_url_filter, op10_lm_score)}


def oracle_sql() -> dict:
    return {"op4_near_duplicates": _NEAR_SQL, "op7_decontamination": _DECONTAMINATION_SQL, "op8_substring_dedup": _SUBSTRING_SQL}
