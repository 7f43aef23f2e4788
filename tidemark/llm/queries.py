"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, fingerprints, line_dedup, mixing, simhash_dedup, substring_dedup, suffix_array_dedup, token_counts, toxicity, url_filter

TOKEN_LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 400, "none").drop("kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("_score").alias("score"), toxicity.is_toxic(model).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 50).drop("kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("row")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "line_dedup.kept_sha256")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_suffix_array_dedup, op3_toxicity, op4_substring_dedup, op5_url_filter, op6_fingerprints, op7_decontamination, op8_line_dedup, op9_simhash_dedup, op10_mixing)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, i, CASE WHEN 2 * (i + 399) <= len(h) THEN md5(substr(h, 2 * i - 1, 800)) END AS w FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM d)),
        f AS (SELECT doc_id, i, CASE WHEN w IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY w) > 1 THEN 1 ELSE 0 END AS hit FROM s),
        c AS (SELECT doc_id, i, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
        r AS (SELECT doc_id, gone, i, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS run FROM c),
        g AS (SELECT doc_id, gone, min(i) AS a, max(i) AS b FROM r GROUP BY doc_id, gone, run),
        k AS (SELECT doc_id, sum(CASE WHEN gone = 1 THEN b - a + 1 ELSE 0 END)::bigint AS n_removed, count(*) FILTER (WHERE gone = 1) AS n_spans, string_agg(substr(h, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) FILTER (WHERE gone = 0) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, (len(d.h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS win FROM p),
        f AS (SELECT doc_id, i, word, CASE WHEN win IS NOT NULL THEN min(doc_id) OVER (PARTITION BY win) < doc_id ELSE false END AS hit FROM s),
        c AS (SELECT doc_id, i, word, max(hit::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
        k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(k.n_removed, 0)::bigint AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op7_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
        ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
        q AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
        widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
        dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
                FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, widths WHERE len(w) >= k)),
        m AS (SELECT doc_id, item_id, count(*) AS shared FROM dsh JOIN ish USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, shared AS n_shared, n AS n_item, shared / n AS containment
        FROM m JOIN q USING (item_id) WHERE shared >= ceil(n * 0.8 - 1e-9)""",
    "op8_line_dedup": rf"""
        WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM d),
        c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key),
        g AS (SELECT k.doc_id, i, line, (c.key IS NOT NULL AND c.n >= 3 AND c.last <> k.doc_id) AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
}
