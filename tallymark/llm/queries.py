"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import (contamination, counts, divergence, huffman, jaccard, lines, packing, quality,
               simhash, spelling, toxicity, urls, warc)
from .tokens import id_type, tokenizer_path, vocabulary_size

# Fixed values of the url query: its rules, longest match first wins.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
SEQUENCE_TOKENS = 4096


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_of(dtype: str):
    """crc32 of packed ids as little-endian unsigned 32-bit integers."""
    @arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes())
                         for x in ids.to_pylist()], pa.int64())
    return crc


def op1_best_fit_packing(spark, folder):
    path = tokenizer_path(WORD_VOCABULARY)
    packed = packing.pack(table(spark, folder, "documents"), path, end_id=1,
                          capacity=SEQUENCE_TOKENS)
    crc = crc32_of(id_type(vocabulary_size(path)))
    return packed.select("doc_id", "piece", "start", "length", crc("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


def op2_ngram_jaccard_join(spark, folder):
    return jaccard.similar_documents(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "n_links", "n_shingles")


def op3_url_filters(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return urls.judge(table(spark, folder, "pages"), labels, URL_RULES).drop("match")


def op4_token_files(spark, folder):
    files = huffman.write_tokens(table(spark, folder, "documents"),
                                 tokenizer_path(BYTE_VOCABULARY), end_id=0)
    return huffman.read_tokens(files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op5_token_counts(spark, folder):
    return counts.count_tokens(table(spark, folder, "documents"),
                               tokenizer_path(BYTE_VOCABULARY), limit=1024)


def op6_archives(spark, folder):
    old = warc.write_arc(table(spark, folder, "pages"))
    records = warc.read_archives(warc.convert_archives(old))
    return warc.with_referred_rows(records).select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        "refers_to")


def op7_line_dedup(spark, folder):
    cleaned = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark, folder):
    return toxicity.score_documents(table(spark, folder, "documents"),
                                    table(spark, folder, "labels"))


def op9_benchmark_decontamination(spark, folder):
    return contamination.find_overlaps(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op10_quality_rules(spark, folder):
    return quality.rate(table(spark, folder, "documents")).drop("coverage", "counted", "line_coverage")


def op11_simhash_groups(spark, folder):
    return simhash.near_fingerprints(table(spark, folder, "documents"))


def op12_spelling_variants(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op13_source_divergence(spark, folder):
    return divergence.source_divergence(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_ngram_jaccard_join, op3_url_filters, op4_token_files,
    op5_token_counts, op6_archives, op7_line_dedup, op8_toxicity,
    op9_benchmark_decontamination, op10_quality_rules, op11_simhash_groups,
    op12_spelling_variants, op13_source_divergence)}
ORACLES: dict[str, str] = {
    "op6_archives": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                     sha256(coalesce(html, '')) AS payload_digest,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
              FROM pages)""",
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12)
                                     || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        marked AS (
            SELECT *, length(key) >= 10
                      AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone
            FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
                   AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source, coalesce(text, '') AS text
            FROM documents),
        found AS (
            SELECT doc, lang, source,
                   unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM docs),
        terms AS (
            SELECT doc, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz') AS term
            FROM found),
        kept AS (
            SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term
            HAVING count(DISTINCT doc) >= 3),
        langs AS (
            SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        cells AS (
            SELECT lang, source, term, count(*) AS n
            FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        groups AS (
            SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v,
                   coalesce(lang_total, 0)::HUGEINT AS lang_total
            FROM (SELECT DISTINCT lang, source FROM docs)
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source)
                USING (lang, source)
            LEFT JOIN langs USING (lang)),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p,
                   1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v) AS q
            FROM groups g JOIN kept k USING (lang) LEFT JOIN cells USING (lang, source, term)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item,
                   sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL),
        all_pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
        standing AS (
            SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
            FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value,
               row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank
        FROM all_pairs
        UNION ALL
        SELECT * FROM (
            SELECT lang, source, 'term' AS part, item, value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank
            FROM standing) WHERE rank <= 200""",
}
