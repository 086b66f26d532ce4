"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwatch.llm import alignment, byte_pairs, contamination, gru_lm, jaccard, kneser_ney, language_id, lexical_search, ring, rule_forest, simhash, token_records, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in whole-file gzip streams, normalised to a member per record and read back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(pages).select(
        F.col("id").cast(kind).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as checked binary records, written in ascending doc_id order and read back."""

    def digest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], token_records.crc32_of(b.column("ids"))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    read = token_records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of the benchmark items, by a suffix automaton of the items."""
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles are nine tenths alike."""
    return jaccard.grouped(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and the verdict of its language's threshold."""
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a recurrent model of nine tenths of them, and under their word counts."""
    return gru_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op7_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, and the verdict of base rules and isolation forest."""
    return rule_forest.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards of a ring with bounded loads, row counts at most one apart."""
    return ring.placed(table(spark, sf_dir, "documents"), 16)


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual ranks, and the bytes that they decode to."""
    return byte_pairs.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    return language_id.held_out_predictions(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item by an integer BM25-like score, searched in sparse ball trees."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level BPE and the sentencepiece tokens of every document, with corpus counts."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(table(spark, sf_dir, "documents"), a, b)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every document's three-word shingles, linked at two differing bits or fewer."""
    return simhash.grouped(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_records": op2_token_records,
    "op3_contamination": op3_contamination,
    "op4_jaccard": op4_jaccard,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_gru_lm": op6_gru_lm,
    "op7_rule_forest": op7_rule_forest,
    "op8_byte_pairs": op8_byte_pairs,
    "op9_ring": op9_ring,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_alignment": op12_alignment,
    "op13_simhash": op13_simhash,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, CAST(coalesce(octet_length(encode(html)), 0) AS BIGINT) AS payload_bytes,
                sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), g AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS original
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN original <> page_id THEN original END AS refers_to
        FROM g
    """,
    "op3_contamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
        ), starts AS (
            SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM starts
        ), places AS (
            SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
            FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
        ), runs AS (
            SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS k FROM places
        ), hits AS (
            SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, k)
        ), marked AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op4_jaccard": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM starts
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 90 * (x.n + y.n - common)
        ), reach AS (
            SELECT a, b FROM links
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id
        FROM d LEFT JOIN sizes USING (doc_id)
            LEFT JOIN (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a) USING (doc_id)
    """,
    "op11_lexical_search": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS t FROM documents WHERE doc_id IS NOT NULL
        ), sizes AS (
            SELECT doc_id, sum(len(t)) AS n FROM d GROUP BY doc_id
        ), stats AS (
            SELECT count(*) FILTER (WHERE n > 0) AS big_n, sum(n) AS big_l FROM sizes
        ), qt AS (
            SELECT item_id, term, count(*) AS qtf
            FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark)
            GROUP BY ALL
        ), p AS (
            SELECT doc_id, term, count(*) AS tf
            FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2.0 * big_n + 2.0) / (2.0 * count(*) + 1.0))) AS BIGINT) AS w
            FROM p, stats GROUP BY term, big_n
        ), v AS (
            SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)) AS v
            FROM p JOIN sizes USING (doc_id), stats
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * qtf * v) AS BIGINT) AS score FROM qt JOIN w USING (term) JOIN v USING (term) GROUP BY ALL
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
