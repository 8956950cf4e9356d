"""The queries of the corpus operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

#: The queries' key; a real corpus gets a secret one.
PII_KEY = "key of the test queries"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def rank_file(name: str = TOKENIZER) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN, ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("clean_text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.exact_dedup import classify_copies

    return classify_copies(table(spark, sf_dir, "documents"), keep="max")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from millrace.llm.language import learnable, predict, train

    docs = table(spark, sf_dir, "documents")
    predicted = predict(docs, train(docs.filter(learnable())))
    return predicted.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", F.col("score"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near_dedup import classify

    return classify(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key=PII_KEY)


# Columns of the queries above that SQL can state, over the same whole tables.


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {f.__name__: f for f in (mix_targets, bpe_round_trip, secret_base_counts)}


ORACLE = {
    "mix_targets": r"""
        WITH sizes AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source
        ), weighed AS (
            SELECT source, source_size, [5, 2, 1][1 + place % 3]::DOUBLE AS weight, 3::DOUBLE * source_size AS cap, place FROM sources
        ), before AS (  -- sources reach their cap in the order of cap by weight
            SELECT *, cap / weight <= (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS at_cap
            FROM weighed WINDOW earlier AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), levels AS (
            SELECT (sum(source_size) - coalesce(sum(cap) FILTER (WHERE at_cap), 0)) / sum(weight) FILTER (WHERE NOT at_cap) AS level FROM before
        )
        SELECT doc_id, size, source_size, least(weight * coalesce(level, 0), cap)::DOUBLE AS target
        FROM sizes JOIN before ON sizes.source IS NOT DISTINCT FROM before.source CROSS JOIN levels""",
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "secret_base_counts": r"""
        SELECT doc_id,
               len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6))::BIGINT AS n_assign,
               len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access,
               len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex
        FROM documents""",
    "op3_quality_rules": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
            FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM texts, unnest(range(1, len(w) - 3)) AS u(i))
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, range(5) AS r(j) WHERE times > 1 GROUP BY doc_id
        ), counted AS (
            SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(c.n, 0) AS n_repeat_words,
                   list_transform(lines, lambda x: {'x': x, 'n': len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))}) AS lines
            FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
        ), judged AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   coalesce(list_sum(list_transform(list_filter(lines, lambda l:
                       len(regexp_extract_all(l.x, '[#*$%&|<>]')) > 0.3::DOUBLE * l.n
                       OR len(regexp_extract_all(l.x, '[|»›·•]')) > 0.3::DOUBLE * l.n
                       OR len(regexp_extract_all(l.x, '[!?]{2,}')) > 0.3::DOUBLE * l.n
                       OR l.n < 3 AND NOT regexp_matches(l.x, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*$')
                       OR l.n < 25 AND regexp_matches(l.x, '(?i)(?:\b(?:all rights reserved|cookies?\b.{0,60}\b(?:accept|use|policy)|privacy policy|terms of (?:use|service)|click here|subscribe|sign (?:in|up)|log ?in|javascript|powered by|licensed under|released under the)\b|^\s*(?:©|\(c\)|copyright)\s)')
                   ), lambda l: l.n)), 0)::BIGINT AS lost_words
            FROM counted
        )
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
               n_repeat_words::BIGINT AS n_repeat_words, base_failed, lost_words, NOT base_failed AND lost_words <= 0.6::DOUBLE * n_words AS kept
        FROM judged""",
    "op5_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages
        )
        SELECT page_id,
               octet_length(encode(html))::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + (5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM payloads""",
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
            GROUP BY x.doc_id, y.doc_id, x.n, y.n
            HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
        ), least_of AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN least_of ON doc_id = a""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
