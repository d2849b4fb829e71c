"""The thin queries of the corpus operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lm, minhash, mixing, packing, quality, subspace, suffix_dedup, tokencount, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1,
    "op2_topk": topk.op2,
    "op3_token_counts": tokencount.op3,
    "op4_subspace": subspace.op4,
    "op5_mixing": mixing.op5,
    "op6_quality": quality.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_warc": warc.op8,
    "op9_minhash": minhash.op9,
    "op10_lm": lm.op10,
}

ORACLES: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op4_subspace": subspace.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op9_minhash": minhash.ORACLE,
    "op8_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, 'urn:none'), '[\x00-\x20]', '', 'g') AS url FROM pages),
             q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, url,
                          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]+)?', ['host', 'path', 'query']) AS u FROM p),
             h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(u.host), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host FROM q),
             k AS (SELECT *, CASE WHEN host = '' THEN lower(url)
                          ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query) END AS url_key FROM h),
             r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f,
                          row_number() OVER (ORDER BY url_key, ((page_id % 2147483648) + 2147483648) % 2147483648, page_id) - 1 AS index_position FROM k)
        SELECT page_id, payload_bytes, payload_digest, url_key, index_position,
               CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
        FROM r""",
}
