"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import (
    bpe,
    decontaminate,
    langid,
    licenses,
    maxent,
    passages,
    pii,
    quality,
    runs,
    secrets,
    sharding,
    simhash,
    whitening,
)


def _on_documents(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.report(documents, benchmark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _on_documents(simhash.report),
        "op2_language": _on_documents(langid.report),
        "op3_secrets": _on_documents(secrets.report),
        "op4_bpe": _on_documents(bpe.digests),
        "op5_sharding": _on_documents(sharding.report),
        "op6_quality": _on_documents(quality.report),
        "op7_passages": _on_documents(passages.report),
        "op8_licenses": _on_documents(licenses.report),
        "op9_decontamination": _decontaminated,
        "op10_pii": _on_documents(pii.report),
        "op11_maxent": _on_documents(maxent.report),
        "op12_runs": _on_documents(runs.report),
        "op13_whitening": lambda spark, sf_dir: whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    }


RULES = quality.Rules()

QUALITY_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts),
sizes AS (SELECT unnest([{RULES.window}, {RULES.repeat}, {RULES.max_repeat + 1}]) AS size),
starts AS (
    SELECT rid, size, words, unnest(range(1, len(words) - size + 2)) AS pos FROM split, sizes WHERE len(words) >= size),
windows AS (SELECT rid, size, pos, md5(array_to_string(words[pos:pos + size - 1], ' ')) AS h FROM starts),
repeated AS (
    SELECT rid, size, unnest(range(pos, pos + size)) AS word
    FROM (SELECT *, count(*) OVER (PARTITION BY rid, size, h) AS n FROM windows) WHERE n > 1),
counted AS (SELECT rid, size, count(DISTINCT word) AS n FROM repeated GROUP BY rid, size),
lines AS (
    SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
measured AS (
    SELECT split.doc_id, len(words) AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(w.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered, l.n IS NOT NULL AS too_long
    FROM split LEFT JOIN lines USING (rid)
    LEFT JOIN counted w ON w.rid = split.rid AND w.size = {RULES.window}
    LEFT JOIN counted c ON c.rid = split.rid AND c.size = {RULES.repeat}
    LEFT JOIN counted l ON l.rid = split.rid AND l.size = {RULES.max_repeat + 1}),
judged AS (
    SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_window_percent} * n_words AS base_failed
    FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND 100 * n_covered <= {RULES.max_covered_percent} * n_words AND NOT too_long AS kept
FROM judged"""

_FOLDED = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION_SQL = f"""
WITH docs AS (
    SELECT rid, doc_id, {_FOLDED} AS words
    FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)),
items AS (SELECT item_id::VARCHAR AS item, {_FOLDED} AS words FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
    SELECT DISTINCT item, size, array_to_string(words[pos:pos + size - 1], ' ') AS w
    FROM (SELECT item, words, least(len(words), {decontaminate.WINDOW}) AS size,
            unnest(range(1, greatest(1, len(words) - {decontaminate.WINDOW - 1}) + 1)) AS pos
          FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
    SELECT rid, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS w
    FROM (SELECT rid, size, words, unnest(range(1, len(words) - size + 2)) AS pos
          FROM docs, sizes WHERE len(words) >= size)),
hits AS (SELECT rid, d.size, pos, item FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.w = i.w),
hit_words AS (
    SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY rid),
hit_items AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND {100 // decontaminate.MAX_PERCENT} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": sharding.oracle_sql(),
        "op6_quality": QUALITY_SQL,
        "op9_decontamination": DECONTAMINATION_SQL,
    }
