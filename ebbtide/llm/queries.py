"""One registered query per operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    class_lm, exact_dedup, filter_audit, html_text, ngram_join, packing, piece_sampling, quality_rules, ranked_search, secret_scan, token_files,
    vector_links, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def importable(spark: SparkSession) -> None:
    """Let the Python workers of a session that was started elsewhere import this repository."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if top not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [*paths, top]))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/pages.parquet")


@query("op1_sentencepiece_sampling")
def sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    read = piece_sampling.decoded(piece_sampling.encoded(documents(spark, folder), model), model)
    return read.select(
        F.col("key").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("lossless"))


@query("op2_ngram_jaccard_join")
def ngram_join_query(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


def _secrets_sql() -> str:
    """Every rule's spans by the texts between its matches, in code points."""
    blocks = []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        blocks.append(f"""
          SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, unnest(range(1, len(f) + 1)) AS i, b, f, g, {rule.least} AS least
          FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS b, regexp_extract_all(t, '{pattern}') AS f,
                       regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d)""")
    sizes = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda z: length(z))), 0)"
    line = "kind || ':' || s || ':' || e"
    return f"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      m AS ({' UNION ALL '.join(blocks)}),
      p AS (SELECT doc_id, kind, place, CAST({sizes('b', 'i')} + {sizes('f', 'i - 1')} AS BIGINT) AS s, length(f[i]) AS size FROM m WHERE length(g[i]) >= least),
      x AS (SELECT *, s + size AS e FROM p),
      a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg({line}, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg({line}, ',' ORDER BY s, place) AS spans
            FROM x GROUP BY doc_id)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
             sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
      FROM d LEFT JOIN a USING (doc_id)"""


@query("op3_secret_scan", _secrets_sql())
def secret_scan_query(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder))
    of = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long")
    base = F.filter("findings", lambda f: f.kind.isin("assign", "access", "hex"))
    return found.select(
        F.col("path").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("findings")).alias("spans"))


@query("op4_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p)
    SELECT page_id, bytes AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN bytes >= 1000 AND page_id <> response THEN response END AS refers_to
    FROM g""")
def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(spark, pages(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.packed(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op6_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(pages(spark, folder)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_token_files")
def token_id_files(spark: SparkSession, folder: str) -> DataFrame:
    read = token_files.token_files(spark, documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_class_lm")
def class_lm_query(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.scores(documents(spark, folder))


QUALITY_SQL = """
    WITH d AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM documents),
    tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
    c AS (
      SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
      FROM d LEFT JOIN rep USING (doc_id)),
    v AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS duplicate_lines,
                 1000 * n_repeat_words // greatest(n_words, 1) AS repeated_words, 1000 * word_chars // greatest(n_words, 1) AS word_length FROM c),
    e AS (SELECT lang, source, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS failed, unnest(['symbols', 'duplicate_lines', 'repeated_words', 'word_length']) AS measure,
                 unnest([symbols, duplicate_lines, repeated_words, word_length]) AS exact FROM v),
    s AS (SELECT lang, source, measure, (exact >> greatest(length(format('{:b}', exact)) - 7, 0)) << greatest(length(format('{:b}', exact)) - 7, 0) AS value FROM e
          WHERE NOT failed AND (exact > 0 OR measure IN ('symbols', 'word_length'))),
    lv AS (SELECT 0 AS level, lang, source, measure, value FROM s UNION ALL SELECT 1, lang, NULL, measure, value FROM s
           UNION ALL SELECT 2, NULL, NULL, measure, value FROM s),
    k AS (SELECT *, count(*) OVER (PARTITION BY level, lang, source, measure ORDER BY value) AS upto,
                 count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM lv),
    q AS (SELECT level, lang, source, measure, max(n) AS n, min(CASE WHEN 4 * upto >= n THEN value END) AS q1,
                 min(CASE WHEN 4 * upto >= 2 * n THEN value END) AS q2,
                 min(CASE WHEN 4 * upto >= 3 * n THEN value END) AS q3, CASE measure WHEN 'word_length' THEN 500 WHEN 'repeated_words' THEN 350 ELSE 100 END AS least FROM k GROUP BY ALL),
    t AS (SELECT level, lang, source, measure, n, q3 + greatest(8 * (q3 - q2), least) AS lim,
                 CASE measure WHEN 'word_length' THEN q1 - greatest(8 * (q2 - q1), least) ELSE 0 END AS low FROM q WHERE n >= 100 OR level = 2),
    j AS (SELECT e.*, coalesce(a.lim, b.lim, z.lim, exact) AS lim, coalesce(a.low, b.low, z.low, exact) AS low FROM (
            SELECT doc_id, lang, source, unnest(['symbols', 'duplicate_lines', 'repeated_words', 'word_length']) AS measure,
                   unnest([symbols, duplicate_lines, repeated_words, word_length]) AS exact FROM v) e
          LEFT JOIN t a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM e.lang AND a.source IS NOT DISTINCT FROM e.source AND a.measure = e.measure
          LEFT JOIN t b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM e.lang AND b.measure = e.measure
          LEFT JOIN t z ON z.level = 2 AND z.measure = e.measure),
    ok AS (SELECT doc_id, bool_and(exact <= lim AND exact >= low) AS passes FROM j GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND passes AS kept
    FROM c JOIN ok USING (doc_id)"""


@query("op9_quality_rules", QUALITY_SQL)
def quality_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents""")
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


@query("op11_filter_audit", """
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
      FROM documents),
    k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
      FROM d LEFT JOIN k USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT a.f || b.f || x.f || y.f || z.f AS filter_order FROM l a, l b, l x, l y, l z
          WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31),
    s AS (SELECT filter_order, step, f, bit,
                 (SELECT coalesce(sum(e.bit), 0) FROM l e WHERE strpos(filter_order, e.f) < step) AS before
          FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o) JOIN l ON f = substr(filter_order, step, 1)),
    p AS (SELECT DISTINCT before, bit FROM s),
    g AS (
      SELECT part, before, bit, sum(CASE WHEN mask & CAST(before + bit AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & CAST(before AS BIGINT) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & CAST(before AS BIGINT) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & CAST(before AS BIGINT) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & CAST(before AS BIGINT) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, p GROUP BY part, before, bit),
    r AS (SELECT part, filter_order, step, f, g.* EXCLUDE (part, before, bit) FROM s JOIN g USING (before, bit))
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM r""")
def filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audited(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op12_ranked_search", """
    WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
               FROM documents),
    i AS (SELECT DISTINCT item_id, coalesce(text, '') AS t FROM benchmark),
    q AS (SELECT item_id, t, term, count(*) AS c
          FROM (SELECT item_id, t, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM i)
          GROUP BY ALL),
    n AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
    a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM n),
    f AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY row, term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
    g AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))) AS gain
          FROM f JOIN n USING (row) JOIN w USING (term), a),
    s AS (SELECT item_id, t, row, doc_id, CAST(sum(c * gain) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY item_id, t, row, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id, t ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""")
def ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    found = ranked_search.ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


@query("op13_vector_links")
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    importable(spark)
    return vector_links.vector_links(spark.read.parquet(f"{folder}/embeddings.parquet"))
