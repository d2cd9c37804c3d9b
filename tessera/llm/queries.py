"""One registered query per corpus operator, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bpe, near_dedup, packing, pii, quality, repair, rules, secrets, token_counts, topk, toxicity, url_filter, whitening,
)
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


@query(
    r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
                   ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s
        FROM worded
    ), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
    ), links AS (
        SELECT a.doc_id AS u, b.doc_id AS v
        FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
             AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
        GROUP BY 1, 2, a.n, b.n
        HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach(u, v) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
    ), least_id AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
    FROM sets JOIN least_id ON u = doc_id
    """
)
def op10_near_dedup(spark, folder):
    """Near-duplicate groups over two-word shingles."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


@query()
def op2_secret_scan(spark, folder):
    """Secrets of every text: fixed patterns and tokens that look random."""
    return secrets.secret_spans(table(spark, folder, "documents"))


@query()
def op4_quality_rules(spark, folder):
    """Counts, fixed limits and outlier verdict of every text."""
    return rules.rule_results(table(spark, folder, "documents"))


@query()
def op7_quality_classifier(spark, folder):
    """Quality score of every text; labels with crc32 mod 5 = 0 are held out."""
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op9_pii(spark, folder):
    """Personal data of every text: fixed patterns and boosted candidates."""
    return pii.pii_spans(table(spark, folder, "documents"))


@query()
def op5_toxicity(spark, folder):
    """Toxicity score of every text; labels with crc32 mod 4 = 2 are held out."""
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op8_bpe(spark, folder):
    """Ids of every text under the word-level vocabulary, and back."""
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    r"""
    WITH v AS (
        SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, q.e AS asked, c.vec_id AS vec_id,
               CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 5
    """
)
def op1_exact_top_k(spark, folder):
    """Five best inner products of every fiftieth vector among all others."""
    rows = table(spark, folder, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vec"))
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def page_captures(spark, folder):
    """Pages with a fetch time in January 2024, derived from the page's number."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, page_id * 7919 % 2678400)")
    return table(spark, folder, "pages").select("page_id", "url", at.cast("timestamp_ntz").alias("fetched_at"))


def _code(text):
    """A number from the first six hex digits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def host_entries(captures):
    """Dated entries for half of the hosts and their parents, derived from the names seen."""
    host = url_filter.host_of(F.col("url"))
    names = captures.select(F.explode(url_filter.domains_of(host)).alias("pattern")).distinct()
    names = names.filter((_code(F.col("pattern")) % 2 == 0) & (F.size(F.split("pattern", r"\.")) > 2))
    code = _code(F.concat("pattern", F.lit("/"), F.col("change").cast("string")))
    changes = names.withColumn("change", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    day = F.make_interval(days=(code % 31).cast("int"))
    since = F.expr("timestamp'2024-01-01 00:00:00'").cast("timestamp_ntz") + day
    category = F.when(F.col("change") % 2 == 0, "adult").otherwise("malware")
    return changes.select("pattern", category.alias("category"), since.alias("since"), (F.floor(code / 31) % 3 < 2).alias("listed"))


@query(
    r"""
    WITH captures AS (
        SELECT row_number() OVER () AS r, page_id, url,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 7919 % 2678400) AS fetched_at,
               nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host
        FROM pages
    ), asked AS (
        SELECT *, unnest([array_to_string(string_split(host, '.')[i:], '.')
                          FOR i IN range(1, greatest(2, len(string_split(host, '.'))))]) AS domain
        FROM captures
    ), names AS (
        SELECT DISTINCT domain AS pattern FROM asked
        WHERE ('0x' || substr(md5(domain), 1, 6))::BIGINT % 2 = 0 AND len(string_split(domain, '.')) > 2
    ), numbered AS (
        SELECT pattern, change, ('0x' || substr(md5(pattern || '/' || change), 1, 6))::BIGINT AS code
        FROM names, range(8) r(change)
    ), moments AS (
        SELECT pattern, CASE WHEN change % 2 = 0 THEN 'adult' ELSE 'malware' END AS category,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(code % 31 AS INTEGER)) AS since,
               bool_or((code // 31) % 3 < 2) AS listed
        FROM numbered GROUP BY 1, 2, 3
    ), spans AS (
        SELECT *, lead(since) OVER (PARTITION BY pattern, category ORDER BY since) AS until FROM moments
    ), met AS (
        SELECT asked.*, s.pattern, s.category
        FROM asked LEFT JOIN spans s ON s.listed AND s.pattern = domain AND s.since <= fetched_at
             AND (s.until IS NULL OR fetched_at < s.until)
    )
    SELECT c.page_id, c.url, c.fetched_at, c.host, count(m.pattern) AS n_active,
           coalesce(string_agg(DISTINCT m.category, ',' ORDER BY m.category), '') AS categories,
           arg_max(m.pattern, length(m.pattern)) AS pattern, count(m.pattern) > 0 AS blocked
    FROM captures c LEFT JOIN met m USING (r)
    GROUP BY c.r, c.page_id, c.url, c.fetched_at, c.host
    """
)
def op3_url_filter(spark, folder):
    """Every page against the host list as it stood when the page was fetched."""
    captures = page_captures(spark, folder)
    return url_filter.filter_captures(captures, host_entries(captures))


@query()
def op6_packing(spark, folder):
    """Length buckets and token-budget batches of all texts."""
    return packing.pack(table(spark, folder, "documents"))


@query()
def op11_token_counts(spark, folder):
    """Bytes and tokens of every text under the byte-level vocabulary."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op12_embedding_whitening(spark, folder):
    """Sixteen whitened components of every vector."""
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


@query()
def op13_conversation_repair(spark, folder):
    """Faults, cheapest repair and repaired text of every damaged conversation."""
    return repair.damage_report(table(spark, folder, "conversations"))
