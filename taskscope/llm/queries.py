"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, divergence, duplicates, near_duplicates, neighbours, pieces, quality, secrets, shards, substrings, toxicity, urls


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(_docs(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.report(_docs(spark, folder))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(_docs(spark, folder), _labels(spark, folder))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_docs(spark, folder))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.places(_docs(spark, folder))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(_docs(spark, folder), _labels(spark, folder))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.report(_docs(spark, folder))


def _pieces_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(_docs(spark, folder), _pieces_model())


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.removal_report(_docs(spark, folder))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.verdicts(spark.read.parquet(f"{folder}/pages.parquet"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.report(_docs(spark, folder))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.report(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.report(_docs(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), _pieces_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_near_dedup, op3_quality_classifier, op4_secret_scan, op5_sharding, op6_toxicity, op7_exact_dedup, op8_sentencepiece,
        op9_substring_dedup, op10_url_filters, op11_source_divergence, op12_nearest_neighbours, op13_tokenizer_alignment,
    )
}

def _sql_host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _sql_key(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN contains({url}, '://') THEN {_sql_host(url)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


def _sql_rule(host: str, path: str) -> str:
    """The longest of the four rules that fits, as host/path."""
    rules = [("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"), ("net", "/")]
    fits = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h}{p}'" for h, p in rules]
    return f"CASE {' '.join(fits)} END"


_OWN = "CASE WHEN {r} IN ('net/', 'example.com/de/') THEN 'block' WHEN {r} IS NOT NULL THEN 'allow' END"


def _sql_attribute(name: str) -> str:
    """The value of a tag's attribute, in double, single or no quotes."""
    forms = [f"""[\\s"''/]{name}\\s*=\\s*"([^"]*)\"""", f"""[\\s"''/]{name}\\s*=\\s*''([^'']*)''""", f"""[\\s"''/]{name}\\s*=\\s*([^\\s>"'']+)"""]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(tag, '(?is){f}', 1), '')" for f in forms) + ", '')"


SQL: dict[str, str] = {
    "op11_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM d),
        counted AS (SELECT lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
        kept AS (SELECT lang, t, sum(n) AS n FROM counted GROUP BY lang, t HAVING sum(docs) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        totals AS (SELECT lang, source, coalesce(sum(n) FILTER (t IN (SELECT k.t FROM kept k WHERE k.lang = g.lang)), 0) AS total FROM groups g LEFT JOIN counted USING (lang, source) GROUP BY lang, source),
        shares AS (
            SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
              1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (l.total + 2 * l.v) AS q
            FROM totals g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
        ), found AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN found f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ), every AS (
            SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', t, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op7_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), classes AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM rows JOIN classes USING (t)
    """,
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
        starts AS (SELECT r, l, unnest(range(1, len(l) - 33)) AS i FROM d),
        windows AS (SELECT r, i, md5(array_to_string(l[i:i + 34], ' ')) AS k FROM starts),
        repeated AS (SELECT r, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM repeated),
        words AS (SELECT r, unnest(l) AS w, generate_subscripts(l, 1) AS j FROM d),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
        SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op10_url_filters": f"""
        WITH RECURSIVE read AS (
            SELECT url, regexp_replace(html, '(?is)<!--.*?(-->|$)|<script\\b.*?(</script\\s*>|$)|<style\\b.*?(</style\\s*>|$)|<textarea\\b.*?(</textarea\\s*>|$)', ' ', 'g') AS html FROM pages WHERE contains(url, '://')
        ), tags AS (
            SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)[\\s/](?:(?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^>]*>)')) AS tag FROM read
        ), found AS (
            SELECT url, CASE
              WHEN lower(tag[2:5]) = 'link' AND list_contains(regexp_split_to_array(lower({_sql_attribute('rel')}), '\\s+'), 'canonical') THEN trim({_sql_attribute('href')})
              WHEN lower(tag[2:5]) = 'meta' AND trim(lower({_sql_attribute('http-equiv')})) = 'refresh' THEN regexp_extract({_sql_attribute('content')}, '(?is)\\burl\\s*=\\s*[''"]?([^"''>\\s]+)', 1) END AS t FROM tags
        ), targets AS (
            SELECT url, replace(t, '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS base, {_sql_path('url')} AS p FROM found WHERE t <> ''
        ), whole AS (
            SELECT url, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN base || t
              WHEN t LIKE '#%' THEN url WHEN t LIKE '?%' THEN base || p || t
              ELSE base || CASE WHEN regexp_replace(p, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(p, '[^/]*$', '') END || t END AS w FROM targets
        ), links AS (SELECT {_sql_key('url')} AS u, {_sql_key('w')} AS v FROM whole),
        sym AS (SELECT u, v FROM links WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM links WHERE u IS NOT NULL AND v IS NOT NULL),
        reach AS (SELECT u AS n, u AS m FROM sym UNION SELECT reach.n, sym.v FROM reach JOIN sym ON reach.m = sym.u),
        told AS (SELECT n, {_sql_rule(_sql_host("('x://' || m)"), _sql_path("('x://' || m)"))} AS r FROM reach),
        shared AS (SELECT n, CASE WHEN bool_or({_OWN.format(r='r')} = 'allow') THEN 'allow' WHEN bool_or({_OWN.format(r='r')} = 'block') THEN 'block' END AS s FROM told GROUP BY n),
        parts AS (SELECT page_id, {_sql_host('url')} AS host, {_sql_path('url')} AS path, {_sql_key('url')} AS k FROM pages),
        ruled AS (SELECT *, {_sql_rule('host', 'path')} AS rule FROM parts)
        SELECT page_id, host, path, rule, coalesce({_OWN.format(r='rule')}, s, 'allow') AS verdict FROM ruled LEFT JOIN shared ON n = k
    """,
}
