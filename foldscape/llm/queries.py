"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .divergence import divergence
from .encode import tokenizer_path
from .html_text import extract_text
from .licenses import scan_licenses
from .minhash_dedup import duplicate_classes
from .ngram_join import jaccard_classes
from .packing import pack
from .secrets import scan_secrets
from .simhash import add_links, edit_likeness
from .token_files import read_token_files, write_token_files
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filter import filter_urls, write_rules
from .whitening import fit_whitening, whiten

#: op2's rules: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, write_rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return score_toxicity(docs, fit_toxicity(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_links(edit_likeness(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = fit_whitening(vectors)
    each = whiten(vectors, w).select("vec_id", F.posexplode("whitened").alias("place", "whitened"), F.col("deviation").try_cast("long").alias("deviation"))
    explained = F.get(F.array(*map(F.lit, w.explained)).cast("array<double>"), F.col("place"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(w.identity_error).alias("identity_error"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_decontamination": op7_decontamination,
    "op8_licenses": op8_licenses,
    "op9_simhash": op9_simhash,
    "op10_ngram_join": op10_ngram_join,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
                   END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        raw AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
        terms AS MATERIALIZED (SELECT doc, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM raw),
        chosen AS MATERIALIZED (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        counted AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN chosen c ON c.lang = t.lang AND c.term = t.term GROUP BY ALL),
        filled AS MATERIALIZED (SELECT g.lang, g.source, c.term, coalesce(n, 0)::HUGEINT AS n FROM groups g JOIN chosen c ON c.lang = g.lang
            LEFT JOIN counted x ON x.lang = g.lang AND x.source = g.source AND x.term = c.term),
        shares AS MATERIALIZED (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w))::HUGEINT AS p FROM filled WINDOW w AS (PARTITION BY lang, source)),
        whole AS (SELECT lang, term, sum(n) AS n FROM filled GROUP BY lang, term),
        of_lang AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w))::HUGEINT AS q FROM whole WINDOW w AS (PARTITION BY lang)),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        above AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares s JOIN of_lang l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
        UNION ALL
        SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM above) WHERE rank <= 10
    """,
    "op13_minhash_dedup": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        cut AS (SELECT line, doc_id, w, unnest(range(1, CAST(greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END) AS BIGINT))) AS i FROM d),
        grams AS MATERIALIZED (SELECT DISTINCT line, array_to_string(w[i:i + 4], ' ') AS gram FROM cut),
        sizes AS MATERIALIZED (SELECT line, count(*) AS size FROM grams GROUP BY line),
        shared AS (SELECT a.line AS a, b.line AS b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.line <> b.line GROUP BY a.line, b.line),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.line = a JOIN sizes y ON y.line = b WHERE 100 * common >= 85 * (x.size + y.size - common)),
        reach AS (SELECT line AS a, line AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        classes AS (SELECT r.a AS line, min(x.doc_id) AS component_id FROM reach r JOIN d x ON x.line = r.b GROUP BY r.a)
        SELECT d.doc_id, coalesce(size, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN classes c ON c.line = d.line LEFT JOIN sizes s ON s.line = d.line
    """,
}
