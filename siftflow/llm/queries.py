"""One query per operator: the operator over its whole table, with the columns that its contract asks for; and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftflow.llm import bpe, decontamination, exact_dedup, license_scan, line_dedup, quality, simhash, substring_dedup, suffix_dedup, url_filter
from siftflow.llm.common import table


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.classify(docs, quality_model(spark, docs, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_exact(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_line_dedup, op3_substring_dedup, op4_bpe_encode_decode, op5_url_filter, op6_decontamination, op7_exact_dedup, op8_license_scan, op9_simhash_dedup, op10_suffix_dedup)
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, array_to_string(l[i + 1 : i + 3], chr(10)) AS w FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS i FROM l)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r),
line AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM l),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS k FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l.l), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_substring_dedup": r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(l[i + 1 : i + 35], ' ')) AS w FROM (SELECT doc_id, l, unnest(range(len(l) - 34)) AS i FROM l WHERE len(l) >= 35)),
again AS (SELECT w FROM w GROUP BY w HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w SEMI JOIN again USING (w)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
word AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM l),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS k FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)""",
    "op5_url_filter": """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM pages),
f AS (SELECT u.n, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict FROM u JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(spam|casino)([.-]|$)') OR regexp_matches(host, '(^|[.])(cheap|online|best)-pills([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f USING (n)""",
    "op6_decontamination": rf"""
WITH l AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS l FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({FOLDED}, '{WORD}') AS l FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(l[i + 1 : i + n], ' ') AS p FROM (SELECT item, l, least(len(l), 10) AS n, unnest(range(len(l) - least(len(l), 10) + 1)) AS i FROM b WHERE len(l) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(l[i + 1 : i + n], ' ') AS p FROM (SELECT doc_id, l, n, unnest(range(len(l) - n + 1)) AS i FROM l, (SELECT DISTINCT n FROM bw) WHERE len(l) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, p)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM l LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256 FROM d""",
}
