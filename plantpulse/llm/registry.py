"""Queries on the supplied tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.llm.anchors import near_duplicates
from plantpulse.llm.digest_array import RULES, judge_urls
from plantpulse.llm.exact import exact_dedup
from plantpulse.llm.html_text import extract_text
from plantpulse.llm.line_runs import line_dedup
from plantpulse.llm.longest_factor import remove_repeats
from plantpulse.llm.pivot_codes import compress
from plantpulse.llm.resampling import resample
from plantpulse.llm.slack_packing import pack_documents
from plantpulse.llm.spaced_seeds import overlaps
from plantpulse.llm.toxicity import toxicity
from plantpulse.llm.warc import fixity_audit, record_leaves, record_text
from plantpulse.llm.whitening import whiten


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"))


PAGES_PER_ARCHIVE = 250


def op5_warc_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as archives, audited against a replica with rotten bytes and cut-off files."""
    pages = table(spark, sf, "pages").select(
        "page_id", "url", "html", F.floor(F.col("page_id") / PAGES_PER_ARCHIVE).cast("long").alias("file")
    )
    date = F.lit("2024-01-01T00:00:00Z")
    whole = pages.withColumn("record", record_text(F.col("url"), F.col("html"), date))
    rotten = F.overlay("record", F.lit("#"), F.char_length("record"))
    damaged = whole.withColumn(
        "record", F.when(F.col("page_id") % 97 == 5, rotten).otherwise(F.col("record"))
    ).filter((F.col("file") % 13 != 4) | (F.col("page_id") % PAGES_PER_ARCHIVE != PAGES_PER_ARCHIVE - 1))
    return fixity_audit(record_leaves(whole, "page_id"), record_leaves(damaged, "page_id"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans",
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


def op9_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op11_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(URL_RULES, RULES)).select("page_id", "judged.*")


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return compress(table(spark, sf, "embeddings")).select(
        "vec_id", "coded.code", "coded.error", "coded.label_error",
        F.sha2("coded.codebooks", 256).alias("codebooks_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Deviations beyond a long, which take some three million rows of these vectors, are null here."""
    return whiten(table(spark, sf, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "white.component", "white.n", F.expr("try_cast(white.deviation AS bigint)").alias("deviation"),
        "white.whitened", "white.explained", "white.identity_error",
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_vector_codes": op12_vector_codes,
    "op13_embedding_whitening": op13_embedding_whitening,
}


def _tree_sql(side: str) -> str:
    """Leaves, three levels of ranges and the root of one side of the audit."""
    levels, below = [], f"{side}0"
    for level, step in ((1, 65536), (2, 16), (3, 16), (4, None)):
        parent = f"node // {step}" if step else "0"
        levels.append(f"""{side}{level} AS (SELECT file, CAST({parent} AS BIGINT) AS node,
  sha256(string_agg(node || ':' || hash, chr(10) ORDER BY node)) AS hash FROM {below} GROUP BY 1, 2)""")
        below = f"{side}{level}"
    return f"""{side}0 AS (SELECT file, CAST(coalesce(sum(strlen(record) + 4) OVER (
  PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node,
  sha256(record) AS hash FROM {side}), """ + ", ".join(levels)


def _codes_sql(parts: int, entries: int, width: int, rounds: int) -> str:
    """K-means on whole-number parts with every distance computed, one CTE a round."""
    gap = " + ".join(f"(p.x[{k}] - b.x[{k}]) * (p.x[{k}] - b.x[{k}])" for k in range(1, width + 1))
    moved = ", ".join(f"CAST(floor(sum(p.x[{k}]) / count(*)) AS BIGINT)" for k in range(1, width + 1))
    text = [f"""WITH v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings WHERE len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * {width} + 1:part * {width} + {width}] AS x FROM v, range({parts}) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN f USING (vec_id))"""]
    for n in range(rounds + 1):
        text.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, p.part, min(({gap}) * {entries} + entry) AS near
  FROM p JOIN b{n} b ON b.part = p.part GROUP BY ALL)""")
        if n < rounds:
            text.append(f"""b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
  SELECT p.part, near % {entries} AS entry, [{moved}] AS x FROM p JOIN a{n} a ON a.vec_id = p.vec_id AND a.part = p.part
  GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)""")
    text.append(f"""e AS (SELECT vec_id, string_agg(format('{{:02x}}', near % {entries}), '' ORDER BY part) AS code,
  CAST(sum(near // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e JOIN v USING (vec_id)""")
    return ",\n".join(text[:-1]) + ",\n" + text[-1]


_CRLF = "chr(13) || chr(10)"

SQL = {
    "op5_warc_fixity": f"""WITH a AS (SELECT page_id, page_id // 250 AS file,
  'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:sha256:'
  || sha256(concat_ws(chr(10), url, coalesce(html, ''))) || '>' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '')
  || {_CRLF} || 'WARC-Date: 2024-01-01T00:00:00Z' || {_CRLF} || 'Content-Type: text/html' || {_CRLF}
  || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF} || coalesce(html, '') AS record FROM pages),
b AS (SELECT page_id, file, CASE WHEN page_id % 97 = 5 THEN record[:-2] || '#' ELSE record END AS record
  FROM a WHERE file % 13 <> 4 OR page_id % 250 <> 249),
{_tree_sql("a")}, {_tree_sql("b")}
SELECT coalesce(a0.file, b0.file) AS file, coalesce(a0.node, b0.node) AS "offset",
  CASE WHEN b0.hash IS NULL THEN 'missing' WHEN a0.hash IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  a0.hash AS expected_hash, b0.hash AS found_hash, a4.hash AS expected_root, b4.hash AS found_root
FROM a0 FULL JOIN b0 ON a0.file = b0.file AND a0.node = b0.node
LEFT JOIN a4 ON a4.file = coalesce(a0.file, b0.file) LEFT JOIN b4 ON b4.file = coalesce(a0.file, b0.file)
WHERE a0.hash IS DISTINCT FROM b0.hash""",
    "op11_url_filters": f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS t
  FROM pages), h AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(t, ''), '^[^/?#]*')")} AS host,
  regexp_extract(coalesce(t, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))})
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  coalesce(arg_max(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id""",
    "op12_vector_codes": _codes_sql(4, 256, 16, 4),
    "op3_line_dedup": f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op4_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
}
