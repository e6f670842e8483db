"""Registered queries of this package, one per operator, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.llm import (
    centroid_clustering,
    chat_format,
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    license_scan,
    line_dedup,
    packing,
    sharding,
    simhash,
    substring_dedup,
    target_resampling,
)

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings."""
    said = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    return chat_format.read_back(chat_format.expand_targets(rows))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "covered")


def op6_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining lines."""
    rows = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "text", "lines_dropped")


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return rows.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.drop("text", "detections")


def op11_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.drop("n_words")


def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(_table(spark, sf_dir, "embeddings")).drop("scans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sampled_splitters,
        op2_prefix_targets,
        op3_best_fit_packing,
        op4_template_decontamination,
        op5_host_suffix_array,
        op6_site_line_dedup,
        op7_simhash_anchors,
        op8_cross_parsing,
        op9_tree_merge,
        op10_license_scan,
        op11_level_doubling,
        op12_segment_resampling,
        op13_ns_bounds,
    )
}

_OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), parts AS (
  SELECT *,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|im_start|>' || role || chr(10) || regexp_replace(text,
      '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10)) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sums AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM parts
)
SELECT conv_id, max(n)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM sums GROUP BY conv_id
"""

_OP6 = r"""
WITH pages AS (
  SELECT doc_id, source, coalesce(source, '') AS host, text, coalesce(text, '') AS body FROM documents
), totals AS (
  SELECT host, count(DISTINCT body) AS total FROM pages GROUP BY host
), lines AS (
  SELECT DISTINCT host, body, trim(unnest(string_split(body, chr(10))), ' ') AS line FROM pages
), dropped AS (
  SELECT host, list(line) AS lines FROM (
    SELECT host, line FROM lines JOIN totals USING (host) WHERE line <> ''
    GROUP BY host, line, total HAVING count(*) >= 3 AND count(*) / total > 0.05
  ) GROUP BY host
), cut AS (
  SELECT doc_id, source, text, coalesce(lines, []) AS bad, string_split(text, chr(10)) AS have
  FROM pages LEFT JOIN dropped USING (host)
)
SELECT doc_id, source,
  array_to_string(list_filter(have, lambda x: NOT list_contains(bad, trim(x, ' '))), chr(10)) AS text,
  coalesce(len(list_filter(have, lambda x: list_contains(bad, trim(x, ' ')))), 0)::BIGINT AS lines_dropped
FROM cut
"""

_OP9 = r"""
WITH digests AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM digests WINDOW w AS (PARTITION BY body)
"""

_OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS body
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
), firsts AS (
  SELECT body, min(doc_id) AS least FROM starts GROUP BY body
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM starts JOIN firsts USING (body) WHERE least < doc_id
), tokens AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body FROM tokens ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

_OP12 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
    ORDER BY b) AS tab FROM range(256) t(b)
), words AS (
  SELECT 'd' AS side, r, unnest(w) AS word FROM (SELECT row_number() OVER () AS r, WORDS AS w FROM documents)
  UNION ALL SELECT 'b', 0, unnest(WORDS) FROM benchmark
), vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)
), buckets AS (
  SELECT word, xor(4294967295, list_reduce(
    list_transform(range(length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM vocabulary, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM words JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), sums AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN sums USING (r)
), ranked AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  (CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END)::BIGINT AS rank
FROM ranked
""".replace(
    "WORDS",
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')",
)


def _op13() -> str:
    """The rounds one after another: nearest centroids, then floored means."""
    nearest = """near{n} AS (
  SELECT r, vec_id, x, (arg_min(struct_pack(k := k, d := d), (d, k))).k AS k, min(d) AS d FROM (
    SELECT v.*, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM vectors v, centroids{n}) GROUP BY r, vec_id, x
)"""
    means = """centroids{m} AS (
  SELECT k, coalesce(y, c) AS c FROM centroids{n} LEFT JOIN (
    SELECT k, list((s - ((s % z) + z) % z) // z ORDER BY i) AS y FROM (
      SELECT k, i, sum(e)::BIGINT AS s, count(*) AS z
      FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM near{n}) GROUP BY k, i) GROUP BY k) USING (k)
)"""
    rounds = ",\n".join(x for n in range(3) for x in (nearest.format(n=n), means.format(n=n, m=n + 1)))
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM vectors QUALIFY k < 16
),
{rounds},
{nearest.format(n=3)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near3 JOIN centroids3 USING (k)
"""


ORACLES = {
    "op2_prefix_targets": _OP2,
    "op6_site_line_dedup": _OP6,
    "op9_tree_merge": _OP9,
    "op11_level_doubling": _OP11,
    "op12_segment_resampling": _OP12,
    "op13_ns_bounds": _op13(),
}
