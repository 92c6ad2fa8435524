"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.llm.byte_bpe import encode_documents
from banstream.llm.centroids import cluster_vectors
from banstream.llm.exact_dedup import exact_groups
from banstream.llm.fingerprints import fingerprint_with_edits
from banstream.llm.hard_negatives import hard_negatives
from banstream.llm.language_id import identify
from banstream.llm.mixing import mix_sources
from banstream.llm.near_dedup import near_duplicates
from banstream.llm.passage_dedup import repeated_passages
from banstream.llm.shared import read_table
from banstream.llm.suffix_dedup import repeated_substrings
from banstream.llm.token_counts import count_tokens
from banstream.llm.token_files import stored_tokens
from banstream.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

#: translate() of the same letters as the operators lower-case
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


_PASS = """
p{i} AS (SELECT *, CASE WHEN {free} AND size <= g{j} THEN size ELSE 0 END AS f{i} FROM r{j}),
q{i} AS (SELECT *, sum(f{i}) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS c{i} FROM p{i}),
r{i} AS (SELECT *, g{j} - coalesce(max(CASE WHEN f{i} > 0 AND c{i} <= g{j} THEN c{i} END) OVER (PARTITION BY source), 0) AS g{i},
         x{j} + (f{i} > 0 AND c{i} <= g{j})::INT AS x{i} FROM q{i})"""
_PASSES = ",".join(_PASS.format(i=i, j=i - 1, free=f"x{i - 1} = 0" if i <= 4 else f"certain + x{i - 1} < 2") for i in range(1, 7))

OP1_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sized GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap,
              sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM s2),
z0 AS (SELECT source, size, count(*) * size AS words FROM sized WHERE size > 0 GROUP BY source, size),
z1 AS (SELECT *, 2 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
              sum(words * sqrt(size)) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM z0),
z2 AS (SELECT z1.source, max((target - full_words) / rest) AS level FROM z1 JOIN s3 ON z1.source IS NOT DISTINCT FROM s3.source GROUP BY z1.source),
z3 AS (SELECT z0.source, max(level) AS level, sum(floor(least(2::DOUBLE, level * sqrt(size)))::BIGINT * words) AS certain_words
       FROM z0 JOIN z2 ON z0.source IS NOT DISTINCT FROM z2.source GROUP BY z0.source),
d0 AS (SELECT d.*, s.source_size, s.target, certain_words, CASE WHEN size > 0 THEN least(2::DOUBLE, level * sqrt(size)) ELSE 0 END AS owed,
              (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
       FROM sized d JOIN s3 s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN z3 ON d.source IS NOT DISTINCT FROM z3.source),
d1 AS (SELECT *, floor(owed)::BIGINT AS certain, owed - floor(owed) AS p FROM d0),
d2 AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM d1 WHERE p > 0),
d3 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS words,
              row_number() OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS place FROM d2),
d4 AS (SELECT *, coalesce(max(CASE WHEN words <= target - certain_words THEN place END) OVER (PARTITION BY source), 0) AS cut,
              coalesce(max(CASE WHEN words <= target - certain_words THEN words END) OVER (PARTITION BY source), 0) AS got FROM d3),
r0 AS (SELECT *, target - certain_words - got AS g0, (place <= cut)::INT AS x0 FROM d4 WHERE place > cut - 1000 AND place <= cut + 1000),
{_PASSES},
every AS (SELECT doc_id, size, source_size, target, certain FROM d1 WHERE p = 0
  UNION ALL SELECT doc_id, size, source_size, target, certain + (place <= cut)::INT FROM d4 WHERE place <= cut - 1000 OR place > cut + 1000
  UNION ALL SELECT doc_id, size, source_size, target, certain + x6 FROM r6)
SELECT doc_id, size, source_size, target, (size * certain)::BIGINT AS taken, certain::INT AS copies FROM every
"""


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=2, percent=80)


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS own FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(own) < 2 THEN [array_to_string(own, ' ')] ELSE list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1]) END) AS gram FROM w WHERE len(own) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      WHERE 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


ALLOW_RULES = ("org/", "com/fr/")
BLOCK_RULES = ("example.org/es/", "example.org/en/1", "com/de/")


def op4_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), ALLOW_RULES, BLOCK_RULES)


OP4_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
     r(rule, rule_host, rule_path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
       ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block'))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""


def op5_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(read_table(spark, sf_dir, "documents"))


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op11_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_ROUND = """
a{i} AS MATERIALIZED (SELECT r, min(dist * 8 + c) AS k FROM (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS dist FROM x JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r),
c{j} AS MATERIALIZED (SELECT o.c, o.d, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{i} o LEFT JOIN
  (SELECT k % 8 AS c, d, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY ALL) g ON g.c = o.c AND g.d = o.d)"""

OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(v) AS x FROM v),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c FROM v QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, d, x AS m FROM s JOIN x USING (r)),
{",".join(_ROUND.format(i=i, j=i + 1) for i in range(11))},
h AS (SELECT c, sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c10 GROUP BY c),
o AS (SELECT vec_id, k % 8 AS c, k // 8 AS distance FROM v JOIN a10 USING (r))
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM o JOIN h USING (c)
"""


def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 50 == 0)


OP12_SQL = f"""
WITH t AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS MATERIALIZED (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INT AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def op13_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_substrings(read_table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_packed_ids": op2_packed_ids,
    "op3_signature_join": op3_signature_join,
    "op4_bloom_cascade": op4_bloom_cascade,
    "op5_weighted_samples": op5_weighted_samples,
    "op6_content_sort": op6_content_sort,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_paragraph_bands": op10_paragraph_bands,
    "op11_va_file": op11_va_file,
    "op12_segment_negatives": op12_segment_negatives,
    "op13_linear_grouping": op13_linear_grouping,
}
#: The others are held against brute force in tests/llm.
SQL: dict[str, str] = {"op1_pareto_mix": OP1_SQL, "op3_signature_join": OP3_SQL, "op4_bloom_cascade": OP4_SQL, "op6_content_sort": OP6_SQL, "op11_va_file": OP11_SQL, "op12_segment_negatives": OP12_SQL}
