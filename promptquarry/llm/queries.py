"""The check queries of this subpackage: thin wrappers of its operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, hard_negatives, language_id, lm_scoring, mixing, near_dedup, ngram_join, periodic_runs, secrets, substring_dedup, token_counts, warc
from .common import table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and the text that is left; where a cut falls inside a character, its rest shows as U+FFFD."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(language_id.document_evidence(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))
    return found.select("doc_id", F.col("lang").alias("declared"), F.col("__language").alias("language"), F.round("__posterior", 6).alias("posterior"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(language_id.page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("page_id", F.col("__language").alias("language"), F.round("__posterior", 6).alias("posterior"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_tokens(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.hard_negatives(rows)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = periodic_runs.with_planted_runs(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return periodic_runs.digest_columns(periodic_runs.periodic_runs(docs, changed))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_near_dedup, op3_decontamination, op4_language_id, op5_warc, op6_token_counts, op7_mixing, op8_lm_scoring, op9_secret_scan, op10_exact_dedup, op11_hard_negatives, op12_ngram_join, op13_periodic_runs, language_id_pages, pipeline)}


WS = r"[\x20\x09-\x0D]"

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix-1'), 1, 15) AS BIGINT) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ssize, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * ssize AS cap,
         (1.5::DOUBLE * sum(ssize) OVER () - coalesce(sum(2.0::DOUBLE * ssize) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * ssize / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(level, cap / w) AS level FROM r WHERE w * level <= cap
), t AS (
  SELECT source, ssize, least(cap, w * l.level) AS target, CASE WHEN ssize > 0 THEN floor(floor(least(cap, w * l.level)) / ssize) ELSE 0 END AS e
  FROM r, l
), p AS (
  SELECT d.*, t.ssize, t.target, t.e, floor(t.target) - t.e * t.ssize AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, ssize AS source_size, target,
       CAST(e * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM p
"""


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM k
"""


def _words(width: int) -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, CASE WHEN len(w) >= {width} THEN array_to_string(w[i:i + {width - 1}], ' ') ELSE array_to_string(w, ' ') END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM w WHERE len(w) > 0) x
)"""

_LINKED = r""", s AS (SELECT DISTINCT doc_id, sh FROM places
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= $percent * (x.n + y.n - k)
), r AS (SELECT DISTINCT u AS doc_id, u AS node FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.node = e.u
), m AS (SELECT doc_id, min(node) AS lowest FROM r GROUP BY 1)"""

OP2_SQL = _words(5) + _LINKED.replace("$percent", "85") + r"""
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.lowest, d.doc_id) AS component_id, coalesce(m.lowest, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP12_SQL = _words(3) + _LINKED.replace("$percent", "90") + r"""
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.lowest, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP3_SQL = _words(5) + r""", iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ish AS (SELECT item_id, sh, count(*) AS k FROM (SELECT item_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5) x) y GROUP BY 1, 2
), size AS (SELECT item_id, sum(k) AS m FROM ish GROUP BY 1
), len AS (SELECT doc_id, count(*) AS d FROM places GROUP BY 1
), met AS (SELECT DISTINCT p.doc_id, i.item_id FROM places p JOIN ish i USING (sh)
), win AS (SELECT doc_id, item_id, m, d, unnest(range(1, greatest(d - m, 0)::BIGINT + 2)) AS s FROM met JOIN size USING (item_id) JOIN len USING (doc_id)
), grouped AS (SELECT w.doc_id, w.item_id, s, any_value(least(m, d)) AS own, any_value(m) AS m, p.sh, count(*) AS k FROM win w JOIN places p ON p.doc_id = w.doc_id AND p.i >= s AND p.i < s + m GROUP BY w.doc_id, w.item_id, s, p.sh
), sim AS (SELECT b.doc_id, b.item_id, s, sum(least(b.k, i.k)) / (any_value(own) + any_value(m) - sum(least(b.k, i.k)))::DOUBLE AS similarity FROM grouped b JOIN ish i ON i.item_id = b.item_id AND i.sh = b.sh GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(arg_min(s, (-similarity, s)) - 1 AS BIGINT) AS start_word, max(similarity) AS similarity FROM sim GROUP BY 1, 2 HAVING max(similarity) >= 0.8
"""


def _found(pattern: str) -> str:
    """DuckDB: the matches of a pattern in t with their places, from the pieces between them."""
    p = pattern.replace("'", "''")
    gaps, values = f"string_split_regex(t, '{p}')", f"regexp_extract_all(t, '{p}')"
    start = f"CAST(coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform({values}[1:i - 1], lambda g: length(g))), 0) AS BIGINT)"
    return f"CASE WHEN regexp_matches(t, '{p}') THEN list_transform({values}, lambda v, i: {{'s': {start}, 'v': v}}) ELSE [] END"


def _op9_sql() -> str:
    entropy = "log2(20.0) - list_min(list_transform(range(1, length(v) - 18), lambda j: list_sum(list_transform(list_distinct(string_split(substr(v, j, 20), '')), lambda c: (20 - length(replace(substr(v, j, 20), c, ''))) * log2(20 - length(replace(substr(v, j, 20), c, ''))))))) / 20"
    least = secrets.THRESHOLDS
    limit = f"CASE WHEN regexp_matches(v, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN {least['hex']} WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN {least['alnum']} ELSE {least['base64']} END"
    allowed = " OR ".join(f"regexp_matches(v, '{a}')" for a in secrets.ALLOWED)
    group = secrets.ASSIGN.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), f AS (
  SELECT doc_id, 'assign' AS kind, 0 AS r, unnest({_found(secrets.ASSIGN)}) AS m FROM d
  UNION ALL SELECT doc_id, 'access', 1, unnest({_found(secrets.ACCESS)}) FROM d
  UNION ALL SELECT doc_id, 'hex', 2, unnest({_found(secrets.HEX)}) FROM d
  UNION ALL SELECT doc_id, 'entropy', 3, unnest({_found(secrets.CANDIDATE)}) FROM d
), g AS (SELECT doc_id, kind, r, m.s AS s, m.v AS v FROM f
), h AS (
  SELECT doc_id, kind, r, s, kind || ':' || s || ':' || (s + length(v)) AS x FROM g
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(v, '{group}', 1)) >= {secrets.LEAST_VALUE} WHEN 'entropy' THEN NOT ({allowed}) AND round({entropy}, 9) >= {limit} ELSE true END
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, r) FILTER (r < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, r), '') AS spans, count(*) FILTER (kind = 'entropy') AS n_entropy
FROM d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op9_secret_scan": _op9_sql(), "op10_exact_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_ngram_join": OP12_SQL, "op7_mixing": OP7_SQL, "op5_warc": OP5_SQL}
