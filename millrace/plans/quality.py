"""Queries of the data-quality operators and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import profile as P
from millrace.operators import references as R
from millrace.operators import unpack as U
from millrace.session import kept_dir, table


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """The maintained counts of a data directory: a delta for each load that is new or has changed since the last query."""
    return P.ValueCounts(spark, kept_dir(spark, "value-counts", d)).maintain(table(spark, d, "raw"), table(spark, d, "loads"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return P.departures(_counts(spark, d), table(spark, d, "loads"))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.profile(_counts(spark, d))


def p1_drift(spark: SparkSession, d: str) -> DataFrame:
    return P.drift(_counts(spark, d))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The maintained counts of collections, removals and references of a data directory."""
    store = R.ReferenceCounts(spark, kept_dir(spark, "reference-counts", d))
    return store.maintain(table(spark, d, "raw"), table(spark, d, "removals"), table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(table(spark, d, "chunks"), _references(spark, d)).select(F.col("ref_id").alias("chunk_id")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month, from the counts alone."""
    by_month = R.orphan_counts(_references(spark, d)).select(F.lit("chunks").alias("table_name"), F.date_format("at", "yyyy-MM").alias("month"), "reason", "n")
    return by_month.groupBy("table_name", "month", "reason").agg(F.sum("n").alias("n_orphans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return U.unpack(table(spark, d, "golden_sample100"), "qid", "gold_doc_ids", "doc_id")


_P1_ROWS = r"""
WITH span AS (SELECT load_no, min(started_at) AS s, max(finished_at) AS f FROM loads WHERE load_no IS NOT NULL GROUP BY 1),
r AS (SELECT raw.load_no, published_at AS p, collected_at AS c, title AS t, s, f,
        title IS NULL OR regexp_replace(title, '[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g') = '' AS tm
      FROM raw LEFT JOIN span USING (load_no) WHERE raw.load_no IS NOT NULL)"""

_P1_FOUND = (
    _P1_ROWS
    + r""",
g AS (SELECT load_no,
  count(*) FILTER (p IS NULL) / count(*) AS a1, coalesce(count(DISTINCT p) / nullif(count(p), 0), 0) AS a2,
  coalesce(count(*) FILTER (p < TIMESTAMP '2000-01-01' OR p > c) / nullif(count(p), 0), 0) AS a3,
  coalesce(count(*) FILTER (CAST(p AS TIME) = TIME '00:00:00') / nullif(count(p), 0), 0) AS a4,
  coalesce(count(*) FILTER (p < c - INTERVAL 30 DAY) / nullif(count(*) FILTER (p IS NOT NULL AND c IS NOT NULL), 0), 0) AS a5,
  count(*) FILTER (c IS NULL) / count(*) AS b1, coalesce(count(DISTINCT c) / nullif(count(c), 0), 0) AS b2,
  coalesce(count(*) FILTER (c < s OR c > f) / nullif(count(c), 0), 0) AS b3,
  coalesce(count(*) FILTER (date_trunc('hour', c) = c) / nullif(count(c), 0), 0) AS b4,
  count(*) FILTER (tm) / count(*) AS c1, coalesce(count(DISTINCT t) FILTER (NOT tm) / nullif(count(*) FILTER (NOT tm), 0), 0) AS c2,
  coalesce(count(*) FILTER (NOT tm AND (length(t) < 8 OR length(t) > 90)) / nullif(count(*) FILTER (NOT tm), 0), 0) AS c3,
  coalesce(count(*) FILTER (NOT tm AND regexp_matches(t, '[^가-힣A-Za-z0-9 .,:%()\[\]/+\-''"?!·…]')) / nullif(count(*) FILTER (NOT tm), 0), 0) AS c4
  FROM r GROUP BY 1),
a AS (SELECT span.load_no, a1, a2, a3, a4, a5, b1, b2, b3, b4, c1, c2, c3, c4 FROM span LEFT JOIN g USING (load_no)),
l AS (
"""
    + " UNION ALL ".join(
        f"SELECT load_no, '{c}' AS col_name, '{k}' AS check_name, coalesce({a}, 0.0) AS share FROM a"
        for a, c, k in (
            ("a1", "published_at", "missing"), ("a2", "published_at", "distinct"), ("a3", "published_at", "out_of_range"), ("a4", "published_at", "midnight"), ("a5", "published_at", "stale"),
            ("b1", "collected_at", "missing"), ("b2", "collected_at", "distinct"), ("b3", "collected_at", "out_of_range"), ("b4", "collected_at", "on_hour"),
            ("c1", "title", "missing"), ("c2", "title", "distinct"), ("c3", "title", "length"), ("c4", "title", "charset"),
        )
    )
    + """),
m AS (SELECT col_name, check_name, median(share) AS middle FROM l GROUP BY 1, 2)
SELECT load_no, col_name, check_name FROM l JOIN m USING (col_name, check_name) WHERE round(abs(share - middle), 6) > 0.2"""
)

_P1_PROFILE = (
    _P1_ROWS
    + """,
v AS (SELECT load_no, 'published_at' AS col_name, strftime(p, '%Y-%m-%d %H:%M:%S.%f') AS value, p IS NULL AS missing FROM r
  UNION ALL SELECT load_no, 'collected_at', strftime(c, '%Y-%m-%d %H:%M:%S.%f'), c IS NULL FROM r
  UNION ALL SELECT load_no, 'title', t, tm FROM r),
k AS (SELECT load_no, col_name, value, missing, count(*) AS n FROM v GROUP BY ALL)
SELECT load_no, col_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (missing), 0) AS BIGINT) AS n_missing,
  count(*) FILTER (NOT missing) AS n_distinct, CAST(coalesce(sum(n) FILTER (NOT missing), 0) AS BIGINT) AS n_values,
  min(value) FILTER (NOT missing) AS min_value, max(value) FILTER (NOT missing) AS max_value,
  round(greatest(coalesce(log2(sum(n) FILTER (NOT missing)) - sum(n * log2(n)) FILTER (NOT missing) / sum(n) FILTER (NOT missing), 0.0), 0.0), 6) AS entropy_bits
FROM k GROUP BY 1, 2"""
)

_P5_ROWS = """
WITH i AS (SELECT upper(trim(doc_id)) AS k, count(*) AS n, max(collected_at) AS last_in, min(collected_at) AS first_in, bool_or(collected_at IS NULL) AS always
           FROM raw WHERE trim(doc_id) <> '' GROUP BY 1),
o AS (SELECT upper(trim(doc_id)) AS k, max(removed_at) AS last_out FROM removals WHERE trim(doc_id) <> '' GROUP BY 1),
f AS (SELECT chunk_id, indexed_at, CASE WHEN i.k IS NULL THEN 'missing'
        WHEN o.k IS NOT NULL AND NOT coalesce(last_in > last_out, last_in IS NOT NULL AND last_out IS NULL) THEN 'removed'
        WHEN NOT always AND first_in > indexed_at THEN 'later' END AS reason
      FROM chunks LEFT JOIN i ON i.k = upper(trim(doc_id)) LEFT JOIN o ON o.k = upper(trim(doc_id)) WHERE trim(doc_id) <> '')"""

QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_drift": p1_drift, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found}
SQL = {
    "p1_found": _P1_FOUND,
    "p1_profile": _P1_PROFILE,
    "p5_found": _P5_ROWS + "SELECT DISTINCT chunk_id FROM f WHERE reason IS NOT NULL",
    "p5_report": _P5_ROWS + """, u AS (SELECT DISTINCT strftime(indexed_at, '%Y-%m') AS month, reason, chunk_id FROM f WHERE reason IS NOT NULL)
SELECT 'chunks' AS table_name, month, reason, count(*) AS n_orphans FROM u GROUP BY ALL""",
}
