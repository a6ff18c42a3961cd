"""Queries of the operators on training text and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, canonical, email, packing, repeated_lines, truncation
from millrace.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_cases(table(spark, d, "raw"), table(spark, d, "source_types"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated(table(spark, d, "raw"), table(spark, d, "source_types"))


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_by_line(table(spark, d, "raw"), table(spark, d, "source_types"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "chunks"), table(spark, d, "raw"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "chunks"), table(spark, d, "raw"), table(spark, d, "source_types"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return email.not_new_lines(table(spark, d, "raw"), table(spark, d, "source_types"))


def p4_new_text(spark: SparkSession, d: str) -> DataFrame:
    return email.newly_written(table(spark, d, "raw"), table(spark, d, "source_types"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """How many lines each dictionary shows, and how many only the frame."""
    return email.line_paths(table(spark, d, "raw"), table(spark, d, "source_types")).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = bpe.decode(bpe.encode(docs), text_col="back")
    pairs = docs.select("doc_id", "source", "text").join(back, "doc_id")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~same).alias("n_changed"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(bpe.count_tokens(table(spark, d, "documents")), "pack-sizes")
    return sizes, packing.pack(sizes)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[1]


def p8_certificate(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificate(*_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, d, "documents")).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.variant_classes(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical(table(spark, d, "documents"))


_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_P2_ROWS = rf"""
WITH alias AS (SELECT a, min(code) AS code FROM (SELECT code, upper(trim(unnest(list_prepend(code, string_split(coalesce(aliases, ''), ';'))))) AS a FROM source_types) WHERE a <> '' GROUP BY 1),
b AS (SELECT raw_no, code, upper(trim(doc_id)) AS k, string_split(body, chr(10)) AS ls, CAST(published_at AS DATE) AS pub FROM raw JOIN alias ON a = upper(trim(doc_type)) WHERE code <> 'EMAIL'),
x AS (SELECT raw_no, code, k, pub, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM b),
n AS (SELECT *, regexp_replace(lower(regexp_replace(line, '{_SPACE}', '', 'g')), '[0-9]+', '0', 'g') AS form FROM x),
f AS (SELECT * FROM n WHERE form <> '' AND form NOT LIKE '|%'),
t AS (SELECT code, count(DISTINCT k) AS docs FROM b WHERE k IS NOT NULL GROUP BY 1),
o AS (SELECT code, form FROM f JOIN t USING (code) WHERE k IS NOT NULL GROUP BY code, form, docs HAVING count(DISTINCT k) >= 5 AND count(DISTINCT k) >= 0.02 * docs)"""

QUERIES = {
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p2_lines": p2_lines,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_new_text": p4_new_text,
    "p4_paths": p4_paths,
    "p7_ids": p7_ids,
    "p7_roundtrip": p7_roundtrip,
    "p8_containers": p8_containers,
    "p8_certificate": p8_certificate,
    "p9_found": p9_found,
    "p9_canonical": p9_canonical,
    "p9_classes": p9_classes,
}
SQL = {
    "p2_found": _P2_ROWS + "SELECT raw_no, CAST(line_no AS INTEGER) AS line_no FROM f SEMI JOIN o USING (code, form)",
    "p2_clean": _P2_ROWS
    + """, c AS (SELECT raw_no, string_agg(line, chr(10) ORDER BY line_no) AS body FROM n ANTI JOIN (SELECT * FROM o) o USING (code, form) GROUP BY 1)
SELECT b.raw_no, CASE WHEN ls IS NOT NULL THEN coalesce(body, '') END AS body FROM b LEFT JOIN c USING (raw_no)""",
    "p2_lines": _P2_ROWS
    + """, g AS (SELECT code, form, count(DISTINCT k) FILTER (k IS NOT NULL) AS n_docs, count(DISTINCT pub) FILTER (k IS NOT NULL) AS n_dates, min((raw_no, line_no)) AS place FROM f SEMI JOIN o USING (code, form) GROUP BY 1, 2)
SELECT code AS type_code, place[1] AS raw_no, CAST(place[2] AS INTEGER) AS line_no, n_docs, n_dates FROM g WHERE n_dates > 0""",
    "p7_roundtrip": "SELECT source, count(*) AS n_docs, CAST(0 AS BIGINT) AS n_changed FROM documents GROUP BY 1",
}
