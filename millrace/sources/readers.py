"""Readers: mapped tables, SQL and JDBC sources, delimited files, workbooks, catalogs."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from millrace.functions.keys import type_aliases

#: Standard column -> physical column; None leaves a column out, names not listed are kept as they are.
RAW_COLUMNS = {c: c for c in ("raw_no", "doc_id", "doc_type", "title", "body", "published_at", "collected_at", "org_name", "author", "security_level", "src_url", "file_path", "load_no")}
CHUNK_COLUMNS = {c: c for c in ("chunk_id", "doc_id", "seq", "text", "indexed_at")}


def select_mapped(df: DataFrame, columns: dict[str, str | None], where: str | None = None, n: int | None = None, sample_pct: float | None = None) -> DataFrame:
    """Projection with renaming, then filter, sample and limit; the filter names physical columns."""
    if where:
        df = df.where(where)
    if sample_pct:
        df = df.sample(fraction=sample_pct / 100, seed=7)
    out = df.select(*(F.col(physical).alias(name) for name, physical in columns.items() if physical))
    return out.limit(n) if n else out


def standard_types(df: DataFrame, source_types: DataFrame) -> DataFrame:
    """``doc_type_raw`` keeps the stored type, ``doc_type`` its code (unknown ones pass unchanged); date columns become timestamps, null where they are none."""
    names = type_aliases(source_types).select(F.col("alias").alias("__alias"), F.col("doc_type").alias("__code"))
    if "doc_type" in df.columns:
        df = df.withColumn("doc_type_raw", F.col("doc_type")).withColumn("__alias", F.upper(F.trim("doc_type")))
        df = df.join(F.broadcast(names), "__alias", "left").withColumn("doc_type", F.coalesce("__code", "doc_type_raw")).drop("__alias", "__code")
    for name, kind in df.dtypes:
        if kind == "string" and name.endswith(("_at", "_dt", "_date")):
            df = df.withColumn(name, F.try_to_timestamp(name))
    return df


def load_chunks(chunks: DataFrame, doc_ids: DataFrame | None = None, **select) -> DataFrame:
    """Mapped chunks, only those of ``doc_ids`` (a semi join) where given."""
    out = select_mapped(chunks, CHUNK_COLUMNS, **select)
    return out if doc_ids is None else out.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def read_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Any SELECT over the session's views, with parameters; column names in lower case."""
    df = spark.sql(sql, args=args or {})
    return df.toDF(*(c.lower() for c in df.columns))


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A query of a relational database. ``partition`` (column, low, high, parts) reads it in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").option("fetchsize", 10_000).options(**options)
    if partition:
        for name, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(name, value)
    df = reader.load()
    return df.toDF(*(c.lower() for c in df.columns))


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A delimited file or a workbook; delimited files that are not UTF-8 are read as CP949. Nulls become empty strings for text columns."""
    if path.endswith((".xlsx", ".xls")):
        pdf = pd.read_excel(path, **options).dropna(how="all")
        return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    encoding = options.pop("encoding", None) or _encoding(spark, path)
    if encoding.lower() not in ("utf-8", "utf-16", "us-ascii", "iso-8859-1"):
        return _decoded(spark, path, encoding, options.get("sep", ","), schema)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).options(**options)
    df = reader.csv(path, schema=schema) if schema else reader.csv(path)
    first = df.columns[0]
    return (df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df).na.fill("")


def _encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 where every line of the files is, else CP949; the lines are checked where they lie."""
    return "cp949" if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def _decoded(spark: SparkSession, path: str, encoding: str, sep: str, schema: str | None) -> DataFrame:
    """Delimited files in an encoding that the engine's reader lacks: each is parsed on an executor, a block of lines at a time.

    The files share one header; it alone comes to the driver.
    """
    head = bytes(spark.read.text(path).select(F.col("value").cast("binary").alias("v")).first().v).decode(encoding)
    names = next(csv.reader([head.lstrip("\ufeff")], delimiter=sep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for part in pd.read_csv(io.BytesIO(bytes(content)), encoding=encoding, dtype=str, keep_default_na=False, sep=sep, chunksize=20_000):
                    yield part.set_axis(names, axis=1)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    return text.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema))) if schema else text


def read_any(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A table by format: parquet, orc, json, avro, csv or a catalog table name."""
    kind = kind or path.rsplit(".", 1)[-1]
    if kind in ("csv", "tsv", "xlsx", "xls"):
        return read_table(spark, path, schema, **({"sep": "\t"} if kind == "tsv" else {}))
    if kind in ("parquet", "orc", "json", "avro", "text"):
        reader = spark.read.format(kind)
        return (reader.schema(schema) if schema else reader).load(path)
    try:
        return spark.table(path)
    except AnalysisException as missing:
        raise ValueError(f"no reader for {path!r}") from missing


def index_check(chunks: DataFrame, index: DataFrame, needed: tuple[str, ...] = ("chunk_id", "doc_id", "text")) -> DataFrame:
    """One row: rows of the chunk table, rows of the index, their ratio and the needed fields the index lacks."""
    missing = ";".join(c for c in needed if c not in index.columns)
    sides = chunks.agg(F.count(F.lit(1)).alias("n")).select(F.lit("c").alias("side"), "n").unionByName(index.agg(F.count(F.lit(1)).alias("n")).select(F.lit("i").alias("side"), "n"))
    counts = sides.agg(F.sum(F.when(F.col("side") == "c", F.col("n"))).alias("n_chunks"), F.sum(F.when(F.col("side") == "i", F.col("n"))).alias("n_index"))
    return counts.select("n_chunks", "n_index", F.round(F.try_divide("n_index", "n_chunks"), 4).alias("ratio"), F.lit(missing).alias("missing_fields"))
