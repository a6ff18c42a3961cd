"""Chunkers: paragraphs packed up to a target size, and pieces of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.sources.registry import SOURCES


def pack_paragraphs(text: Column, size: Column, split_table: Column, separator: str = "\n\n") -> Column:
    """The chunks of a text: paragraphs are joined while their lengths, separators not counted, fit in ``size``.

    Where ``split_table`` holds, a paragraph that begins with a bar is a chunk of its own. Blank chunks are dropped.
    One fold over the paragraphs inside the engine: state is the finished chunks and the one being filled.
    """
    paragraphs = F.split(F.coalesce(text, F.lit("")), separator)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    closed = lambda s: F.when(strip(s.buf) != "", F.concat(s.done, F.array(strip(s.buf)))).otherwise(s.done)

    def step(s, p):
        is_table = split_table & F.ltrim(p).startswith("|")
        full = (F.length(s.buf) + F.length(p) > size) & (strip(s.buf) != "")
        table = F.struct(F.concat(closed(s), F.array(strip(p))).alias("done"), F.lit("").alias("buf"))
        flushed = F.struct(closed(s).alias("done"), p.alias("buf"))
        longer = F.struct(s.done.alias("done"), F.when(s.buf != "", F.concat(s.buf, F.lit(separator), p)).otherwise(p).alias("buf"))
        return F.when(is_table, table).when(full, flushed).otherwise(longer)

    return F.filter(F.aggregate(paragraphs, start, step, closed), lambda x: x != "")


def chunk_documents(typed: DataFrame, separator: str = "\n\n", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(ids, doc_type, seq, text): every body cut by the size and table rule of its type; unknown types use 500 and no table rule."""
    of = lambda attribute, default: F.coalesce(F.element_at(F.create_map(*(x for c, s in SOURCES.items() for x in (F.lit(c), F.lit(getattr(s, attribute))))), F.coalesce("doc_type", F.lit(""))), F.lit(default))
    pieces = pack_paragraphs(F.col("body"), of("chunk", 500), of("table", False), separator)
    return typed.select(*id_cols, "doc_type", F.posexplode(pieces).alias("pos", "text")).select(*id_cols, "doc_type", (F.col("pos") + 1).alias("seq"), "text")


def fixed_chunks(docs: DataFrame, size: int = 120, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """(chunk_id, id, seq, text): pieces of ``size`` characters; ids end in a number of three digits from 000. Empty texts have none."""
    # one pass over the text, whatever its length: a match is up to ``size`` characters of any kind, characters beyond 16 bits too
    cut_up = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    pieces = docs.where(F.length(text_col) > 0).select(id_col, F.posexplode(cut_up).alias("seq", "text"))
    return pieces.select(F.concat(F.col(id_col).cast("string"), F.lit("_"), F.format_string("%03d", "seq")).alias("chunk_id"), id_col, "seq", "text")


def rechunk_comparison(typed: DataFrame, chunks: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_type, n_now, median_now, n_rule, median_rule): stored chunks against those that the rule of the type would make."""
    # lengths are counted per document, or per type, before anything is joined or sorted
    stored = chunks.groupBy("doc_id", F.length("text").alias("chars")).agg(F.count(F.lit(1)).alias("n")).join(types, "doc_id", "left").groupBy("doc_type", "chars").agg(F.sum("n").alias("n"))
    made = chunk_documents(typed).groupBy("doc_type", F.length("text").alias("chars")).agg(F.count(F.lit(1)).alias("n"))
    median = F.round(F.expr("percentile(chars, 0.5, n)"), 6)
    now = stored.groupBy("doc_type").agg(F.sum("n").alias("n_now"), median.alias("median_now"))
    rule = made.groupBy("doc_type").agg(F.sum("n").alias("n_rule"), median.alias("median_rule"))
    met = now.withColumn("k", F.coalesce("doc_type", F.lit(""))).drop("doc_type").join(rule.withColumn("k", F.coalesce("doc_type", F.lit(""))).drop("doc_type"), "k", "full")
    return met.select(F.nullif("k", F.lit("")).alias("doc_type"), "n_now", "median_now", "n_rule", "median_rule")
