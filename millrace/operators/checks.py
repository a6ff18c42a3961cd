"""Ingest checks: document, metadata, chunk and size reports, all in one long form (stage, item, value, threshold, verdict, note)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.keys import is_blank
from millrace.operators.skew import left_join_by_state
from millrace.sources.registry import SOURCES, required

#: What a passing corpus reaches; for upper limits less is better.
CRITERIA = {
    "doc_id_unique": 1.00, "body_present": 0.98, "date_present": 0.95, "meta_required": 0.95, "chunk_coverage": 0.98,
    "orphan_chunk": 0.00, "seq_integrity": 1.00, "empty_chunk": 0.01, "index_match": 0.99, "dup_body": 0.05, "self_search": 0.90,
}
REPORT = "stage string, item string, value double, threshold double, verdict string, note string"
SHORT_CHUNK = 30
LONGEST_INPUT = 512


def rate(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d)


def verdict(value: Column, threshold: Column, upper: bool = False) -> Column:
    """pass or fail; a value that could not be computed fails."""
    return F.when(value <= threshold if upper else value >= threshold, "pass").otherwise("fail")


def _long(figures: DataFrame, stage: str, items: list[tuple]) -> DataFrame:
    """One row per item (name, value, threshold or None, upper, note) of a one-row table of figures."""
    rows = []
    for name, value, threshold, upper, note in items:
        value, limit = value.cast("double"), F.lit(threshold).cast("double")
        result = F.lit("") if threshold is None else verdict(value, limit, upper)
        rows.append(F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("item"), F.round(value, 6).alias("value"), limit.alias("threshold"), result.alias("verdict"), note.cast("string").alias("note")))
    return figures.select(F.inline(F.array(*rows)))


def doc_integrity(raw: DataFrame, now: str) -> DataFrame:
    """Seven checks of the document table against ``now``; an empty table has null rates, which fail.

    A null or blank body is absent; absent bodies are equal to each other, as are null ids.
    """
    body = T.strip(F.coalesce("body", F.lit("")))
    at, limit = F.col("published_at"), F.lit(now).cast("timestamp_ntz")
    # copies: rows minus distinct values, the nulls as one value
    figures = raw.select("doc_id", body.alias("body"), at, "collected_at").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("ids"),
        F.count_if(F.col("body") != "").alias("bodies"),
        F.count_if(at.isNotNull()).alias("dated"),
        F.count_if(F.col("collected_at").isNotNull()).alias("collected"),
        F.count_distinct(F.xxhash64("body"), F.md5("body")).alias("different"),
        F.count_if((at > limit) | (at < F.lit("2000-01-01").cast("timestamp_ntz"))).alias("odd"),
    )
    n, c = F.col("n"), CRITERIA
    return _long(figures, "1_documents", [
        ("documents", n, None, False, F.lit("")),
        ("doc_id unique", rate(F.col("ids"), n), c["doc_id_unique"], False, n - F.col("ids")),
        ("body present", rate(F.col("bodies"), n), c["body_present"], False, n - F.col("bodies")),
        ("published_at present", rate(F.col("dated"), n), c["date_present"], False, n - F.col("dated")),
        ("collected_at present", rate(F.col("collected"), n), c["date_present"], False, n - F.col("collected")),
        ("duplicate bodies", rate(n - F.col("different"), n), c["dup_body"], True, n - F.col("different")),
        ("odd dates", F.col("odd"), 0.0, True, F.col("odd")),
    ])


def meta_completeness(typed: DataFrame) -> DataFrame:
    """(doc_type, field, n_docs, n_filled, rate, verdict) per type and required field.

    ``typed`` has doc_type codes. Types outside the registry get one row without a rate, required columns that the
    table lacks get rate 0. Rows without a type are left out.
    """
    fields = sorted({f for c in SOURCES for f in required(c)})
    filled = [F.count_if(~is_blank(F.col(f).cast("string"))).alias(f) if f in typed.columns else F.lit(0).cast("long").alias(f) for f in fields]
    counts = typed.where("doc_type is not null").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"), *filled)
    wanted = F.create_map(*(x for c in SOURCES for x in (F.lit(c), F.array(*map(F.lit, required(c))))))
    per_type = F.coalesce(F.element_at(wanted, F.col("doc_type")), F.array(F.lit("-")))
    values = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))
    rows = counts.select("doc_type", "n_docs", F.explode(per_type).alias("field"), values.alias("m"))
    share = F.round(rate(F.element_at("m", F.col("field")), F.col("n_docs")), 6)
    known = F.col("field") != "-"
    return rows.select("doc_type", "field", "n_docs", F.coalesce(F.element_at("m", F.col("field")), F.lit(0)).alias("n_filled"), F.when(known, share).alias("rate"), F.when(known, verdict(share, F.lit(CRITERIA["meta_required"]))).otherwise("undefined").alias("verdict"))


def type_distribution(typed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_type, n_docs, share, n_chunks, chunks_per_doc, first_date, last_date, mean_length) per type, absent types as one.

    Chunks are counted per document first, so a hot document is one row of the join; a chunk counts for every type its
    document has.
    """
    per_doc = chunks.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = typed.where("doc_id is not null").select("doc_type", "doc_id").distinct()
    n_chunks = pairs.join(per_doc, "doc_id").groupBy("doc_type").agg(F.sum("n").alias("n_chunks"))
    docs = typed.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n_docs"), F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("published_at"), "yyyy-MM-dd").alias("last_date"), F.round(F.avg(F.length(F.coalesce("body", F.lit("")))), 3).alias("mean_length")
    )
    met = docs.join(n_chunks, docs.doc_type.eqNullSafe(n_chunks.doc_type), "left").drop(n_chunks.doc_type).na.fill(0, ["n_chunks"])
    # one row a type: the unpartitioned window holds only the types
    total = F.sum("n_docs").over(Window.partitionBy(F.lit(1)))
    return met.select("doc_type", "n_docs", F.round(F.col("n_docs") / total, 6).alias("share"), "n_chunks", F.round(F.col("n_chunks") / F.col("n_docs"), 3).alias("chunks_per_doc"), "first_date", "last_date", "mean_length")


def chunk_integrity(raw: DataFrame, chunks: DataFrame, short: int = SHORT_CHUNK) -> DataFrame:
    """Six checks of the chunk table against its documents. Documents and chunks without an id are left out of the links.

    Every figure is an aggregate of rows already collapsed per document or per chunk, so no document's chunks meet in one task.
    """
    docs = raw.where("doc_id is not null").select("doc_id").distinct()
    per_doc = chunks.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("seq").alias("seqs"), F.count_distinct("seq").alias("different"), F.min("seq").alias("lo"), F.max("seq").alias("hi")
    )
    linked = docs.withColumn("in_raw", F.lit(True)).join(per_doc, "doc_id", "full")
    chunked = F.col("n").isNotNull()
    bad = chunked & ((F.col("seqs") != F.col("different")) | (F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)) != F.col("different")))
    links = linked.agg(
        F.count_if("in_raw").alias("docs"), F.count_if(F.col("in_raw") & chunked).alias("covered"), F.coalesce(F.sum(F.when(F.col("in_raw").isNull(), F.col("n"))), F.lit(0)).alias("orphans"), F.count_if(chunked).alias("chunked"), F.count_if(bad).alias("bad")
    )
    own = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.length(T.strip(F.coalesce("text", F.lit("")))) < short).alias("short"),
        (F.count_distinct("chunk_id") + F.coalesce(F.max(F.col("chunk_id").isNull().cast("int")), F.lit(0))).alias("ids"),
        F.count_if(F.col("doc_id").isNull()).alias("no_doc"),
    )
    both = links.select(F.lit(1).alias("one"), "*").join(own.select(F.lit(1).alias("one"), "*"), "one")
    n, c = F.col("chunks"), CRITERIA
    orphans = F.col("orphans") + F.col("no_doc")
    return _long(both, "3_chunks", [
        ("chunks", n, None, False, F.lit("")),
        ("documents chunked", rate(F.col("covered"), F.col("docs")), c["chunk_coverage"], False, F.col("docs") - F.col("covered")),
        ("orphan chunks", rate(orphans, n), c["orphan_chunk"], True, orphans),
        ("chunk_id unique", rate(F.col("ids"), n), 1.0, False, n - F.col("ids")),
        ("seq intact", rate(F.col("chunked") - F.col("bad"), F.col("chunked")), c["seq_integrity"], False, F.col("bad")),
        ("short chunks", rate(F.col("short"), n), c["empty_chunk"], True, F.col("short")),
    ])


def chunk_size_profile(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """Sizes of the chunks per type in characters and estimated tokens: median, 95th percentile, greatest, fit to the target, share too long.

    ``types`` has one row per doc_id with its doc_type.
    """
    sized = chunks.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), T.count_tokens("text").alias("tokens"))
    # sizes are collapsed per document before the join and percentiles taken by frequency
    counted = sized.groupBy("doc_id", "chars", "tokens").agg(F.count(F.lit(1)).alias("n")).join(types, "doc_id", "left")
    by_type = counted.groupBy("doc_type", "chars", "tokens").agg(F.sum("n").alias("n"))
    pct = lambda c, p: F.round(F.expr(f"percentile({c}, {p}, n)"), 6)
    out = by_type.groupBy("doc_type").agg(
        F.sum("n").alias("n_chunks"), pct("chars", 0.5).alias("chars_median"), pct("chars", 0.95).alias("chars_p95"), F.max("chars").alias("chars_max"),
        pct("tokens", 0.5).alias("tokens_median"), pct("tokens", 0.95).alias("tokens_p95"), F.max("tokens").alias("tokens_max"),
        F.round(F.sum(F.when(F.col("tokens") > LONGEST_INPUT, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("too_long"),
    )
    target = F.coalesce(F.element_at(F.create_map(*(x for c, s in SOURCES.items() for x in (F.lit(c), F.lit(s.chunk)))), F.coalesce("doc_type", F.lit(""))), F.lit(500))
    off = F.abs(F.col("chars_median") - target)
    fit = F.when(off <= target * 0.4, "fits").when(F.col("chars_median") < target, "small").otherwise("large")
    return out.withColumn("target", target).withColumn("fit", fit)


def storage_form(typed: DataFrame) -> DataFrame:
    """(doc_type, ...) how bodies are stored: median length, share empty, with tags, with table rows, with three line ends or more."""
    body = F.coalesce("body", F.lit(""))
    per = lambda cond: F.round(F.avg(cond.cast("double")) * 100, 6)
    return typed.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.percentile(F.length(body), F.lit(0.5)), 6).alias("median_length"), per(T.strip(body) == "").alias("empty_pct"), per(body.rlike("<[a-zA-Z/][^>]*>")).alias("html_pct"),
        per(body.rlike(r"(?md)^\s*\|.*\|")).alias("table_pct"), per(F.regexp_count(body, F.lit("\n")) >= 3).alias("lines_pct"),
    )


def fill_matrix(typed: DataFrame, fields: tuple[str, ...] = ("title", "published_at", "collected_at", "org_name", "author", "src_url", "file_path")) -> DataFrame:
    """(doc_type, one column a field): per cent of rows whose field is neither null nor blank."""
    return typed.groupBy("doc_type").agg(*(F.round(F.avg((~is_blank(F.col(f).cast("string"))).cast("double")) * 100, 6).alias(f) for f in fields))


def chunk_quality(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_type, rates in per cent): chunks that end within a sentence, hold a suspected table, keep noise, or lack a header.

    ``docs`` has one row per doc_id with doc_type and title.
    """
    met = left_join_by_state(chunks.select("doc_id", "text"), docs.select("doc_id", "doc_type", "title"), "doc_id")
    per = lambda cond: F.round(F.avg(cond.cast("double")) * 100, 6)
    return met.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n_chunks"), per(T.ends_mid_sentence("text")).alias("cut_pct"), per(T.table_suspect("text")).alias("table_pct"), per(T.noise_left("text", "doc_type")).alias("noise_pct"), per(T.has_header("text", "title")).alias("header_pct"),
    )


def token_stats(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_type, n, least, median, p95, most, too_long) of estimated tokens per chunk."""
    # counts by document and number of tokens meet the types, and percentiles are taken by frequency
    counted = chunks.select("doc_id", T.count_tokens("text").alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).join(types, "doc_id", "left")
    by_type = counted.groupBy("doc_type", "t").agg(F.sum("n").alias("n"))
    pct = lambda p: F.round(F.expr(f"percentile(t, {p}, n)"), 6)
    return by_type.groupBy("doc_type").agg(
        F.sum("n").alias("n"), F.min("t").alias("least"), pct(0.5).alias("median"), pct(0.95).alias("p95"), F.max("t").alias("most"), F.sum(F.when(F.col("t") > LONGEST_INPUT, F.col("n")).otherwise(0)).alias("too_long")
    )


def clean_effect(typed: DataFrame) -> DataFrame:
    """(doc_type, removed_pct, noise_before, noise_after): what cleaning takes off the bodies of each type."""
    done = typed.where(F.length(F.coalesce("body", F.lit(""))) > 0).select("doc_type", "body", T.clean("body", "doc_type").alias("cleaned"))
    per = lambda cond: F.round(F.avg(cond.cast("double")) * 100, 6)
    return done.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg((1 - F.length("cleaned") / F.length("body")) * 100), 6).alias("removed_pct"), per(T.noise_left("body", "doc_type")).alias("noise_before"), per(T.noise_left("cleaned", "doc_type")).alias("noise_after")
    )


def report(*tables: DataFrame) -> DataFrame:
    """Reports stacked into one, values rounded to four digits."""
    return reduce(DataFrame.unionByName, tables).withColumn("value", F.round("value", 4))


def meta_report(completeness: DataFrame) -> DataFrame:
    """Metadata rows in the form of the other reports."""
    return completeness.select(F.lit("2_metadata").alias("stage"), F.concat_ws(" · ", "doc_type", "field").alias("item"), F.col("rate").alias("value"), F.lit(CRITERIA["meta_required"]).alias("threshold"), "verdict", F.lit("").alias("note"))


def failed_only(reports: DataFrame) -> DataFrame:
    return reports.where("verdict = 'fail'")


def value_counts(df: DataFrame, column: str, blank: str = "(blank)") -> DataFrame:
    """(value, n): rows per value, null and empty ones under ``blank``."""
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
