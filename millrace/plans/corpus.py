"""Queries of ingest checks, cleaning, chunking, tokenizers and duplicates, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokens as K
from millrace.functions.keys import doc_key, type_aliases, with_type
from millrace.operators import checks as C
from millrace.operators import chunking as H
from millrace.operators import dedup as D
from millrace.operators.retrieval import corpus
from millrace.session import table
from millrace.sources import readers
from millrace.sources.registry import registry_table, unmapped

NOW = "2027-01-01 00:00:00"


def typed(spark: SparkSession, d: str) -> DataFrame:
    """raw with doc_type as its code; null where it has none."""
    return with_type(table(spark, d, "raw"), table(spark, d, "source_types")).drop("doc_type").withColumnRenamed("type_code", "doc_type")


def doc_types(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc_type, title): one row per stored doc_id, the least values of its rows."""
    return typed(spark, d).where("doc_id is not null").groupBy("doc_id").agg(F.min("doc_type").alias("doc_type"), F.min("title").alias("title"))


def report(spark: SparkSession, d: str) -> DataFrame:
    raw, chunks = table(spark, d, "raw"), table(spark, d, "chunks")
    return C.report(C.doc_integrity(raw, NOW), C.meta_report(C.meta_completeness(typed(spark, d))), C.chunk_integrity(raw, chunks))


def text_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.ends_mid_sentence("text").alias("cut"), T.table_suspect("text").alias("table_suspect"), F.size(T.sentences("text", 10)).alias("n_sentences"), T.difficulty("text").alias("difficulty"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.count_tokens("text").alias("n_tokens"), F.size(K.words("text")).alias("n_words"), F.size(K.char_grams("text")).alias("n_grams"), F.size(K.shingles("text")).alias("n_shingles"), F.size(K.keywords("text")).alias("n_keywords"))


def tokenizers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "golden_sample100")
    return q.select("qid", F.array_join(K.words("question"), " / ").alias("space"), F.array_join(K.stems("question"), " / ").alias("josa"))


def cleaned_bodies(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).select("raw_no", T.clean("body", "doc_type").alias("c")).select("raw_no", F.md5("c").alias("cleaned_md5"), F.length("c").alias("n_chars"))


def email_bodies(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).where("doc_type = 'EMAIL'").select("raw_no", T.clean_email("body").alias("cleaned"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw").select("raw_no", F.md5(T.remove_repeated_lines("body")).alias("cleaned_md5"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    names = registry_table(spark).select(F.col("code").alias("doc_type"), "ko_name")
    return typed(spark, d).join(F.broadcast(names), "doc_type", "left").select("raw_no", T.build_header(F.coalesce("ko_name", "doc_type"), "published_at", "org_name", "title").alias("header"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("published_at").isNull()).alias("n_undated"), F.round(F.avg(F.col("published_at").isNull().cast("double")) * 100, 6).alias("undated_pct"), F.count_distinct("org_name").alias("n_orgs"))


def chunks_by_type(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(doc_types(spark, d), "doc_id").groupBy("doc_type").agg(F.sum("n").alias("n_chunks"))


def sample_per_type(spark: SparkSession, d: str) -> DataFrame:
    w = "row_number() over (partition by doc_type order by doc_id, raw_no)"
    return typed(spark, d).where("doc_id is not null").select("doc_type", "doc_id", "raw_no", F.expr(w).alias("i")).where("i <= 20")


def uncovered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "raw").select("doc_id").where("doc_id is not null").distinct()
    return docs.join(table(spark, d, "chunks").select("doc_id").distinct(), "doc_id", "left_anti")


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    keys = lambda n: table(spark, d, n).select(doc_key("doc_id").alias("key")).where("key is not null and key <> ''").distinct()
    raw, chunks = keys("raw"), keys("chunks")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(raw.intersect(chunks), "both").unionByName(n(raw.exceptAll(chunks), "raw only")).unionByName(n(chunks.exceptAll(raw), "chunks only"))


def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_groups(table(spark, d, "raw"), "raw_no", "body")


def first_per_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"), "source", "lang")
    return D.first_of(docs, ["h"], ["doc_id", "source", "lang"])


def near_dups(spark: SparkSession, d: str) -> DataFrame:
    found = D.near(table(spark, d, "documents"), "doc_id", "text")
    return found.members.join(found.link_counts(), "id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def republished(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return D.earliest_of_class(D.near_classes(docs, "doc_id", "text", 0.9)[1], docs)


QUERIES = {
    "ingest_report": report,
    "ingest_failed": lambda s, d: C.failed_only(report(s, d)),
    "doc_integrity": lambda s, d: C.doc_integrity(table(s, d, "raw"), NOW),
    "meta_completeness": lambda s, d: C.meta_completeness(typed(s, d)),
    "type_distribution": lambda s, d: C.type_distribution(typed(s, d), table(s, d, "chunks")),
    "chunk_integrity": lambda s, d: C.chunk_integrity(table(s, d, "raw"), table(s, d, "chunks")),
    "chunk_size_profile": lambda s, d: C.chunk_size_profile(table(s, d, "chunks"), doc_types(s, d)),
    "token_stats": lambda s, d: C.token_stats(table(s, d, "chunks"), doc_types(s, d)),
    "chunk_quality": lambda s, d: C.chunk_quality(table(s, d, "chunks"), doc_types(s, d)),
    "clean_effect": lambda s, d: C.clean_effect(typed(s, d)),
    "storage_form": lambda s, d: C.storage_form(typed(s, d)),
    "fill_matrix": lambda s, d: C.fill_matrix(typed(s, d)),
    "inventory_by_type": inventory,
    "chunks_by_type": chunks_by_type,
    "sample_per_type": sample_per_type,
    "unmapped_types": lambda s, d: unmapped(table(s, d, "raw"), type_aliases(table(s, d, "source_types"))),
    "registry": lambda s, d: registry_table(s),
    "standard_types": lambda s, d: readers.standard_types(readers.select_mapped(table(s, d, "raw"), readers.RAW_COLUMNS), table(s, d, "source_types")).select("raw_no", "doc_type", "doc_type_raw"),
    "index_check": lambda s, d: readers.index_check(table(s, d, "chunks"), corpus(table(s, d, "chunks"))),
    "org_counts": lambda s, d: C.value_counts(table(s, d, "raw"), "org_name"),
    "uncovered_docs": uncovered,
    "key_sets": key_sets,
    "text_flags": text_flags,
    "token_counts": token_counts,
    "tokenizer_table": tokenizers,
    "cleaned_bodies": cleaned_bodies,
    "email_bodies": email_bodies,
    "repeated_lines_in_body": repeated_lines,
    "headers": headers,
    "fixed_chunks": lambda s, d: H.fixed_chunks(table(s, d, "raw"), 120, "raw_no", "body").select("chunk_id", "seq", F.md5("text").alias("text_md5")),
    "packed_chunks": lambda s, d: H.chunk_documents(typed(s, d), "\n\n", ("raw_no",)),
    "rechunk_comparison": lambda s, d: H.rechunk_comparison(typed(s, d), table(s, d, "chunks"), doc_types(s, d)),
    "exact_dups": exact_dups,
    "copy_counts": lambda s, d: D.copy_counts(table(s, d, "raw"), ("doc_id", "title", "body", "org_name")),
    "first_per_hash": first_per_hash,
    "near_dup_classes": near_dups,
    "republished_first": republished,
}

ALIAS = "alias AS (SELECT a, min(code) AS code FROM (SELECT code, upper(trim(unnest(list_prepend(code, string_split(coalesce(aliases, ''), ';'))))) AS a FROM source_types) WHERE a <> '' GROUP BY 1)"
TYPED = f"WITH {ALIAS}, ty AS (SELECT raw.* EXCLUDE (doc_type), alias.code AS doc_type FROM raw LEFT JOIN alias ON a = upper(trim(raw.doc_type)))"
TYPES = ", dt AS (SELECT doc_id, min(doc_type) AS doc_type, min(title) AS title FROM ty WHERE doc_id IS NOT NULL GROUP BY 1)"
_WS = r"'[ \t\n\x0B\f\r]+'"
_STRIP = lambda x: rf"regexp_replace(regexp_replace({x}, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')"
_BLANK = lambda x: rf"(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '[\t\n\x0B\f\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g') = '')"
TOKENS = r"CAST(floor(0.8 * length(regexp_replace(coalesce(text, ''), '[^가-힣]', '', 'g')) + length(regexp_replace(coalesce(text, ''), '[가-힣 \t\n\x0B\f\r]', '', 'g')) / 4 + 0.5) AS INTEGER)"
WORDS = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_%.]+')"
STEMS = lambda c: rf"list_transform({WORDS(c)}, lambda w: CASE WHEN length(w) > 2 AND regexp_matches(w, '[가-힣]$') THEN regexp_replace(w, '({'|'.join(K.PARTICLES)})$', '') ELSE w END)"
GRAMS = lambda t, n: f"(CASE WHEN length({t}) < {n} THEN [] ELSE list_distinct(list_transform(range(1, length({t}) - {n} + 2), lambda i: substr({t}, i, {n}))) END)"
SQUEEZED = lambda c: rf"regexp_replace(coalesce({c}, ''), {_WS}, '', 'g')"
GRAMS3 = lambda c: GRAMS(SQUEEZED(c), 3)
KEYWORDS = lambda c: f"list_distinct(regexp_extract_all(coalesce({c}, ''), '[가-힣A-Za-z0-9]{{2,}}'))"
_PCT = lambda cond: f"round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) * 100, 6)"
_SENTS = lambda c, n: rf"list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)), lambda s: {_STRIP('s')}), lambda s: length(s) >= {n})"
_CUT = rf"({_STRIP('coalesce(text, chr(32))')} <> '' AND NOT regexp_matches(coalesce(text, ''), '([.!?。…]|다|요|음|함|임|됨|중|것|\)|\]|%|원|EB|달러)[ \t\n\x0B\f\r]*$'))"
_SUSPECT = r"contains(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN len(regexp_extract_all(x, '[0-9]+(?:\.[0-9]+)?%?')) >= 2 AND length(x) < 60 AND NOT contains(x, '|') THEN '1' ELSE '0' END), ''), '111')"


def _items(stage: str, rows: list[tuple[str, str, float | None, bool, str]], source: str) -> str:
    """Report rows (item, value, threshold, upper, note) as a UNION."""
    out = []
    for item, value, threshold, upper, note in rows:
        limit = "CAST(NULL AS DOUBLE)" if threshold is None else f"CAST({threshold} AS DOUBLE)"
        word = "''" if threshold is None else f"CASE WHEN {value} {'<=' if upper else '>='} {threshold} THEN 'pass' ELSE 'fail' END"
        out.append(f"SELECT '{stage}' AS stage, '{item}' AS item, round(CAST({value} AS DOUBLE), 6) AS value, {limit} AS threshold, {word} AS verdict, CAST({note} AS VARCHAR) AS note FROM {source}")
    return " UNION ALL ".join(out)


_DOC_CTE = f"""di AS (SELECT count(*) AS n, count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) AS ids, count(*) FILTER ({_STRIP("coalesce(body, '')")} <> '') AS bodies, count(published_at) AS dated, count(collected_at) AS coll,
  count(DISTINCT {_STRIP("coalesce(body, '')")}) AS different, count(*) FILTER (published_at > TIMESTAMP '{NOW}' OR published_at < TIMESTAMP '2000-01-01') AS odd FROM raw)"""
_DOC_ITEMS = _items("1_documents", [
    ("documents", "n", None, False, "''"), ("doc_id unique", "ids / n", 1.0, False, "n - ids"), ("body present", "bodies / n", 0.98, False, "n - bodies"), ("published_at present", "dated / n", 0.95, False, "n - dated"),
    ("collected_at present", "coll / n", 0.95, False, "n - coll"), ("duplicate bodies", "(n - different) / n", 0.05, True, "n - different"), ("odd dates", "odd", 0.0, True, "odd"),
], "di")
_CHUNK_CTE = f"""pd AS (SELECT doc_id, count(*) AS n, count(seq) AS seqs, count(DISTINCT seq) AS different, min(seq) AS lo, max(seq) AS hi FROM chunks WHERE doc_id IS NOT NULL GROUP BY 1),
lk AS (SELECT r.doc_id IS NOT NULL AS in_raw, pd.* EXCLUDE (doc_id), pd.n IS NOT NULL AS chunked FROM (SELECT DISTINCT doc_id FROM raw WHERE doc_id IS NOT NULL) r FULL JOIN pd ON r.doc_id = pd.doc_id),
la AS (SELECT count(*) FILTER (in_raw) AS docs, count(*) FILTER (in_raw AND chunked) AS covered, coalesce(sum(n) FILTER (NOT in_raw), 0) AS orphans, count(*) FILTER (chunked) AS chunked, count(*) FILTER (chunked AND (seqs <> different OR coalesce(hi - lo + 1, 0) <> different)) AS bad FROM lk),
ca AS (SELECT count(*) AS n, count(*) FILTER (length({_STRIP("coalesce(text, '')")}) < 30) AS short, count(DISTINCT chunk_id) + coalesce(max(CAST(chunk_id IS NULL AS INT)), 0) AS ids, count(*) FILTER (doc_id IS NULL) AS no_doc FROM chunks),
ci AS (SELECT * FROM la, ca)"""
_CHUNK_ITEMS = _items("3_chunks", [
    ("chunks", "n", None, False, "''"), ("documents chunked", "covered / docs", 0.98, False, "docs - covered"), ("orphan chunks", "(orphans + no_doc) / n", 0.0, True, "CAST(orphans + no_doc AS BIGINT)"),
    ("chunk_id unique", "ids / n", 1.0, False, "n - ids"), ("seq intact", "(chunked - bad) / chunked", 1.0, False, "bad"), ("short chunks", "short / n", 0.01, True, "short"),
], "ci")


def _meta() -> str:
    from millrace.sources.registry import SOURCES, required

    rows = [f"SELECT '{c}' AS doc_type, '{f}' AS field, count(*) FILTER (doc_type = '{c}') AS n_docs, count(*) FILTER (doc_type = '{c}' AND NOT {_BLANK(f)}) AS n_filled FROM ty" for c in SOURCES for f in required(c)]
    return "mc AS (SELECT doc_type, field, n_docs, n_filled, round(n_filled / n_docs, 6) AS rate, CASE WHEN round(n_filled / n_docs, 6) >= 0.95 THEN 'pass' ELSE 'fail' END AS verdict FROM (" + " UNION ALL ".join(rows) + ") WHERE n_docs > 0)"


_ALL = f"""{TYPED}, {_meta()}, {_DOC_CTE}, {_CHUNK_CTE}, rp AS (
SELECT stage, item, round(value, 4) AS value, threshold, verdict, note FROM ({_DOC_ITEMS} UNION ALL SELECT '2_metadata', doc_type || ' · ' || field, rate, 0.95, verdict, '' FROM mc UNION ALL {_CHUNK_ITEMS}))
"""


def _clean_sql(column: str = "body", kind: str = "doc_type") -> str:
    """CASE over the types with their cleaning in SQL; an array of lines is filtered as in the engine."""
    from millrace.sources.registry import SOURCES

    cases = []
    for code, s in SOURCES.items():
        x = f"coalesce({column}, '')"
        if s.strip_email:
            x = _email_sql(x)
        if s.strip_repeat:
            x = _repeat_sql(x)
        for p in s.noise:
            q = p.replace("'", "''").replace(r"\s", r"[ \t\n\x0B\f\r]").replace(r"\S", r"[^ \t\n\x0B\f\r]")
            x = f"regexp_replace({x}, '(?m){q}', '', 'g')"
        cases.append(f"WHEN {kind} = '{code}' THEN {x}")
    inner = f"(CASE {' '.join(cases)} ELSE coalesce({column}, '') END)"
    return _STRIP(f"regexp_replace(regexp_replace({inner}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _email_sql(x: str) -> str:
    sp = lambda p: p.replace(r"\s", r"[ \t\n\x0B\f\r]").replace(r"\S", r"[^ \t\n\x0B\f\r]")
    cut = "|".join(f"(?:{sp(p)})" for p in T.EMAIL_CUT)
    drop = "^(?:" + "|".join(f"(?:{sp(p)})" for p in T.EMAIL_SIGNATURE + T.EMAIL_NOTICE) + ")"
    ls = f"string_split({x}, chr(10))"
    at = f"list_position(list_transform({ls}, lambda l: regexp_matches({_STRIP('l')}, '{cut}')), true)"
    head = f"(CASE WHEN {at} > 0 THEN list_slice({ls}, 1, {at} - 1) ELSE {ls} END)"
    return _STRIP(f"array_to_string(list_filter({head}, lambda l: NOT starts_with(ltrim(l), '>') AND NOT regexp_matches({_STRIP('l')}, '{drop}')), chr(10))")


def _repeat_sql(x: str) -> str:
    ls = f"string_split({x}, chr(10))"
    short = f"list_sort(list_filter(list_transform({ls}, lambda l: {_STRIP('l')}), lambda l: l <> '' AND length(l) <= 60))"
    twice = f"list_filter({short}, lambda l, i: i < len({short}) AND {short}[i + 1] = l)"
    return f"array_to_string(list_filter({ls}, lambda l: NOT list_contains({twice}, {_STRIP('l')})), chr(10))"


SQL = {
    "doc_integrity": f"WITH {_DOC_CTE} {_DOC_ITEMS}",
    "chunk_integrity": f"WITH {_CHUNK_CTE} {_CHUNK_ITEMS}",
    "meta_completeness": f"{TYPED}, {_meta()} SELECT * FROM mc",
    "ingest_report": f"{_ALL} SELECT * FROM rp",
    "ingest_failed": f"{_ALL} SELECT * FROM rp WHERE verdict = 'fail'",
    "type_distribution": f"""{TYPED}, pc AS (SELECT doc_id, count(*) AS n FROM chunks WHERE doc_id IS NOT NULL GROUP BY 1),
nc AS (SELECT doc_type, sum(n) AS n_chunks FROM (SELECT DISTINCT doc_type, doc_id FROM ty WHERE doc_id IS NOT NULL) JOIN pc USING (doc_id) GROUP BY 1),
g AS (SELECT doc_type, count(*) AS n_docs, strftime(min(published_at), '%Y-%m-%d') AS first_date, strftime(max(published_at), '%Y-%m-%d') AS last_date, round(avg(length(coalesce(body, ''))), 3) AS mean_length FROM ty GROUP BY 1)
SELECT g.doc_type, n_docs, round(n_docs / sum(n_docs) OVER (), 6) AS share, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, round(coalesce(n_chunks, 0) / n_docs, 3) AS chunks_per_doc, first_date, last_date, mean_length
FROM g LEFT JOIN nc ON g.doc_type IS NOT DISTINCT FROM nc.doc_type""",
    "chunk_size_profile": f"""{TYPED}{TYPES}, s AS (SELECT dt.doc_type, length(coalesce(text, '')) AS chars, {TOKENS} AS tokens FROM chunks LEFT JOIN dt USING (doc_id)),
g AS (SELECT doc_type, count(*) AS n_chunks, round(quantile_cont(chars, 0.5), 6) AS chars_median, round(quantile_cont(chars, 0.95), 6) AS chars_p95, max(chars) AS chars_max, round(quantile_cont(tokens, 0.5), 6) AS tokens_median,
  round(quantile_cont(tokens, 0.95), 6) AS tokens_p95, max(tokens) AS tokens_max, round(count(*) FILTER (tokens > 512) / count(*), 6) AS too_long,
  CASE doc_type WHEN 'BROKER' THEN 600 WHEN 'INSTITUTION' THEN 600 WHEN 'EMAIL' THEN 400 WHEN 'MEETING' THEN 450 WHEN 'REPORT' THEN 600 ELSE 500 END AS target FROM s GROUP BY 1)
SELECT *, CASE WHEN abs(chars_median - target) <= target * 0.4 THEN 'fits' WHEN chars_median < target THEN 'small' ELSE 'large' END AS fit FROM g""",
    "token_stats": f"""{TYPED}{TYPES}, s AS (SELECT dt.doc_type, {TOKENS} AS t FROM chunks LEFT JOIN dt USING (doc_id))
SELECT doc_type, count(*) AS n, min(t) AS least, round(median(t), 6) AS median, round(quantile_cont(t, 0.95), 6) AS p95, max(t) AS most, count(*) FILTER (t > 512) AS too_long FROM s GROUP BY 1""",
    "storage_form": rf"""{TYPED} SELECT doc_type, count(*) AS n_docs, round(median(length(coalesce(body, ''))), 6) AS median_length, {_PCT(_STRIP("coalesce(body, '')") + " = ''")} AS empty_pct, {_PCT("regexp_matches(coalesce(body, ''), '<[a-zA-Z/][^>]*>')")} AS html_pct,
{_PCT(r"regexp_matches(coalesce(body, ''), '(?m)^[ \t\n\x0B\f\r]*\|.*\|')")} AS table_pct, {_PCT("length(coalesce(body, '')) - length(replace(coalesce(body, ''), chr(10), '')) >= 3")} AS lines_pct FROM ty GROUP BY 1""",
    "fill_matrix": f"{TYPED} SELECT doc_type, " + ", ".join(f"{_PCT('NOT ' + _BLANK(f))} AS {f}" for f in ("title", "published_at", "collected_at", "org_name", "author", "src_url", "file_path")) + " FROM ty GROUP BY 1",
    "inventory_by_type": f"{TYPED} SELECT doc_type, count(*) AS n_docs, count(*) FILTER (published_at IS NULL) AS n_undated, {_PCT('published_at IS NULL')} AS undated_pct, count(DISTINCT org_name) AS n_orgs FROM ty GROUP BY 1",
    "chunks_by_type": f"{TYPED}{TYPES} SELECT doc_type, count(*) AS n_chunks FROM chunks JOIN dt USING (doc_id) GROUP BY 1",
    "sample_per_type": f"{TYPED}, n AS (SELECT doc_type, doc_id, raw_no, CAST(row_number() OVER (PARTITION BY doc_type ORDER BY doc_id, raw_no) AS INTEGER) AS i FROM ty WHERE doc_id IS NOT NULL) SELECT * FROM n WHERE i <= 20",
    "unmapped_types": f"WITH {ALIAS}, c AS (SELECT doc_type AS doc_type_raw, count(*) AS n_docs FROM raw GROUP BY 1) SELECT doc_type_raw, n_docs, code AS doc_type, CASE WHEN code IS NULL THEN 'unknown' ELSE 'known' END AS status, CASE WHEN code IS NULL THEN 'add an alias or a type' ELSE '' END AS remedy FROM c LEFT JOIN alias ON a = upper(trim(doc_type_raw))",
    "standard_types": f"WITH {ALIAS} SELECT raw_no, coalesce(code, doc_type) AS doc_type, doc_type AS doc_type_raw FROM raw LEFT JOIN alias ON a = upper(trim(doc_type))",
    "index_check": "WITH i AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL), n AS (SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM i) AS n_index) SELECT n_chunks, n_index, round(n_index / n_chunks, 4) AS ratio, '' AS missing_fields FROM n",
    "org_counts": "SELECT coalesce(nullif(org_name, ''), '(blank)') AS value, count(*) AS n FROM raw GROUP BY 1",
    "uncovered_docs": "SELECT DISTINCT doc_id FROM raw WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL)",
    "key_sets": "WITH r AS (SELECT DISTINCT upper(trim(doc_id)) AS k FROM raw WHERE trim(doc_id) <> ''), c AS (SELECT DISTINCT upper(trim(doc_id)) AS k FROM chunks WHERE trim(doc_id) <> '') SELECT 'both' AS part, count(*) AS n FROM r SEMI JOIN c USING (k) UNION ALL SELECT 'raw only', count(*) FROM r ANTI JOIN c USING (k) UNION ALL SELECT 'chunks only', count(*) FROM c ANTI JOIN r USING (k)",
    "text_flags": rf"SELECT chunk_id, {_CUT} AS cut, {_SUSPECT} AS table_suspect, CAST(len({_SENTS('text', 10)}) AS INTEGER) AS n_sentences, CASE WHEN regexp_matches(coalesce(text, ''), '([A-Z]{{2,}}[-_]?[0-9]+|[0-9][0-9,\.]{{2,}}[ \t\n\x0B\f\r]*(?:%|억|조|EB|TB|GB|달러|원)?|[A-Z]{{3,}})') THEN 'easy' ELSE 'mid' END AS difficulty FROM chunks",
    "token_counts": rf"WITH c AS (SELECT chunk_id, text, regexp_replace(coalesce(text, ''), {_WS}, ' ', 'g') AS w FROM chunks) SELECT chunk_id, {TOKENS} AS n_tokens, CAST(len({WORDS('text')}) AS INTEGER) AS n_words, CAST(len({GRAMS3('text')}) AS INTEGER) AS n_grams, CAST(CASE WHEN length(w) < 5 THEN 1 ELSE len({GRAMS('w', 5)}) END AS INTEGER) AS n_shingles, CAST(len({KEYWORDS('text')}) AS INTEGER) AS n_keywords FROM c",
    "tokenizer_table": f"SELECT qid, array_to_string({WORDS('question')}, ' / ') AS space, array_to_string({STEMS('question')}, ' / ') AS josa FROM golden_sample100",
    "cleaned_bodies": f"{TYPED}, c AS (SELECT raw_no, {_clean_sql()} AS x FROM ty) SELECT raw_no, md5(x) AS cleaned_md5, CAST(length(x) AS INTEGER) AS n_chars FROM c",
    "email_bodies": f"""{TYPED} SELECT raw_no, {_email_sql("coalesce(body, '')")} AS cleaned FROM ty WHERE doc_type = 'EMAIL'""",
    "repeated_lines_in_body": f"""SELECT raw_no, md5({_repeat_sql("coalesce(body, '')")}) AS cleaned_md5 FROM raw""",
    "headers": f"""{TYPED} SELECT raw_no, '[' || array_to_string(list_filter([coalesce(CASE doc_type WHEN 'NEWS' THEN '뉴스' WHEN 'BROKER' THEN '증권사' WHEN 'INSTITUTION' THEN '기관' WHEN 'EMAIL' THEN '메일' WHEN 'MEETING' THEN '회의록' WHEN 'REPORT' THEN '사내 보고서' WHEN 'EXEC_REPORT' THEN '임원 보고서' END, ''),
coalesce(strftime(published_at, '%Y-%m-%d'), '날짜미상'), coalesce(org_name, ''), coalesce(title, '')], lambda x: x <> ''), ' | ') || ']' AS header FROM ty""",
    "fixed_chunks": "WITH p AS (SELECT raw_no, body, unnest(range(0, length(body), 120)) AS pos FROM raw WHERE length(body) > 0) SELECT raw_no || '_' || lpad(CAST(CAST(pos / 120 AS INTEGER) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(pos / 120 AS INTEGER) AS VARCHAR))) AS INTEGER), '0') AS chunk_id, CAST(pos / 120 AS INTEGER) AS seq, md5(substr(body, pos + 1, 120)) AS text_md5 FROM p",
    "exact_dups": f"WITH h AS (SELECT raw_no, sha256({_STRIP('body')}) AS hash FROM raw WHERE body IS NOT NULL) SELECT raw_no, hash, n FROM h JOIN (SELECT hash, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1) USING (hash)",
    "copy_counts": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count(DISTINCT {c}) - max(CAST({c} IS NULL AS INT)) AS n_copies FROM raw" for c in ("doc_id", "title", "body", "org_name")),
    "first_per_hash": "SELECT md5(text) AS h, doc_id, source, lang FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
}
