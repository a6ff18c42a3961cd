"""Further queries: side-by-side lists, set operations, cross-tabs, rates and run summaries, with their SQL; and SQL of queries defined elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokens as K
from millrace.functions.keys import doc_key
from millrace.operators import compare as P
from millrace.operators import dedup as D
from millrace.operators import evalsets as V
from millrace.operators import metrics as M
from millrace.operators import retrieval as R
from millrace.operators import sqlroute as S
from millrace.plans import corpus as C
from millrace.plans import search as Q
from millrace.session import table
from millrace.sources.registry import SOURCES

SOURCE_NAMES = list(SOURCES)


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    a, b = Q.bm25(spark, d), Q.sparse(spark, d)
    return a.select("qid", "rank", F.col("chunk_id").alias("bm25")).join(b.select("qid", "rank", F.col("chunk_id").alias("sparse")), ["qid", "rank"], "full")


def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = R.searches(Q.docs(spark, d), Q.golden(spark, d), [("bm25", K.words), ("sparse", K.stems)], 10)
    by_words, by_stems = (hits.select("qid", "chunk_id", "rank") for hits in found)
    return D.first_of(by_words.unionByName(by_stems), ["qid", "chunk_id"], ["rank"])


def question_dedup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_sample100").select("qid", V.question_key().alias("key"))
    return g.groupBy("key").agg(F.min("qid").alias("qid"), F.count(F.lit(1)).alias("n"))


def sample_errors(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_sample100").groupBy("q_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("q_type", "n", V.sample_error(F.col("n")).alias("error_pct"))


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return P.crosstab(table(spark, d, "golden_sample100"), "q_type", "source", SOURCE_NAMES)


def title_rates(spark: SparkSession, d: str) -> DataFrame:
    return P.rates(table(spark, d, "golden_sample100"), "source", F.length("title") >= 30, F.col("title").isNotNull())


def rubric(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_sample100")
    return P.rubric(g.select(M.refusal_ok("gold_text", F.col("q_type") == V.UNANSWERABLE).alias("score"), (F.col("q_type") == V.UNANSWERABLE).alias("is_no_answer")))


def first_last(spark: SparkSession, d: str) -> DataFrame:
    """(doc_type, load_no, p, delta, regressed): share of undated rows of each type in each load that has it, and last minus first of the type."""
    raw = C.typed(spark, d).where("doc_type is not null and load_no is not null")
    runs = raw.groupBy("doc_type", "load_no").agg(F.round(F.avg((F.col("published_at").isNull()).cast("double")), 6).alias("p"))
    ends = runs.groupBy("doc_type").agg(F.round(F.max_by("p", "load_no") - F.min_by("p", "load_no"), 6).alias("delta"))
    return runs.join(ends, "doc_type").withColumn("regressed", F.col("delta") < 0)


def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """How alike the first and the last title are that a document was collected with, of those collected more than once."""
    raw = table(spark, d, "raw").select("raw_no", doc_key("doc_id").alias("key"), "title").where("key is not null and key <> ''")
    keys = raw.groupBy("key").agg(F.min("raw_no").alias("id_a"), F.max("raw_no").alias("id_b")).where("id_a < id_b").select("id_a", "id_b")
    return D.title_jaccard(raw.select(F.col("raw_no").alias("id"), F.col("title").alias("text")), keys)


def worst(spark: SparkSession, d: str) -> DataFrame:
    return Q.detail(spark, d).select("qid", "mrr").orderBy("mrr", "qid").limit(5)


def best_run(spark: SparkSession, d: str) -> DataFrame:
    return Q.runs(spark, d).agg(F.max("p").alias("best"), F.max_by("run_id", F.struct("p", "run_id")).alias("run_id"), F.count_if(F.col("p") >= 0.95).alias("n_good"), F.round(F.avg((F.col("p") >= 0.95).cast("double")), 6).alias("good_rate"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Loads by state: received in full, in part, or without a declared number."""
    got = table(spark, d, "raw").groupBy("load_no").agg(F.count(F.lit(1)).alias("rows"))
    met = table(spark, d, "loads").join(got, "load_no", "left").na.fill(0, ["rows"])
    state = F.when(F.col("declared_rows").isNull(), "undeclared").when(F.col("rows") == F.col("declared_rows"), "complete").otherwise("differs")
    n = met.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # three rows
    return n.select("state", "n", F.round(F.col("n") / total, 6).alias("share"))


def routing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often figures questions go to the metric path and others to text."""
    g = table(spark, d, "golden_sample100")
    want = F.when(F.col("q_type") == "수치", F.array(F.lit("sql"), F.lit("hybrid"))).otherwise(F.array(F.lit("rag"), F.lit("none")))
    met = S.route(g, Q.CATALOG).join(g.select("qid", "q_type"), "qid")
    return met.groupBy("q_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.array_contains(want, F.col("route")).cast("double")), 6).alias("accuracy"))


def dup_pair_set(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    links, _ = D.near_classes(docs, "doc_id", "text")
    return V.duplicate_queries(links, docs.select(F.col("doc_id").cast("string").alias("id"), "text"))


def set_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The known-item set searched by BM25 over all chunks, against its limits."""
    items = V.known_items(Q.docs(spark, d).where("doc_id <> ''"))
    from millrace.operators import retrieval as R
    from millrace.session import cut

    items = cut(items, "known-items")
    hits = R.bm25(Q.docs(spark, d), items).join(Q.docs(spark, d), "chunk_id")
    detail = M.retrieval_metrics(M.judge(hits, items), items)
    row = detail.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_5")))
    return V.against_limits(row.unpivot([], ["recall_1", "recall_5"], "metric", "value").withColumn("set_name", F.lit("known-item")))


QUERIES = {
    "mode_side_by_side": side_by_side, "union_dedup": union_dedup, "question_dedup": question_dedup, "sample_errors": sample_errors, "question_crosstab": crosstab, "title_rates": title_rates, "rubric_score": rubric, "run_first_last": first_last, "title_jaccard": title_jaccard, "worst_questions": worst,
    "best_run": best_run, "load_progress": progress, "routing_accuracy": routing_accuracy, "dup_pair_set": dup_pair_set, "set_verdicts": set_verdicts,
}


def _noise(column: str, kind: str) -> str:
    spaced = lambda p: p.replace(r"\s", r"[ \t\n\x0B\f\r]").replace(r"\S", r"[^ \t\n\x0B\f\r]")
    cases = []
    for code, s in SOURCES.items():
        patterns = [*s.noise, *(T.EMAIL_CUT + T.EMAIL_NOTICE if s.strip_email else [])]
        if patterns:
            cases.append(f"({kind} = '{code}' AND regexp_matches(coalesce({column}, ''), '(?m){'|'.join(f'(?:{spaced(p)})' for p in patterns)}'))")
    return f"coalesce({' OR '.join(cases)}, false)"


_MOVES = (
    __import__("millrace.plans.quality", fromlist=["x"])._P1_ROWS
    + """,
v AS (SELECT load_no, 'published_at' AS col_name, strftime(p, '%Y-%m-%d %H:%M:%S.%f') AS value FROM r UNION ALL SELECT load_no, 'collected_at', strftime(c, '%Y-%m-%d %H:%M:%S.%f') FROM r UNION ALL SELECT load_no, 'title', t FROM r),
sh AS (SELECT load_no, col_name, coalesce(CASE WHEN col_name = 'title' THEN regexp_replace(value, '[0-9]+', '9', 'g') ELSE substr(value, 1, 10) END, '(none)') AS shape, count(*) AS n FROM v GROUP BY ALL),
tt AS (SELECT load_no, col_name, sum(n) AS total FROM sh GROUP BY ALL), pv AS (SELECT load_no, col_name, lag(load_no) OVER (PARTITION BY col_name ORDER BY load_no) AS prev_no FROM tt), sr AS (SELECT load_no, col_name, shape, n / total AS share FROM sh JOIN tt USING (load_no, col_name)),
mv AS (SELECT load_no, col_name, shape, share AS d FROM sr UNION ALL SELECT pv.load_no, pv.col_name, shape, -share FROM pv JOIN sr ON sr.load_no = prev_no AND sr.col_name = pv.col_name)
SELECT pv.load_no, pv.col_name, CASE WHEN prev_no IS NOT NULL THEN tv END AS distance FROM pv JOIN (SELECT load_no, col_name, round(sum(abs(d)) / 2, 6) AS tv FROM (SELECT load_no, col_name, shape, sum(d) AS d FROM mv GROUP BY ALL) GROUP BY ALL) USING (load_no, col_name)"""
)
_SPLIT = r"list_filter(list_transform(string_split_regex(coalesce(question, ''), '(?:와|과|,|그리고|및)[ \t\n]+'), lambda x: trim(x)), lambda x: length(x) > 5)"
_WORDS8 = "array_to_string(list_slice(regexp_extract_all(coalesce(question, ''), '[가-힣A-Za-z0-9]{2,}'), 1, 8), ' ')"

SQL = {
    "mode_side_by_side": f"WITH {Q._G}, {Q._bm25(10)}, {Q._sparse(10)} SELECT coalesce(bm.qid, sp.qid) AS qid, coalesce(bm.rank, sp.rank) AS rank, bm.chunk_id AS bm25, sp.chunk_id AS sparse FROM bm FULL JOIN sp ON bm.qid = sp.qid AND bm.rank = sp.rank",
    "union_dedup": f"WITH {Q._G}, {Q._bm25(10)}, {Q._sparse(10)} SELECT qid, chunk_id, min(rank) AS rank FROM (SELECT qid, chunk_id, rank FROM bm UNION ALL SELECT qid, chunk_id, rank FROM sp) GROUP BY 1, 2",
    "question_dedup": r"SELECT substr(regexp_replace(coalesce(question, ''), '[^\p{L}\p{N}_]', '', 'g'), 1, 40) AS key, min(qid) AS qid, count(*) AS n FROM golden_sample100 GROUP BY 1",
    "sample_errors": "SELECT q_type, count(*) AS n, round(1.96 * sqrt(0.25 / count(*)) * 100, 1) AS error_pct FROM golden_sample100 GROUP BY 1",
    "question_crosstab": "SELECT q_type, " + ", ".join(f'count(*) FILTER (source = \'{s}\') AS "{s}"' for s in SOURCE_NAMES) + " FROM golden_sample100 GROUP BY 1",
    "title_rates": "SELECT source, count(*) AS n, count(*) FILTER (length(title) >= 30) AS n_good, round(count(*) FILTER (length(title) >= 30) / nullif(count(title), 0), 6) AS rate FROM golden_sample100 GROUP BY 1",
    "rubric_score": f"""WITH s AS (SELECT CAST(regexp_matches(coalesce(gold_text, ''), '{Q._PAT["refused"]}') = (q_type = '답없음') AS INTEGER) AS score, q_type = '답없음' AS na FROM golden_sample100) SELECT round(avg(score), 6) AS mean_score, round(avg(score) FILTER (na), 6) AS no_answer_accuracy, CASE WHEN avg(score) >= 0.75 THEN 'pass' ELSE 'fail' END AS verdict FROM s""",
    "run_first_last": f"{C.TYPED}, p AS (SELECT doc_type, load_no, round(avg(CASE WHEN published_at IS NULL THEN 1.0 ELSE 0.0 END), 6) AS p FROM ty WHERE doc_type IS NOT NULL AND load_no IS NOT NULL GROUP BY 1, 2), w AS (SELECT doc_type, round(arg_max(p, load_no) - arg_min(p, load_no), 6) AS delta FROM p GROUP BY 1) SELECT doc_type, load_no, p, delta, delta < 0 AS regressed FROM p JOIN w USING (doc_type)",
    "title_jaccard": f"""WITH k AS (SELECT min(raw_no) AS id_a, max(raw_no) AS id_b FROM raw WHERE trim(doc_id) <> '' GROUP BY upper(trim(doc_id)) HAVING min(raw_no) < max(raw_no)), g AS (SELECT raw_no, {C.GRAMS("coalesce(title, '')", 4)} AS g FROM raw)
SELECT id_a, id_b, round(CASE WHEN len(list_distinct(list_concat(a.g, b.g))) > 0 THEN len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) ELSE 0.0 END, 6) AS jaccard FROM k JOIN g a ON a.raw_no = id_a JOIN g b ON b.raw_no = id_b""",
    "unanswerable": "SELECT 'N' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS qid, ['보유 자료에 없는 기간의 월별 수치를 묻는 질문', '보유 자료에 없는 업체의 실적을 묻는 질문', '보유 자료에 없는 지표의 전망을 묻는 질문'][i % 3 + 1] || ' (변형 ' || (i + 1) || ')' AS question, '확인된 자료 없음' AS gold_answer, '' AS gold_text, '답없음' AS q_type, 'mid' AS level, '' AS gold_doc_ids, '' AS src_chunk FROM range(6) t(i)",
    "worst_questions": f"WITH {Q._JUDGED}, {Q._detail()} SELECT qid, mrr FROM de ORDER BY mrr, qid LIMIT 5",
    "best_run": f"WITH {Q._RUNS} SELECT max(p) AS best, (SELECT run_id FROM ru ORDER BY p DESC, run_id DESC LIMIT 1) AS run_id, count(*) FILTER (p >= 0.95) AS n_good, round(avg(CASE WHEN p >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS good_rate FROM ru",
    "load_progress": "WITH g AS (SELECT load_no, count(*) AS c FROM raw GROUP BY 1), s AS (SELECT CASE WHEN declared_rows IS NULL THEN 'undeclared' WHEN coalesce(c, 0) = declared_rows THEN 'complete' ELSE 'differs' END AS state FROM loads LEFT JOIN g USING (load_no)) SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM loads), 6) AS share FROM s GROUP BY 1",
    "routing_accuracy": Q.SQL["route_questions"].replace("SELECT qid, CASE WHEN blocked", ", rt AS (SELECT qid, CASE WHEN blocked", 1) + ") SELECT q_type, count(*) AS n, round(avg(CASE WHEN (q_type = '수치') = (route IN ('sql', 'hybrid')) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rt JOIN golden_sample100 USING (qid) GROUP BY 1",
    "p1_drift": _MOVES,
    "clean_effect": f"{C.TYPED}, c AS (SELECT doc_type, body, {C._clean_sql()} AS cleaned FROM ty WHERE length(coalesce(body, '')) > 0) SELECT doc_type, count(*) AS n_docs, round(avg((1 - length(cleaned) / length(body)) * 100), 6) AS removed_pct, {C._PCT(_noise('body', 'doc_type'))} AS noise_before, {C._PCT(_noise('cleaned', 'doc_type'))} AS noise_after FROM c GROUP BY 1",
    "chunk_quality": f"{C.TYPED}{C.TYPES} SELECT dt.doc_type, count(*) AS n_chunks, {C._PCT(C._CUT)} AS cut_pct, {C._PCT(C._SUSPECT)} AS table_pct, {C._PCT(_noise('text', 'dt.doc_type'))} AS noise_pct, "
    + C._PCT(r"regexp_matches(substr(coalesce(text, ''), 1, 120), '20[0-9][0-9][-./][0-9]{1,2}') OR (substr(coalesce(dt.title, ''), 1, 8) <> '' AND contains(substr(coalesce(text, ''), 1, 120), substr(coalesce(dt.title, ''), 1, 8)))")
    + " AS header_pct FROM chunks LEFT JOIN dt USING (doc_id) GROUP BY 1",
    "answer_context": f"""WITH {Q._JUDGED}, me AS (SELECT doc_id, min(doc_type) AS doc_type, min(org_name) AS org_name, min(published_at) AS published_at FROM raw WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT qid, string_agg('[' || rank || CASE WHEN me.doc_id IS NOT NULL THEN ' | ' || coalesce(doc_type, '') || ' | ' || coalesce(org_name, '') || ' | ' || coalesce(strftime(published_at, '%Y-%m-%d'), '날짜미상') ELSE '' END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ju LEFT JOIN me USING (doc_id) WHERE rank <= 6 GROUP BY 1""",
    "graph_plan": rf"""SELECT qid, CASE WHEN regexp_matches(coalesce(question, ''), '(매출|출하|재고|가격|ASP|수량|추이|합계|평균|월별|분기별|전월|전년)') THEN CASE WHEN length(question) > 25 THEN 'hybrid' ELSE 'sql' END ELSE 'rag' END AS route,
CASE WHEN (regexp_matches(coalesce(question, ''), '(대비|비교|차이|vs\.?|와 |과 |각각)') OR regexp_matches(coalesce(question, ''), '(그리고|및|또한|이유|배경|영향|전망|요약)')) AND len({_SPLIT}) > 1 THEN array_to_string(list_concat([question], list_slice({_SPLIT}, 1, 2)), ' // ') ELSE coalesce(question, '') END AS subs, {_WORDS8} || ' // ' || coalesce(question, '') AS rewritten FROM golden_sample100""",
    "period_extract": r"""WITH x AS (SELECT qid, coalesce(gold_text, '') AS t FROM golden_sample100), p AS (SELECT qid, nullif(regexp_extract(t, '(20[0-9]{2})[ \t]*년[ \t]*([1-4])[ \t]*분기', 1), '') AS qy, nullif(regexp_extract(t, '(20[0-9]{2})[ \t]*년[ \t]*([1-4])[ \t]*분기', 2), '') AS qk, nullif(regexp_extract(t, '([1-4])Q[ \t]*([0-9]{2})', 1), '') AS sk, nullif(regexp_extract(t, '([1-4])Q[ \t]*([0-9]{2})', 2), '') AS sy,
nullif(regexp_extract(t, '(20[0-9]{2})[ \t]*년[ \t]*([0-9]{1,2})[ \t]*월', 1), '') AS my, nullif(regexp_extract(t, '(20[0-9]{2})[ \t]*년[ \t]*([0-9]{1,2})[ \t]*월', 2), '') AS mm, nullif(regexp_extract(t, '(20[0-9]{2})[ \t]*년', 1), '') AS y FROM x), k AS (SELECT *, coalesce(qy, '20' || sy) AS yy, CAST(coalesce(qk, sk) AS INTEGER) AS k FROM p)
SELECT qid, CASE WHEN k IS NOT NULL THEN yy || lpad(CAST(k * 3 - 2 AS VARCHAR), 2, '0') WHEN my IS NOT NULL THEN my || lpad(CAST(CAST(mm AS INTEGER) AS VARCHAR), 2, '0') WHEN y IS NOT NULL THEN y || '01' END AS lo, CASE WHEN k IS NOT NULL THEN yy || lpad(CAST(k * 3 AS VARCHAR), 2, '0') WHEN my IS NOT NULL THEN my || lpad(CAST(CAST(mm AS INTEGER) AS VARCHAR), 2, '0') WHEN y IS NOT NULL THEN y || '12' END AS hi FROM k""",
}
