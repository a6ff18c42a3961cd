"""Queries of retrieval, evaluation, answers, runs, routing and the question graph, with the SQL they must equal.

Questions are the golden rows whose number is divisible by 50, against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.operators import checks as C
from millrace.operators import compare as P
from millrace.operators import evalsets as V
from millrace.operators import graph as G
from millrace.operators import metrics as M
from millrace.operators import retrieval as R
from millrace.operators import sqlroute as S
from millrace.plans.corpus import GRAMS3, KEYWORDS, STEMS, WORDS, _SENTS, doc_types
from millrace.session import cut, table
from millrace.streaming.ingest import windowed_counts

NUMBER = "cast(regexp_extract(qid, '[0-9]+', 0) as bigint)"


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden rows that are asked, with the elements an answer must have (the title)."""
    return table(spark, d, "golden_sample100").where(f"{NUMBER} % 50 = 0").withColumn("must_include", F.coalesce("title", F.lit("")))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus(table(spark, d, "chunks"))


def texts(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """``hits``, written once, with the documents and texts of the chunks; no other text is shuffled."""
    return R.with_texts(cut(hits, "hits"), docs(spark, d))


def bm25(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.bm25(docs(spark, d), golden(spark, d), k)


def sparse(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.sparse(docs(spark, d), golden(spark, d), k)


def dense_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vec"))
    return R.dense(v.withColumnRenamed("embedding", "vec"), asked, 10, "vec_id").select("qid", "vec_id", "rank", "score")


def dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Hits by the hashed vectors of questions and chunks."""
    return R.hashed_dense(docs(spark, d), golden(spark, d), k)


def self_search(spark: SparkSession, d: str) -> DataFrame:
    return dense_vectors(spark, d).where("rank = 1").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("qid") == F.col("vec_id").cast("string")).cast("double")), 6).alias("hit_rate"))


def fused(spark: SparkSession, d: str) -> DataFrame:
    found = R.searches(docs(spark, d), golden(spark, d), [("bm25", K.words), ("dense", None), ("sparse", None)], 50)
    return R.hybrid({name: cut(hits, f"hits-{name}") for name, hits in zip(("bm25", "dense", "sparse"), found, strict=True)}).select("qid", "chunk_id", "rank", "score", "via")


def reranked(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(cut(fused(spark, d), "fused"), docs(spark, d), golden(spark, d)).select("qid", "chunk_id", "doc_id", "rank", "rerank")


def capped(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_per_doc(R.rerank(cut(fused(spark, d), "fused"), docs(spark, d), golden(spark, d))).select("qid", "chunk_id", "doc_id", "rank")


def modes(spark: SparkSession, d: str) -> DataFrame:
    retriever = R.Retriever(table(spark, d, "chunks"))
    asked = golden(spark, d)
    lists = retriever.lists(asked)
    out = None
    for mode in R.MODES:
        hits = retriever.search(asked, mode, lists=lists).withColumn("mode", F.lit(mode))
        out = hits if out is None else out.unionByName(hits)
    return out.select("mode", "qid", "rank", "chunk_id", "doc_id", "text", F.round("score", 6).alias("score"), "via")


def mode_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = golden(spark, d)
    detail = M.retrieval_metrics(M.judge(cut(modes(spark, d), "modes"), g), g, ["mode"])
    return M.means(detail, ["mode"], ["mrr", "ap", "hit_1", "hit_5", "recall_5", "recall_10", "ndcg_10", "precision_5"])


def mode_pivot(spark: SparkSession, d: str) -> DataFrame:
    g = golden(spark, d)
    detail = M.retrieval_metrics(M.judge(cut(modes(spark, d), "modes"), g), g, ["mode"]).join(g.select("qid", "q_type"), "qid")
    return M.pivot_means(detail, "q_type", "mode", R.MODES, "hit_5")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Fusion constants against trade-offs of diversity; the parts' hits are shared, and texts are compared once a constant."""
    retriever, g = R.Retriever(table(spark, d, "chunks")), golden(spark, d)
    lists, lams = retriever.lists(g), (0.5, 0.7, 1.0)
    out = None
    for rrf_k in (20, 60):
        found = cut(retriever.diverse(g, lams, rrf_k=rrf_k, lists=lists), "swept")
        for lam in lams:
            detail = M.retrieval_metrics(M.judge(found.where(F.col("lam") == lam).drop("lam"), g), g)
            names = ["hit_1", "hit_5", "mrr", "ndcg_10", "recall_5"]
            row = detail.agg(*(F.round(F.avg(c), 3).alias(c) for c in names)).select(F.lit(rrf_k).alias("rrf_k"), F.lit(lam).alias("lam"), *names)
            out = row if out is None else out.unionByName(row)
    return out


def detail(spark: SparkSession, d: str) -> DataFrame:
    g = golden(spark, d)
    return M.retrieval_metrics(M.judge(texts(spark, d, bm25(spark, d)), g), g)


def by_type(spark: SparkSession, d: str) -> DataFrame:
    return M.means(detail(spark, d).join(golden(spark, d).select("qid", "q_type"), "qid"), ["q_type"], ["mrr", "hit_1", "hit_5", "recall_5", "ndcg_10"])


def failed_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = detail(spark, d).where("recall_5 = 0").join(golden(spark, d).select("qid", "question"), "qid")
    return rows.select("qid", "question", "mrr").orderBy("qid").limit(15)


def judged(spark: SparkSession, d: str) -> DataFrame:
    return M.judge(texts(spark, d, bm25(spark, d)), golden(spark, d)).select("qid", "chunk_id", "rank", "rel", "n_gold")


def answers(spark: SparkSession, d: str) -> DataFrame:
    return R.extractive_answers(golden(spark, d), texts(spark, d, bm25(spark, d)))


def _answered(spark: SparkSession, d: str) -> DataFrame:
    found = texts(spark, d, bm25(spark, d))
    hits = found.where("rank <= 6")
    ctx = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("contexts"))
    g = golden(spark, d).select("qid", "q_type", "question", "gold_text", "must_include")
    return g.join(R.extractive_answers(g, found), "qid").join(ctx, "qid", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate_answers(cut(_answered(spark, d), "answered"))


def faith(spark: SparkSession, d: str) -> DataFrame:
    return M.faithfulness(_answered(spark, d))


def metric_verdicts(spark: SparkSession, d: str) -> DataFrame:
    a = answer_metrics(spark, d)
    names = ["faithfulness", "answer_relevancy", "answer_correctness", "citation_accuracy", "refusal_ok", "context_recall"]
    row = a.agg(*(F.round(F.avg(c), 6).alias(c) for c in names))
    return M.against_catalog(row.unpivot([], names, "metric", "value"))


def gold_flags(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_sample100")
    return g.select("qid", *M.structure("gold_text"), F.size(M.citations("gold_text")).alias("n_citation"), M.refusal_ok("gold_text", F.col("q_type") == V.UNANSWERABLE).alias("refusal_ok"), M.element_coverage("title", "gold_text").alias("element_coverage"), F.round(K.coverage("question", "gold_text"), 6).alias("coverage"))


def context(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "raw").where("doc_id is not null").groupBy("doc_id").agg(F.min("doc_type").alias("doc_type"), F.min("org_name").alias("org_name"), F.min("published_at").alias("published_at"))
    return R.build_context(texts(spark, d, bm25(spark, d)), meta)


def known_items(spark: SparkSession, d: str) -> DataFrame:
    return V.known_items(docs(spark, d).where("doc_id <> ''"))


def title_queries(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "raw").where("doc_id is not null").groupBy("doc_id").agg(F.min("title").alias("title"))
    return V.title_queries(titles)


def screened(spark: SparkSession, d: str) -> DataFrame:
    return V.screen(golden(spark, d), texts(spark, d, bm25(spark, d)))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "raw").where("doc_id is not null").groupBy("doc_id").agg(F.min("published_at").alias("published_at"))
    meta = doc_types(spark, d).join(dates, "doc_id")
    return V.link_evidence(golden(spark, d), texts(spark, d, bm25(spark, d, 5)), meta)


def _judged_evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with the verdict that the golden ids give: the judge of a reviewer, in rule form."""
    g = golden(spark, d)
    hits = M.judge(texts(spark, d, bm25(spark, d, 5)), g)
    linked = hits.select("qid", F.col("rank").alias("cand_rank"), F.when(F.col("rel") == 1, V.FOUND).when(F.col("rank") == 1, V.HOLD).otherwise(V.NO_DOCUMENT).alias("verdict"), "doc_id", F.substring("text", 1, 60).alias("gold_text"))
    return V.apply_evidence(linked, g.select("qid", "question", "q_type"))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return V.sample_chunks(docs(spark, d), doc_types(spark, d))


def generated(spark: SparkSession, d: str) -> DataFrame:
    return V.rule_questions(sampled(spark, d).drop("title").join(doc_types(spark, d).select("doc_id", "title"), "doc_id", "left"))


def checked(spark: SparkSession, d: str) -> DataFrame:
    return V.self_check(cut(generated(spark, d), "generated"), docs(spark, d))


def mix(spark: SparkSession, d: str) -> DataFrame:
    return V.mix_report(table(spark, d, "golden_sample100"))


def smoke(spark: SparkSession, d: str) -> DataFrame:
    return V.smoke_template(golden(spark, d), texts(spark, d, bm25(spark, d)))


def review(spark: SparkSession, d: str) -> DataFrame:
    """A sheet whose verdicts follow the number of the question, reviewed and finished."""
    g = table(spark, d, "golden_sample100").withColumn("level", F.lit("mid"))
    sheet = V.to_review({"golden": g})
    no = F.expr(NUMBER) % 3
    sheet = sheet.withColumn("verdict", F.when(no == 0, "채택").when(no == 1, "수정 후 채택").otherwise("폐기")).withColumn("new_question", F.when(no == 1, F.concat(F.lit("수정: "), "question")).otherwise(" "))
    return V.from_review(sheet)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs over the loads: how many rows of each had a date."""
    raw = table(spark, d, "raw").where("load_no is not null")
    return raw.groupBy(F.format_string("RUN-%04d", "load_no").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("published_at").isNotNull().cast("double")), 6).alias("p"))


def _words_and_stems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g, c = golden(spark, d), docs(spark, d)
    score = lambda hits: M.retrieval_metrics(M.judge(R.with_texts(cut(hits, "hits"), c), g), g)
    by_words, by_stems = R.searches(c, g, [("bm25", K.words), ("bm25", K.stems)], 10)
    return score(by_words), score(by_stems)


def run_changes(spark: SparkSession, d: str) -> DataFrame:
    return P.changes(*_words_and_stems(spark, d), "mrr")


def run_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return P.mcnemar(*_words_and_stems(spark, d), "hit_5")


def presets(spark: SparkSession, d: str) -> DataFrame:
    return G.compare(list(G.PRESETS), golden(spark, d), R.Retriever(table(spark, d, "chunks")), golden(spark, d))[0]


def preset_delta(spark: SparkSession, d: str) -> DataFrame:
    return P.delta_vs_base(presets(spark, d), "v0_baseline", "preset", ("hit_5", "faithfulness", "answer_relevancy"))


def graph_plan(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_sample100")
    return g.select("qid", G.route().alias("route"), F.array_join(G.subqueries(), " // ").alias("subs"), F.array_join(G.rewritten(), " // ").alias("rewritten"))


def graph_grade(spark: SparkSession, d: str) -> DataFrame:
    met = texts(spark, d, bm25(spark, d)).join(golden(spark, d).select("qid", "question"), "qid")
    return met.select("qid", "chunk_id", G.grade().alias("kept"))


CATALOG = S.Catalog(
    [
        S.Metric("m001", "매출", ("매출액", "revenue"), "v_lineitem", "round(sum(l_extendedprice * (1 - l_discount)), 2)", "l_returnflag <> 'R'"),
        S.Metric("m002", "평균 단가", ("단가", "average price"), "v_lineitem", "round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4)"),
        S.Metric("m003", "주문액", ("주문 금액", "order value"), "v_orders", "round(sum(o_totalprice), 2)", "o_orderstatus = 'F'"),
    ],
    [S.Code("flag", "A", "회수", ("returned",), "l_returnflag"), S.Code("priority", "1-URGENT", "긴급", ("urgent",), "o_orderpriority")],
    [S.Allowed("v_lineitem", ("ym", "l_returnflag", "l_extendedprice", "l_discount", "l_quantity")), S.Allowed("v_orders"), S.Allowed("t_orders_raw", ("*",), "N")],
)


def metric_views(spark: SparkSession, d: str) -> None:
    table(spark, d, "lineitem").withColumn("ym", F.date_format("l_shipdate", "yyyyMM")).createOrReplaceTempView("v_lineitem")
    table(spark, d, "orders").withColumn("ym", F.date_format("o_orderdate", "yyyyMM")).createOrReplaceTempView("v_orders")
    table(spark, d, "orders").createOrReplaceTempView("t_orders_raw")


def metric(question: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        metric_views(spark, d)
        return S.run_sql(spark, S.make_sql(question, CATALOG), CATALOG)

    return run


def top_codes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = o.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return sums.orderBy(F.desc("value"), "n_name").limit(5)


def exec_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Which of the rule-made queries agree with hand-written ones."""
    metric_views(spark, d)
    cases = [
        ("c1", "2000년 매출은?", "SELECT ym, sum(l_extendedprice * (1 - l_discount)) AS x FROM v_lineitem WHERE l_returnflag <> 'R' AND ym BETWEEN '200001' AND '200012' GROUP BY ym"),
        ("c2", "2000년 주문액은?", "SELECT ym, sum(o_totalprice) AS x FROM v_orders WHERE ym LIKE '2000%' GROUP BY ym"),
        ("c3", "날씨는?", ""),
    ]
    rows = []
    for name, question, gold in cases:
        made = S.make_sql(question, CATALOG)
        ok = S.exec_match(S.run_sql(spark, made, CATALOG) if made else None, spark.sql(gold) if gold else None)
        rows.append((name, bool(made), ok))
    return spark.createDataFrame(rows, "case_id string, made boolean, matched boolean")


def sql_scores(spark: SparkSession, d: str) -> DataFrame:
    """Routing, valid SQL and equal results over a small set of questions with hand-written queries."""
    metric_views(spark, d)
    cases = [
        ("2000년 매출은?", "sql", "SELECT ym, sum(l_extendedprice * (1 - l_discount)) AS x FROM v_lineitem WHERE l_returnflag <> 'R' AND ym BETWEEN '200001' AND '200012' GROUP BY ym"),
        ("2000년 주문액은?", "sql", "SELECT ym, sum(o_totalprice) AS x FROM v_orders WHERE ym LIKE '2000%' GROUP BY ym"),
        ("재고가 왜 늘었는지 배경을 알려 달라", "rag", ""), ("직원 연봉은?", "none", ""),
    ]
    return S.sql_scores(spark, cases, CATALOG)


def guard_cases(spark: SparkSession, d: str) -> DataFrame:
    """What the guard says of queries that must and must not pass."""
    metric_views(spark, d)
    cases = {
        "valid": "SELECT ym, sum(l_quantity) AS q FROM v_lineitem GROUP BY ym", "cte": "WITH a AS (SELECT ym FROM v_orders) SELECT count(*) FROM a", "literal": "SELECT 'drop table x' AS s, ym FROM v_orders", "delete": "DELETE FROM v_orders WHERE ym = '1'",
        "drop": "DROP TABLE v_orders", "two": "SELECT 1; SELECT 2", "blocked": "SELECT * FROM t_orders_raw", "comma": "SELECT v_orders.ym FROM v_orders, t_orders_raw", "subquery": "SELECT ym FROM v_orders WHERE o_orderkey IN (SELECT o_orderkey FROM t_orders_raw)",
        "column": "SELECT l_tax FROM v_lineitem", "star": "SELECT count(*) AS n FROM (SELECT * FROM v_lineitem)", "empty": " ",
    }
    return spark.createDataFrame([(k, S.validate(spark, q, CATALOG).ok) for k, q in cases.items()], "case_id string, allowed boolean")


QUERIES = {
    "bm25_topk": bm25, "sparse_topk": sparse, "dense_topk": dense_vectors, "self_search": self_search, "hashed_topk": dense, "hybrid_rrf": fused, "rerank_overlap": reranked, "cap_per_doc": capped, "search_modes": modes, "mode_metrics": mode_metrics, "mode_pivot": mode_pivot, "parameter_sweep": sweep,
    "hashed_embeddings": lambda s, d: R.hashed_terms(docs(s, d), "chunk_id", "text").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_dims"), F.round(F.sum(F.col("w") * F.col("dim")), 6).alias("checksum")),
    "retrieval_detail": detail, "metrics_by_type": by_type, "failed_questions": failed_questions, "judged_hits": judged, "extractive_answers": answers, "answer_metrics": answer_metrics, "faithfulness": faith, "metric_verdicts": metric_verdicts,
    "gold_text_flags": gold_flags, "answer_context": context, "known_item_set": known_items, "title_queries": title_queries, "screened_set": screened, "uniqueness": lambda s, d: V.uniqueness(texts(s, d, bm25(s, d))), "evidence_link": evidence,
    "evidence_golden": lambda s, d: _judged_evidence(s, d)[0].select("qid", "gold_doc_ids", "gold_text"), "evidence_coverage": lambda s, d: V.coverage_report(_judged_evidence(s, d)[1]), "sampled_chunks": lambda s, d: sampled(s, d).select("doc_type", "chunk_id", "has_num"),
    "generated_questions": generated, "self_check": checked, "checked_set": lambda s, d: V.apply_check(cut(generated(s, d), "generated"), checked(s, d)), "unanswerable": lambda s, d: V.unanswerable(s), "mix_report": mix, "smoke_template": smoke, "smoke_summary": lambda s, d: C.value_counts(smoke(s, d).where("rank = 1"), "q_type"), "reviewed_set": review,
    "run_intervals": lambda s, d: P.with_interval(runs(s, d)), "run_pair": lambda s, d: P.two_runs(runs(s, d), "RUN-0001", "RUN-0002"), "run_changes": run_changes, "run_mcnemar": run_mcnemar,
    "run_delta_base": lambda s, d: P.delta_vs_base(runs(s, d), "RUN-0001", "run_id", ("p",)), "run_delta_previous": lambda s, d: P.delta_vs_previous(runs(s, d), "run_id", "p"), "preset_summary": presets, "preset_delta": preset_delta, "graph_plan": graph_plan, "graph_grade": graph_grade,
    "route_questions": lambda s, d: S.route(table(s, d, "golden_sample100"), CATALOG), "alias_hits": lambda s, d: S.alias_hits(table(s, d, "golden_sample100"), CATALOG), "period_extract": lambda s, d: table(s, d, "golden_sample100").select("qid", S.period_of("gold_text").alias("p")).select("qid", "p.lo", "p.hi"),
    "metric_revenue": metric("2000년 매출은?"), "metric_avg_price": metric("월별 평균 단가 추이"), "metric_order_value": metric("긴급 주문액 합계"), "metric_top_nations": top_codes, "exec_match_matrix": exec_matrix, "sql_scores": sql_scores, "guard_cases": guard_cases,
    "daily_event_counts": lambda s, d: windowed_counts(table(s, d, "events")),
}

_G = "gq AS (SELECT *, coalesce(title, '') AS must_include FROM golden_sample100 WHERE CAST(regexp_extract(qid, '[0-9]+') AS BIGINT) % 50 = 0), dc AS (SELECT chunk_id, min(coalesce(doc_id, '')) AS doc_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"


def _bm25(k: int, name: str = "bm", words=WORDS) -> str:
    return f"""{name}_l AS (SELECT chunk_id, {words('text')} AS w FROM dc), {name}_s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM {name}_l),
{name}_p AS (SELECT token, chunk_id, ln, count(*) AS tf FROM (SELECT chunk_id, len(w) AS ln, unnest(w) AS token FROM {name}_l) GROUP BY ALL), {name}_q AS (SELECT qid, unnest(list_distinct({words('question')})) AS token FROM gq),
{name}_d AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_c AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * ln / av))), 6) AS score FROM {name}_q JOIN {name}_d USING (token) JOIN {name}_p USING (token), {name}_s GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {name}_c) WHERE rank <= {k})"""


def _dense(k: int) -> str:
    """Signed feature hashing of questions and chunks into 256 dimensions, and every pair's dot product."""
    vector = lambda name, key, text, source: f"""{name}_f AS (SELECT {key}, unnest(list_concat({STEMS(text)}, CASE WHEN length(lower(coalesce({text}, ''))) < 3 THEN [] ELSE list_transform(range(1, length(lower({text})) - 1), lambda i: substr(lower({text}), i, 3)) END)) AS f FROM {source}),
{name}_h AS (SELECT {key}, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h FROM {name}_f), {name}_v AS (SELECT {key}, h % 256 AS dim, CAST(sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM {name}_h GROUP BY 1, 2), {name}_w AS (SELECT {key}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS w FROM {name}_v WHERE v <> 0)"""  # noqa: E731
    return f"""{vector('dq', 'qid', 'question', 'gq')}, {vector('dd', 'chunk_id', 'text', 'dc')}, dn_s AS (SELECT qid, chunk_id, sum(dq_w.w * dd_w.w) AS s FROM dq_w JOIN dd_w USING (dim) GROUP BY 1, 2),
dn AS (SELECT * FROM (SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT gq.qid, dc.chunk_id, coalesce(round(s, 6), 0.0) + 0.0 AS score FROM gq CROSS JOIN dc LEFT JOIN dn_s ON dn_s.qid = gq.qid AND dn_s.chunk_id = dc.chunk_id)) WHERE rank <= {k})"""


def _sparse(k: int) -> str:
    term = "CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT)"
    return f"""sp_d AS (SELECT chunk_id, {term} AS term, count(*) AS tf FROM (SELECT chunk_id, unnest({STEMS('text')}) AS w FROM dc) GROUP BY ALL), sp_q AS (SELECT qid, {term} AS term, count(*) AS qtf FROM (SELECT qid, unnest({STEMS('question')}) AS w FROM gq) GROUP BY ALL),
sp AS (SELECT * FROM (SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT qid, chunk_id, CAST(sum(qtf * tf) AS DOUBLE) AS score FROM sp_q JOIN sp_d USING (term) GROUP BY 1, 2)) WHERE rank <= {k})"""


_FUSED = f"""{_G}, {_bm25(50)}, {_dense(50)}, {_sparse(50)}, fu AS (SELECT * FROM (SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM
(SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, chunk_id, rank FROM bm UNION ALL SELECT qid, chunk_id, rank FROM dn UNION ALL SELECT qid, chunk_id, rank FROM sp) GROUP BY 1, 2)) WHERE rank <= 50),
vi AS (SELECT qid, 'rrf(' || string_agg(p, '+' ORDER BY p) || ')' AS via FROM (SELECT DISTINCT qid, 'bm25' AS p FROM bm UNION ALL SELECT DISTINCT qid, 'dense' FROM dn UNION ALL SELECT DISTINCT qid, 'sparse' FROM sp) GROUP BY 1)"""
_SHARE = lambda a, b, e: f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE {e} END)"
_RERANKED = f"""{_FUSED}, rr AS (SELECT qid, chunk_id, doc_id, rerank, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, former) AS INTEGER) AS rank FROM
(SELECT qid, chunk_id, dc.doc_id, fu.rank AS former, round({_SHARE(f"list_distinct({STEMS('question')})", f"list_distinct({STEMS('dc.text')})", '0.0')}, 6) AS rerank FROM fu JOIN dc USING (chunk_id) JOIN gq USING (qid)))"""
_IDS = "list_filter(list_transform(string_split(coalesce(gold_doc_ids, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
_JUDGED = f"""{_G}, {_bm25(10)}, ju AS (SELECT qid, chunk_id, dc.doc_id, dc.text, rank, score, CAST(coalesce(list_contains({_IDS}, dc.doc_id) AND (coalesce(gold_text, '') = '' OR {_SHARE(GRAMS3('gold_text'), GRAMS3('dc.text'), '1.0')} >= 0.5), false) AS INTEGER) AS rel, CAST(len(list_distinct({_IDS})) AS INTEGER) AS n_gold FROM bm JOIN dc USING (chunk_id) JOIN gq USING (qid))"""


def _detail(judged_name: str = "ju") -> str:
    ks = (1, 3, 5, 10)
    pick = ", ".join(f"coalesce(max(CASE WHEN rank <= {k} THEN rel ELSE 0 END), 0) AS hit_{k}, round(count(DISTINCT CASE WHEN rank <= {k} AND rel = 1 THEN doc_id END) / max(ng), 6) AS recall_{k}, round(coalesce(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0.0 END), 0.0) / max(list_sum(list_transform(range(1, least({k}, greatest(ng, 1)) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_{k}, round(coalesce(sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END), 0) / {k}, 6) AS precision_{k}" for k in ks)
    return f"""b AS (SELECT qid, len(list_distinct({_IDS})) AS ng FROM gq WHERE len({_IDS}) > 0), jn AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM {judged_name}),
de AS (SELECT qid, min(CASE WHEN rel = 1 THEN rank END) AS first_hit_rank, round(coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0.0), 6) AS mrr, round(coalesce(sum(CASE WHEN rel = 1 THEN hits / rank END) / nullif(sum(rel), 0), 0.0), 6) AS ap, {pick} FROM b LEFT JOIN jn USING (qid) GROUP BY qid)"""


_NAMED = "', '".join
_ANSWERS = f"""{_JUDGED}, se AS (SELECT qid, rank, s, pos, round({_SHARE(KEYWORDS('question'), KEYWORDS('s'), '0.0')}, 6) AS score FROM (SELECT qid, rank, question, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT ju.qid, rank, question, {_SENTS('ju.text', 15)} AS l FROM ju JOIN gq USING (qid) WHERE rank <= 6))),
s2 AS (SELECT * FROM se WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid, substr(s, 1, 30) ORDER BY score DESC, rank, pos) = 1), s3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos) AS i FROM s2),
an AS (SELECT gq.qid, coalesce(string_agg(s || ' [' || rank || ']', ' ' ORDER BY i), '확인된 자료 없음') AS answer FROM gq LEFT JOIN (SELECT * FROM s3 WHERE i <= 3) s3 USING (qid) GROUP BY 1)"""
_FAITH = f"""{_ANSWERS}, cx AS (SELECT qid, list(text ORDER BY rank) AS contexts FROM ju WHERE rank <= 6 GROUP BY 1), fs AS (SELECT qid, s, contexts FROM (SELECT an.qid, unnest({_SENTS('answer', 10)}) AS s, contexts FROM an LEFT JOIN cx USING (qid))),
fb AS (SELECT qid, coalesce(list_max(list_transform(contexts, lambda c: {_SHARE(GRAMS3('s'), GRAMS3('c'), '0.0')})), 0.0) AS best FROM fs), ff AS (SELECT qid, round(avg(CASE WHEN best >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS faithfulness FROM fb GROUP BY 1)"""
_PAT = {k: v.replace(r"\s", r"[ \t\n\x0B\f\r]") for k, v in M.PATTERNS.items()}
_RUNS = "ru AS (SELECT 'RUN-' || lpad(CAST(load_no AS VARCHAR), 4, '0') AS run_id, count(*) AS n, round(avg(CASE WHEN published_at IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS p FROM raw WHERE load_no IS NOT NULL GROUP BY 1)"
_TWO = f"{_G}, {_bm25(10, 'b1')}, {_bm25(10, 'b2', STEMS)}, " + ", ".join(
    f"j{i} AS (SELECT qid, rank, CAST(coalesce(list_contains({_IDS}, dc.doc_id) AND (coalesce(gold_text, '') = '' OR {_SHARE(GRAMS3('gold_text'), GRAMS3('dc.text'), '1.0')} >= 0.5), false) AS INTEGER) AS rel FROM b{i} JOIN dc USING (chunk_id) JOIN gq USING (qid)), m{i} AS (SELECT gq.qid, round(coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0.0), 6) AS mrr, coalesce(max(CASE WHEN rank <= 5 THEN rel ELSE 0 END), 0) AS hit_5 FROM gq LEFT JOIN j{i} USING (qid) WHERE len({_IDS}) > 0 GROUP BY 1)"
    for i in (1, 2)
)
_cnt = lambda c, ws: " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in ws)
_DT = "dt AS (SELECT doc_id, min(code) AS doc_type, min(title) AS title, min(published_at) AS published_at FROM raw LEFT JOIN (SELECT a, min(code) AS code FROM (SELECT code, upper(trim(unnest(list_prepend(code, string_split(coalesce(aliases, ''), ';'))))) AS a FROM source_types) WHERE a <> '' GROUP BY 1) ON a = upper(trim(raw.doc_type)) WHERE doc_id IS NOT NULL GROUP BY 1)"
_NUM = r"[0-9][0-9,\.]*[ \t\n\x0B\f\r]*(?:%|원|달러|억|조|배|EB|TB|GB|bp|나노|단)"
_FIT = r"lambda x: length(x) <= 160 AND regexp_matches(x, '[\p{L}\p{N}_]') AND NOT regexp_matches(x, '^(>|-----|#|\[)') AND NOT contains(x, '이전 메일') AND NOT contains(x, '|') AND NOT regexp_matches(x, '^[ \t\n\x0B\f\r]*[0-9.]+[ \t\n\x0B\f\r]') AND length(x) - length(replace(x, '.', '')) <= 6 AND regexp_matches(x, '(다|요|음|함|임|됨|것|정|표)[.!?]?$') AND len(regexp_extract_all(x, '[가-힣]{2,}')) >= 3"
_UNIQ = r"([A-Z]{2,}[-_]?[0-9]+|[0-9][0-9,\.]{2,}[ \t\n\x0B\f\r]*(?:%|억|조|EB|TB|GB|달러|원)?|[A-Z]{3,})"

SQL = {
    "bm25_topk": f"WITH {_G}, {_bm25(10)} SELECT * FROM bm",
    "sparse_topk": f"WITH {_G}, {_sparse(10)} SELECT * FROM sp",
    "dense_topk": "WITH s AS (SELECT CAST(q.vec_id AS VARCHAR) AS qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "self_search": "WITH s AS (SELECT q.vec_id AS q, v.vec_id AS v, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, v) = 1) SELECT count(*) AS n, round(avg(CASE WHEN q = v THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM r",
    "hashed_topk": f"WITH {_G}, {_dense(10)} SELECT * FROM dn",
    "hybrid_rrf": f"WITH {_FUSED} SELECT qid, chunk_id, rank, score, via FROM fu JOIN vi USING (qid)",
    "rerank_overlap": f"WITH {_RERANKED} SELECT * FROM rr",
    "cap_per_doc": f"WITH {_RERANKED}, k AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) <= 3) SELECT qid, chunk_id, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank FROM k",
    "hashed_embeddings": f"""WITH {_G}, f AS (SELECT chunk_id, unnest(list_concat({STEMS('text')}, CASE WHEN length(lower(text)) < 3 THEN [] ELSE list_transform(range(1, length(lower(text)) - 1), lambda i: substr(lower(text), i, 3)) END)) AS f FROM dc),
h AS (SELECT chunk_id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h FROM f), v AS (SELECT chunk_id, CAST(h % 256 AS INTEGER) AS dim, CAST(sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM h GROUP BY 1, 2 HAVING sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END) <> 0)
SELECT chunk_id, count(*) AS n_dims, round(sum(v * dim) / sqrt(sum(v * v)), 6) AS checksum FROM v GROUP BY 1""",
    "judged_hits": f"WITH {_JUDGED} SELECT qid, chunk_id, rank, rel, n_gold FROM ju",
    "retrieval_detail": f"WITH {_JUDGED}, {_detail()} SELECT * FROM de",
    "metrics_by_type": f"WITH {_JUDGED}, {_detail()} SELECT q_type, " + ", ".join(f"round(avg({c}), 3) AS {c}" for c in ("mrr", "hit_1", "hit_5", "recall_5", "ndcg_10")) + " FROM de JOIN gq USING (qid) GROUP BY 1",
    "failed_questions": f"WITH {_JUDGED}, {_detail()} SELECT qid, question, mrr FROM de JOIN gq USING (qid) WHERE recall_5 = 0 ORDER BY qid LIMIT 15",
    "extractive_answers": f"WITH {_ANSWERS} SELECT * FROM an",
    "faithfulness": f"WITH {_FAITH} SELECT gq.qid, faithfulness FROM gq LEFT JOIN ff USING (qid)",
    "gold_text_flags": "SELECT qid, " + ", ".join(f"regexp_matches(coalesce(gold_text, ''), '{p}') AS {n}" for n, p in _PAT.items()) + f""", CAST(len(regexp_extract_all(coalesce(gold_text, ''), '{_PAT["has_citation"]}')) AS INTEGER) AS n_citation, CAST(regexp_matches(coalesce(gold_text, ''), '{_PAT["refused"]}') = (q_type = '답없음') AS INTEGER) AS refusal_ok,
(SELECT CASE WHEN len(es) > 0 THEN round(len(list_filter(es, lambda e: greatest({_SHARE(GRAMS3("regexp_replace(e, '\\([^)]*\\)', '', 'g')"), GRAMS3('gold_text'), '0.0')}, list_transform([list_filter(regexp_extract_all(regexp_replace(e, '\\([^)]*\\)', '', 'g'), '[가-힣A-Za-z0-9]{{2,}}'), lambda w: w NOT IN ('{_NAMED(K.ELEMENT_STOP_WORDS)}'))], lambda ks: CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda w: contains(coalesce(gold_text, ''), w))) / len(ks) ELSE 0.0 END)[1]) >= 0.25)) / len(es), 6) END FROM (SELECT list_filter(list_transform(string_split(coalesce(title, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS es)) AS element_coverage,
round({_SHARE(GRAMS3('question'), GRAMS3('gold_text'), '0.0')}, 6) AS coverage FROM golden_sample100""",
    "known_item_set": f"""WITH {_G}, s AS (SELECT doc_id, chunk_id, unnest(list_filter({_SENTS('text', 25)}, {_FIT})) AS s FROM dc WHERE length(text) >= 80 AND doc_id <> ''), p AS (SELECT *, md5('7|' || doc_id || '|' || chunk_id || '|' || s) AS o FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('7|' || doc_id || '|' || chunk_id || '|' || s), chunk_id, s) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY o, doc_id) AS i FROM p) SELECT 'K' || lpad(CAST(i AS VARCHAR), 4, '0') AS qid, s AS question, 'known-item' AS q_type, CASE WHEN regexp_matches(s, '{_UNIQ}') THEN 'easy' ELSE 'mid' END AS level, doc_id AS gold_doc_ids, s AS gold_text, chunk_id AS src_chunk FROM n WHERE i <= 200""",
    "title_queries": "WITH t AS (SELECT doc_id, min(title) AS title FROM raw WHERE doc_id IS NOT NULL GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || doc_id || '|' || title), doc_id, title) AS i FROM t WHERE length(title) >= 8) SELECT 'T' || lpad(CAST(i AS VARCHAR), 4, '0') AS qid, title AS question, 'title' AS q_type, 'easy' AS level, doc_id AS gold_doc_ids, '' AS gold_text, '' AS src_chunk FROM n WHERE i <= 200",
    "screened_set": f"WITH {_JUDGED} SELECT gq.qid, min(rank) IS NOT NULL AS found, min(rank) AS first_rank FROM gq LEFT JOIN ju ON ju.qid = gq.qid AND list_contains({_IDS.replace('gold_doc_ids', 'gq.gold_doc_ids')}, ju.doc_id) GROUP BY 1",
    "uniqueness": f"WITH {_JUDGED} SELECT a.qid, round(avg(CASE WHEN a.doc_id = b.doc_id THEN 1.0 ELSE 0.0 END), 6) AS uniqueness FROM ju a JOIN ju b ON a.qid = b.qid AND b.rank = 1 WHERE a.rank <= 5 GROUP BY 1",
    "evidence_link": f"""WITH {_JUDGED}, {_DT} SELECT gq.qid, CASE WHEN coalesce(rank, 1) = 1 THEN question ELSE '' END AS question, CASE WHEN coalesce(rank, 1) = 1 THEN q_type ELSE '' END AS q_type, coalesce(rank, 0) AS cand_rank, coalesce(h.doc_id, '') AS cand_doc_id, coalesce(dt.doc_type, '') AS cand_doc_type, coalesce(strftime(dt.published_at, '%Y-%m-%d'), '') AS cand_date, coalesce(substr(text, 1, 300), '(검색 결과 없음)') AS cand_text, round(score, 4) AS score
FROM gq LEFT JOIN (SELECT * FROM ju WHERE rank <= 5) h USING (qid) LEFT JOIN dt ON dt.doc_id = h.doc_id""",
    "evidence_golden": f"WITH {_JUDGED} SELECT qid, string_agg(DISTINCT doc_id, ';' ORDER BY doc_id) AS gold_doc_ids, arg_min(substr(text, 1, 60), rank) AS gold_text FROM ju WHERE rank <= 5 AND rel = 1 GROUP BY 1",
    "evidence_coverage": f"WITH {_JUDGED}, st AS (SELECT qid, CASE WHEN max(rel) = 1 THEN 'f' WHEN max(CAST(rel = 0 AND rank > 1 AS INT)) = 1 THEN 'n' ELSE 'h' END AS s FROM ju WHERE rank <= 5 GROUP BY 1) SELECT count(*) AS n_questions, count(*) FILTER (s = 'f') AS n_found, count(*) FILTER (s = 'n') AS n_no_document, count(*) FILTER (s = 'h') AS n_hold, round(coalesce(count(*) FILTER (s = 'f') / nullif(count(*), 0), 0.0), 3) AS found_rate FROM st",
    "sampled_chunks": f"WITH {_G}, {_DT} SELECT doc_type, chunk_id, has_num FROM (SELECT dt.doc_type, chunk_id, regexp_matches(text, '{_NUM}') AS has_num FROM dc LEFT JOIN dt USING (doc_id) WHERE length(text) >= 150) QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY has_num DESC, chunk_id) <= 10",
    "mix_report": "WITH t(q_type, part) AS (VALUES ('사실', 0.30), ('수치', 0.25), ('종합', 0.15), ('기간', 0.10), ('비교', 0.10), ('답없음', 0.10)), n AS (SELECT count(*) AS n FROM golden_sample100), c AS (SELECT q_type, count(*) AS actual FROM golden_sample100 GROUP BY 1) SELECT q_type, round(CAST(part AS DOUBLE) * n, 6) AS wanted, coalesce(actual, 0) AS actual, round(coalesce(actual, 0) / n, 6) AS share, CASE WHEN coalesce(actual, 0) < part * n * 0.6 THEN '부족' WHEN coalesce(actual, 0) > part * n * 1.5 THEN '과다' ELSE '적정' END AS verdict FROM t LEFT JOIN c USING (q_type), n",
    "smoke_template": f"WITH {_JUDGED} SELECT qid, q_type, CASE WHEN rank = 1 THEN question ELSE '' END AS question, rank, doc_id, substr(text, 1, 300) AS text, '' AS answer, CASE WHEN rank = 1 THEN '' END AS search_verdict, CASE WHEN rank = 1 THEN '' END AS answer_verdict, CASE WHEN rank = 1 THEN '' END AS failure FROM ju JOIN gq USING (qid)",
    "smoke_summary": f"WITH {_JUDGED} SELECT coalesce(nullif(q_type, ''), '(blank)') AS value, count(*) AS n FROM ju JOIN gq USING (qid) WHERE rank = 1 GROUP BY 1",
    "reviewed_set": "WITH g AS (SELECT *, CAST(regexp_extract(qid, '[0-9]+') AS BIGINT) % 3 AS no FROM golden_sample100) SELECT qid, CASE WHEN no = 1 THEN '수정: ' || question ELSE question END AS question, '사실' AS q_type, gold_doc_ids, gold_text, 'mid' AS level, '자동-golden' AS origin, '' AS memo FROM g WHERE no < 2",
    "run_intervals": f"WITH {_RUNS} SELECT run_id, n, p, round(1.96 * sqrt(p * (1 - p) / n), 6) AS half_width, CASE WHEN p >= 0.8 THEN 'pass' ELSE 'fail' END AS verdict FROM ru",
    "run_pair": f"WITH {_RUNS}, x AS (SELECT b.p - a.p AS diff, 1.96 * sqrt(a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n) AS error FROM ru a, ru b WHERE a.run_id = 'RUN-0001' AND b.run_id = 'RUN-0002') SELECT round(diff, 6) AS diff, round(error, 6) AS error, CASE WHEN abs(diff) > error THEN 'significant' ELSE 'hold' END AS verdict FROM x",
    "run_changes": f"WITH {_TWO} SELECT qid, m1.mrr AS before, m2.mrr AS after, CASE WHEN m2.mrr > m1.mrr THEN 'improved' WHEN m2.mrr < m1.mrr THEN 'regressed' ELSE 'same' END AS change FROM m1 JOIN m2 USING (qid)",
    "run_mcnemar": f"WITH {_TWO}, c AS (SELECT count(*) FILTER (m1.hit_5 = 0 AND m2.hit_5 > 0) AS gained, count(*) FILTER (m1.hit_5 > 0 AND m2.hit_5 = 0) AS lost FROM m1 JOIN m2 USING (qid)), x AS (SELECT *, CASE WHEN gained + lost > 0 THEN pow(greatest(abs(gained - lost) - 1, 0), 2) / (gained + lost) ELSE 0.0 END AS chi FROM c) SELECT gained, lost, round(chi, 6) AS chi2, CASE WHEN chi > 3.84 THEN 'significant' ELSE 'hold' END AS verdict FROM x",
    "run_delta_base": f"WITH {_RUNS} SELECT a.run_id, CASE WHEN a.run_id = 'RUN-0001' THEN 'base' ELSE '' END AS base, round(a.p - b.p, 3) AS d_p FROM ru a, ru b WHERE b.run_id = 'RUN-0001'",
    "run_delta_previous": f"WITH {_RUNS}, l AS (SELECT run_id, p, round(p - lag(p) OVER (ORDER BY run_id), 6) AS delta FROM ru) SELECT run_id, p, delta, CASE WHEN delta IS NULL THEN '-' WHEN delta > 0.03 THEN 'up' WHEN delta < -0.03 THEN 'down' ELSE 'flat' END AS trend FROM l",
    "graph_grade": f"WITH {_JUDGED} SELECT qid, chunk_id, {_SHARE(GRAMS3('question'), GRAMS3('ju.text'), '0.0')} >= 0.06 OR {_SHARE(KEYWORDS('question'), KEYWORDS('ju.text'), '0.0')} >= 0.25 AS kept FROM ju JOIN gq USING (qid)",
    "route_questions": f"""WITH f AS (SELECT qid, {_cnt("coalesce(question, '')", S.NUMBER_WORDS)} AS n_number, {_cnt("coalesce(question, '')", S.TEXT_WORDS)} AS n_text, {' OR '.join(f"contains(lower(coalesce(question, '')), '{a}')" for a, (k, _) in CATALOG.alias_index().items() if k == 'metric')} AS has_metric, regexp_matches(coalesce(question, ''), '{S.PERIOD_WORDS.replace(chr(92) + "s", "[ ]")}') AS has_period, ({_cnt("coalesce(question, '')", S.BLOCKED_WORDS)}) > 0 AS blocked FROM golden_sample100)
SELECT qid, CASE WHEN blocked THEN 'none' WHEN has_metric AND n_text >= 1 THEN 'hybrid' WHEN has_metric OR (n_number >= 2 AND has_period) THEN 'sql' ELSE 'rag' END AS route, CASE WHEN blocked THEN 'sensitive' WHEN has_metric AND n_text >= 1 THEN 'metric and explanation' WHEN has_metric OR (n_number >= 2 AND has_period) THEN 'metric or figures' WHEN n_text >= 1 OR n_number = 0 THEN 'text' ELSE 'default' END AS reason, n_number, n_text, has_metric, has_period FROM f""",
    "alias_hits": "SELECT DISTINCT qid, kind, id FROM golden_sample100, (VALUES " + ", ".join(f"('{a}', '{k}', '{i}')" for a, (k, i) in CATALOG.alias_index().items()) + ") c(alias, kind, id) WHERE contains(lower(coalesce(question, '')), alias)",
    "metric_revenue": "SELECT strftime(l_shipdate, '%Y%m') AS ym, round(sum(l_extendedprice * (1 - l_discount)), 2) AS m001 FROM lineitem WHERE l_returnflag <> 'R' AND strftime(l_shipdate, '%Y%m') BETWEEN '200001' AND '200012' GROUP BY 1",
    "metric_avg_price": "SELECT strftime(l_shipdate, '%Y%m') AS ym, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS m002 FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 200",
    "metric_order_value": "SELECT strftime(o_orderdate, '%Y%m') AS ym, round(sum(o_totalprice), 2) AS m003 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY 1 LIMIT 200",
    "metric_top_nations": "SELECT n_name, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "daily_event_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}


def _elements(must: str, answer: str) -> str:
    """Share of the required elements that an answer covers, null without elements."""
    bare = "regexp_replace(e, '\\([^)]*\\)', '', 'g')"
    held = f"list_transform([list_filter(regexp_extract_all({bare}, '[가-힣A-Za-z0-9]{{2,}}'), lambda w: w NOT IN ('{_NAMED(K.ELEMENT_STOP_WORDS)}'))], lambda ks: CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda w: contains(coalesce({answer}, ''), w))) / len(ks) ELSE 0.0 END)[1]"
    return f"(SELECT CASE WHEN len(es) > 0 THEN round(len(list_filter(es, lambda e: greatest({_SHARE(GRAMS3(bare), GRAMS3(answer), '0.0')}, {held}) >= 0.25)) / len(es), 6) END FROM (SELECT list_filter(list_transform(string_split(coalesce({must}, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS es))"


_CITED = f"regexp_extract_all(answer, '{_PAT['has_citation']}', 1)"
_EVALUATED = f"""{_FAITH}, aa AS (SELECT gq.qid, q_type, question, answer, must_include, gold_text, coalesce(contexts, []) AS contexts FROM gq JOIN an USING (qid) LEFT JOIN cx USING (qid)),
em AS (SELECT qid, q_type, round(greatest({_SHARE(GRAMS3('question'), GRAMS3('answer'), '0.0')}, {_SHARE(GRAMS3('answer'), GRAMS3('question'), '0.0')}), 6) AS answer_relevancy, {_elements('must_include', 'answer')} AS answer_correctness,
CASE WHEN len({_CITED}) > 0 THEN round(len(list_filter({_CITED}, lambda c: c = 'DB' OR coalesce(TRY_CAST(c AS INTEGER) BETWEEN 1 AND len(contexts), false))) / len({_CITED}), 6) END AS citation_accuracy, CAST(len({_CITED}) AS INTEGER) AS n_citation,
CASE WHEN trim(coalesce(gold_text, '')) <> '' THEN round({_SHARE(GRAMS3('gold_text'), GRAMS3("array_to_string(contexts, ' ')"), '0.0')}, 6) END AS context_recall, CAST(regexp_matches(answer, '{_PAT["refused"]}') = coalesce(q_type = '답없음', false) AS INTEGER) AS refusal_ok,
""" + ", ".join(f"regexp_matches(answer, '{x}') AS {n}" for n, x in _PAT.items()) + ", faithfulness FROM aa LEFT JOIN ff USING (qid))"
_GENERATED = f"""{_G}, {_DT}, sc AS (SELECT dt.doc_type, dc.doc_id, chunk_id, text, title FROM dc LEFT JOIN dt USING (doc_id) WHERE length(text) >= 150 QUALIFY row_number() OVER (PARTITION BY dt.doc_type ORDER BY regexp_matches(text, '{_NUM}') DESC, chunk_id) <= 10),
ev AS (SELECT *, coalesce(list_filter(ss, lambda s: regexp_matches(s, '{_NUM}'))[1], ss[1]) AS ev FROM (SELECT *, {_SENTS('text', 26)} AS ss FROM sc)),
ge AS (SELECT 'G-' || chunk_id AS qid, coalesce(nullif(substr(coalesce(title, ''), 1, 40), ''), doc_type, '') || ' 자료에서 ' || regexp_replace(array_to_string(list_slice(regexp_extract_all(ev, '[가-힣A-Za-z0-9]{{2,}}'), 1, 4), ' '), '[는은이가을를][ \t\n\x0B\f\r]*$', '') || ' 관련 수치는?' AS question,
substr(ev, 1, 160) AS gold_answer, substr(ev, 1, 200) AS gold_text, CASE WHEN regexp_matches(ev, '{_NUM}') THEN '수치' ELSE '사실' END AS q_type, 'mid' AS level, doc_id AS gold_doc_ids, chunk_id AS src_chunk, doc_type FROM ev WHERE ev IS NOT NULL)"""
_KEY = r"substr(regexp_replace(coalesce(question, ''), '[^\p{L}\p{N}_]', '', 'g'), 1, 40)"
_CHECKED = f"""{_GENERATED}, cs AS (SELECT ge.*, dc.text AS src, min(qid) OVER (PARTITION BY {_KEY}) AS first_qid FROM ge LEFT JOIN dc ON dc.chunk_id = src_chunk),
ck AS (SELECT qid, q_type, CASE WHEN coalesce(gold_text, '') <> '' AND coalesce(src, '') <> '' THEN {_SHARE(GRAMS3('gold_text'), GRAMS3('src'), '0.0')} >= 0.8 ELSE q_type = '답없음' END AS ev_ok, {_SHARE(GRAMS3('question'), GRAMS3('src'), '0.0')} <= 0.6 AS copy_ok,
NOT regexp_matches(coalesce(question, ''), '{V.DEICTIC}') AS deictic_ok, length(coalesce(question, '')) BETWEEN 8 AND 150 AS length_ok, qid = first_qid AS first_ok, CAST(NULL AS BOOLEAN) AS recall_ok FROM cs),
sv AS (SELECT *, CASE WHEN ev_ok AND copy_ok AND deictic_ok AND length_ok AND first_ok THEN '통과' ELSE '보류' END AS verdict, concat_ws(' · ', CASE WHEN NOT ev_ok THEN '근거 실재' END, CASE WHEN NOT copy_ok THEN '복붙 아님' END, CASE WHEN NOT deictic_ok THEN '지시어 없음' END, CASE WHEN NOT length_ok THEN '길이 적정' END, CASE WHEN NOT first_ok THEN '중복 아님' END) AS reasons FROM ck)"""
_VERDICT = "CASE WHEN value IS NULL THEN '-' WHEN CASE WHEN op = '<=' THEN value <= threshold ELSE value >= threshold END THEN 'pass' ELSE 'fail' END AS verdict"
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows)
_MEASURED = ["faithfulness", "answer_relevancy", "answer_correctness", "citation_accuracy", "refusal_ok", "context_recall"]
_JUDGED_REST = _JUDGED[len(_G) :]
_METRIC_ROWS = "SELECT strftime(l_shipdate, '%Y%m') AS ym, round(sum(l_extendedprice * (1 - l_discount)), 2) AS x FROM lineitem WHERE l_returnflag <> 'R' AND strftime(l_shipdate, '%Y%m') BETWEEN '200001' AND '200012' GROUP BY 1"
SQL |= {
    "answer_metrics": f"WITH {_EVALUATED} SELECT * FROM em",
    "metric_verdicts": f"WITH {_EVALUATED}, mv AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS value FROM em" for m in _MEASURED) + f"), ct(grp, metric, op, threshold) AS (VALUES {_VALUES(M.CATALOG)}) SELECT grp, metric, op, threshold, value, {_VERDICT} FROM ct LEFT JOIN mv USING (metric)",
    "generated_questions": f"WITH {_GENERATED} SELECT * FROM ge",
    "self_check": f"WITH {_CHECKED} SELECT * EXCLUDE (q_type) FROM sv",
    "checked_set": f"WITH {_CHECKED} SELECT ge.*, verdict, reasons, recall_ok FROM ge LEFT JOIN sv USING (qid)",
    "set_verdicts": f"WITH {_G}, ki AS ({SQL['known_item_set']}), st AS (WITH gq AS (SELECT * FROM ki){_JUDGED_REST}, {_detail()} SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5 FROM de), ms AS (SELECT 'known-item' AS set_name, 'recall_1' AS metric, recall_1 AS value FROM st UNION ALL SELECT 'known-item', 'recall_5', recall_5 FROM st), lm(set_name, metric, op, threshold) AS (VALUES {_VALUES(V.LIMITS)}) SELECT set_name, metric, op, threshold, value, {_VERDICT} FROM lm LEFT JOIN ms USING (set_name, metric)",
    "exec_match_matrix": f"""WITH a AS ({_METRIC_ROWS}), b AS (SELECT ym, round(sum(l_extendedprice * (1 - l_discount)), 2) AS x FROM (SELECT *, strftime(l_shipdate, '%Y%m') AS ym FROM lineitem WHERE l_returnflag <> 'R') WHERE ym LIKE '2000%' GROUP BY 1),
c AS (SELECT strftime(o_orderdate, '%Y%m') AS ym, round(sum(o_totalprice), 2) AS x FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 2000 GROUP BY 1), e AS (SELECT strftime(o_orderdate, '%Y%m') AS ym, round(sum(o_totalprice), 2) AS x FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1)
SELECT 'c1' AS case_id, true AS made, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS matched UNION ALL SELECT 'c2', true, (SELECT count(*) FROM (FROM c EXCEPT FROM e)) + (SELECT count(*) FROM (FROM e EXCEPT FROM c)) = 0 UNION ALL SELECT 'c3', false, false""",
}
