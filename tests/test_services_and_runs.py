from millrace.operators import compare as P
from millrace.operators import graph as G
from millrace.operators import retrieval as R
from millrace.operators import sqlroute as S
from millrace.sources import services as V

CH = "chunk_id string, doc_id string, text string"


def _corpus(spark):
    chunks = spark.createDataFrame([("a", "D1", "낸드 가격이 올랐다는 긴 설명이 이어졌다."), ("b", "D2", "재고가 줄었다는 긴 설명이 이어졌다."), ("c", "D3", "다른 이야기만 길게 이어졌다.")], CH)
    return chunks, spark.createDataFrame([("q1", "낸드 가격"), ("q2", "재고")], "qid string, question string")


def test_embedder_and_scorer_are_taken(spark):
    from pyspark.sql import functions as F

    chunks, asked = _corpus(spark)
    embed = lambda df, i, t: df.select(i, F.array(F.length(F.coalesce(t, F.lit(""))).cast("double"), F.lit(1.0)).alias("vec"))
    r = R.Retriever(chunks, embed=embed, scorer=lambda q, t: (F.col(t).startswith("다른")).cast("double"))
    assert {x.chunk_id for x in r.search(asked, "dense", 1).collect()} == {"a"}
    assert {x.chunk_id for x in r.search(asked, "hybrid+rerank", 1).collect()} == {"c"}


def test_pacing_waits_for_its_turn():
    at, slept = [0.0], []
    call = V.paced(lambda: at[0], 30, sleep=lambda s: (slept.append(round(s, 6)), at.__setitem__(0, at[0] + s)), clock=lambda: at[0])
    assert [call() for _ in range(3)] == [0.0, 2.0, 4.0] and slept == [2.0, 2.0]


def test_weak_answers_are_made_once_more(spark):
    chunks, asked = _corpus(spark)
    asked_texts = []

    def answer(questions, hits, k):
        asked_texts.append(1)
        return V.model_answers(lambda prompt: "근거 없는 말을 아주 길게 늘어놓은 답이다 [1]" if len(asked_texts) == 1 else "낸드 가격이 올랐다는 긴 설명이 이어졌다. [1]")(questions, hits, k)

    out = {r.qid: r for r in G.run(asked.where("qid = 'q1'"), R.Retriever(chunks), G.preset("v6_verify", grade=False, rewrite=False), answer).collect()}
    assert len(asked_texts) == 2 and out["q1"].regen == 1 and out["q1"].answer.startswith("낸드 가격이")
    assert [r.answer for r in V.model_answers()(asked, chunks.limit(0).selectExpr("chunk_id as qid", "text", "1 as rank"), 3).collect()] == ["확인된 자료 없음"] * 2


def test_catalog_of_sheets_and_model_sql(spark, tmp_path):
    rows = {"metrics": [{"id": "m1", "name": "매출", "alias": "매출액; revenue", "view": "v_x", "expr": "sum(a)"}, {"id": ""}], "codes": [{"kind": "k", "code": "A", "name": "가", "alias": "", "column": "c"}], "allow": [{"table": "v_x", "columns": "a; ym", "use": "Y"}, {"table": "t", "columns": "", "use": "N"}]}
    catalog = S.catalog_of(rows)
    assert catalog.metrics[0].aliases == ("매출액", "revenue") and len(catalog.metrics) == 1 and catalog.allow_map() == {"v_x": {"a", "ym"}}
    spark.createDataFrame([(1, "200001")], "a int, ym string").createOrReplaceTempView("v_x")
    assert S.make_sql_with("날씨는?", catalog, spark) == ("", "none")
    assert S.make_sql_with("날씨는?", catalog, spark, lambda p: "```sql\nSELECT a FROM v_x\n```" if "v_x" in p else "") == ("SELECT a FROM v_x", "model")
    assert S.make_sql_with("매출은?", catalog, spark)[1] == "rule"
    r = S.sql_scores(spark, [("매출은?", "sql", "SELECT ym, sum(a) FROM v_x GROUP BY ym"), ("왜?", "rag", "")], catalog).first()
    assert (r.n_questions, r.valid_sql, r.execution_accuracy) == (2, 1.0, 1.0)


def test_run_records_are_replaced_by_id(spark, tmp_path):
    detail = spark.createDataFrame([("q1", 1.0, 0.5), ("q2", 0.0, 1.0)], "qid string, recall_5 double, mrr double")
    for note in ("first", "second"):
        P.record_run(P.run_record(detail, "RUN-1", "2025-01-02", note=note), str(tmp_path))
    P.record_run(P.run_record(detail.limit(0), "RUN-2", "2025-01-03"), str(tmp_path))
    got = {r.run_id: r for r in spark.read.parquet(str(tmp_path)).collect()}
    assert got["RUN-1"].note == "second" and (got["RUN-1"].n_questions, got["RUN-1"].recall_5, got["RUN-1"].mrr, got["RUN-1"].ndcg_10) == (2, 0.5, 0.75, None) and got["RUN-2"].n_questions == 0
