import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import checks as C
from millrace.operators import compare as P
from millrace.operators import sqlroute as S
from millrace.plans.search import CATALOG
from millrace.sources import readers, services, writers
from millrace.streaming.ingest import windowed_counts


@pytest.fixture
def views(spark):
    spark.createDataFrame([("200001", "A", 1.0, 0.1, 2.0, 9.0), ("200002", "R", 2.0, 0.0, 1.0, 9.0)], "ym string, l_returnflag string, l_extendedprice double, l_discount double, l_quantity double, l_tax double").createOrReplaceTempView("v_lineitem")
    spark.createDataFrame([("200001", 1, "F", 5.0, "1-URGENT")], "ym string, o_orderkey int, o_orderstatus string, o_totalprice double, o_orderpriority string").createOrReplaceTempView("v_orders")
    spark.createDataFrame([(1,)], "o_orderkey int").createOrReplaceTempView("t_orders_raw")


@pytest.mark.parametrize(
    "sql,ok",
    [
        ("SELECT ym, sum(l_quantity) q FROM v_lineitem GROUP BY ym;", True), ("WITH a AS (SELECT ym FROM v_orders) SELECT count(*) FROM a", True), ("SELECT 'drop table x', ym FROM v_orders", True), ("SELECT ym FROM v_orders UNION ALL SELECT ym FROM v_lineitem", True),
        ("DELETE FROM v_orders", False), ("DROP TABLE v_orders", False), ("SELECT 1; SELECT 2", False), ("SELECT * FROM t_orders_raw", False), ("SELECT v_orders.ym FROM v_orders, t_orders_raw", False), ("SELECT ym FROM v_orders WHERE o_orderkey IN (SELECT o_orderkey FROM t_orders_raw)", False),
        ("SELECT ym FROM v_orders WHERE EXISTS (SELECT 1 FROM t_orders_raw)", False), ("SELECT (SELECT max(o_orderkey) FROM t_orders_raw) x FROM v_orders", False), ("WITH t AS (SELECT * FROM t_orders_raw) SELECT * FROM t", False), ("SELECT l_tax FROM v_lineitem", False), ("INSERT INTO v_orders SELECT * FROM v_orders", False), ("not sql", False), ("", False), ("SHOW TABLES", False),
    ],
)
def test_guard(spark, views, sql, ok):
    assert S.validate(spark, sql, CATALOG).ok == ok


def test_guarded_star_shows_allowed_columns_only(spark, views):
    assert "l_tax" not in S.run_sql(spark, "SELECT * FROM v_lineitem", CATALOG).columns
    with pytest.raises(PermissionError):
        S.run_sql(spark, "SELECT * FROM t_orders_raw", CATALOG)


def test_made_sql_runs(spark, views, rows):
    assert S.make_sql("날씨는?", CATALOG) == ""
    sql = S.make_sql("2000년 1분기 회수 매출은?", CATALOG)
    assert "BETWEEN '200001' AND '200003'" in sql and "l_returnflag IN ('A')" in sql
    assert rows(S.run_sql(spark, sql, CATALOG)) == [("200001", 0.9)]
    assert S.explain(spark, sql)[0] and not S.explain(spark, "SELECT nothing FROM nowhere")[0]
    assert S.result_table(S.run_sql(spark, sql, CATALOG), "x").startswith("[x]\n| ym | m001 |")


@pytest.mark.parametrize("q,want", [("2026년 3분기 출하", "c BETWEEN '202607' AND '202609'"), ("3Q25 재고", "c BETWEEN '202507' AND '202509'"), ("2026년 8월", "c BETWEEN '202608' AND '202608'"), ("2026년", "c BETWEEN '202601' AND '202612'"), ("3분기", "")])
def test_periods(spark, q, want):
    assert S.period_filter(q, "c") == want
    lo_hi = spark.createDataFrame([(q,)], "question string").select(S.period_of("question").alias("p")).first().p
    assert (f"c BETWEEN '{lo_hi.lo}' AND '{lo_hi.hi}'" if lo_hi else "") == want
    assert "W" in S.period_filter("2026년 3분기", "yw", weekly=True)


def test_routes(spark, rows):
    qs = spark.createDataFrame([("a", "매출 추이와 이유"), ("b", "매출은?"), ("c", "연봉 알려줘"), ("d", "동향은?"), ("e", "2026년 물량 합계"), ("f", None)], "qid string, question string")
    assert {r.qid: r.route for r in S.route(qs, CATALOG).collect()} == {"a": "hybrid", "b": "sql", "c": "none", "d": "rag", "e": "sql", "f": "rag"}


def test_exec_match(spark):
    df = lambda rows, s="a int, b double": spark.createDataFrame(rows, s)
    assert S.exec_match(df([(1, 1.001), (1, 1.001)]), df([(1, 1.0)], "x int, y double")) and not S.exec_match(df([(1, 1.0), (1, 1.0)]), df([(1, 1.0)]), strict=True)
    assert not S.exec_match(df([]), df([])) and not S.exec_match(None, df([])) and not S.exec_match(df([(1, 2.0)]), df([(1, 2.1)]))


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("qid,질문\n1,가격\n2,\n".encode("cp949"))
    (tmp_path / "u.csv").write_bytes("﻿qid,text\n1,\"a\nb\"\n".encode())
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "k.csv")).collect()] == [("1", "가격"), ("2", "")]
    u = readers.read_table(spark, str(tmp_path / "u.csv"))
    assert u.columns == ["qid", "text"] and u.first().text == "a\nb"
    paths = writers.save(u, str(tmp_path), "out", "r1", ("parquet", "json", "orc", "csv"))
    assert all(readers.read_any(spark, p, k).count() == 1 for k, p in paths.items())
    df = spark.createDataFrame([(1, "2025-01-01", "x"), (2, "bad", "y")], "id int, pub_dt string, gone string")
    mapped = readers.select_mapped(df, {"doc_id": "id", "published_at": "pub_dt", "dropped": None}, where="id < 9", n=5)
    types = spark.createDataFrame([("NEWS", "기사")], "code string, aliases string")
    assert mapped.columns == ["doc_id", "published_at"] and [r.published_at is None for r in readers.standard_types(mapped, types).orderBy("doc_id").collect()] == [False, True]
    u.createOrReplaceTempView("u")
    assert readers.read_sql(spark, "SELECT qid AS QID FROM u WHERE qid = :q", {"q": "1"}).columns == ["qid"]


def test_services(spark, tmp_path):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise services.ServiceError(503)
        return x

    waits = []
    assert services.with_retry(flaky, sleep=waits.append)("v") == "v" and waits == [10.0, 20.0]
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    first = services.embed_missing(texts, spark.createDataFrame([], "key string"), lambda ts: [[float(len(t))] for t in ts])
    assert first.count() == 2 and services.embed_missing(texts, first, lambda ts: [[0.0]] * len(ts)).count() == 0
    hits = services.search_service(spark.createDataFrame([("q", "x")], "qid string, question string"), lambda q, k: [{"e": {"id": 1, "d": "D", "t": "T"}, "s": 2}], {"chunk_id": "e.id", "doc_id": "e.d", "text": "e.t", "score": "s"})
    assert tuple(hits.first()) == ("q", 1, "1", "D", "T", 2.0)
    (tmp_path / ".env").write_text("# c\nAPI_KEY='secret42'\nMODE=x\n\n")
    assert services.masked(services.load_env(str(tmp_path / ".env"))) == {"API_KEY": "****42", "MODE": "x"}


def test_reports_on_empty_and_odd_tables(spark, rows):
    raw = spark.createDataFrame([], "doc_id string, body string, published_at timestamp_ntz, collected_at timestamp_ntz")
    chunks = spark.createDataFrame([], "chunk_id string, doc_id string, seq int, text string")
    assert C.doc_integrity(raw, "2027-01-01").count() == 7 and C.chunk_integrity(raw, chunks).count() == 6
    raw = spark.createDataFrame([("A", "x", None, None), ("A", "x ", None, None), (None, None, None, None)], raw.schema)
    got = {r["item"]: (r["value"], r.verdict) for r in C.doc_integrity(raw, "2027-01-01").collect()}
    assert got["doc_id unique"] == (0.666667, "fail") and got["body present"] == (0.666667, "fail") and got["duplicate bodies"][0] == 0.333333
    chunks = spark.createDataFrame([("1", "A", 1, "가" * 40), ("2", "A", 3, "짧다"), ("2", "Z", 1, None)], chunks.schema)
    got = {r["item"]: r["value"] for r in C.chunk_integrity(raw, chunks).collect()}
    assert got == {"chunks": 3.0, "documents chunked": 1.0, "orphan chunks": 0.333333, "chunk_id unique": 0.666667, "seq intact": 0.5, "short chunks": 0.666667}
    typed = spark.createDataFrame([("NEWS", "t", None, "o"), ("ODD", "t", None, None), (None, None, None, None)], "doc_type string, title string, published_at timestamp_ntz, org_name string")
    assert set(rows(C.meta_completeness(typed).select("doc_type", "field", "rate", "verdict").fillna(-1.0))) == {("NEWS", "title", 1.0, "pass"), ("NEWS", "published_at", 0.0, "fail"), ("NEWS", "org_name", 1.0, "pass"), ("ODD", "-", -1.0, "undefined")}


def test_comparisons(spark, rows):
    runs = spark.createDataFrame([("r1", 100, 0.5), ("r2", 100, 0.8), ("r3", 100, 0.81)], "run_id string, n int, p double")
    assert P.two_runs(runs, "r1", "r2").first().verdict == "significant" and P.two_runs(runs, "r2", "r3").first().verdict == "hold"
    assert [r.trend for r in P.delta_vs_previous(runs, "run_id", "p").orderBy("run_id").collect()] == ["-", "up", "flat"]
    a = spark.createDataFrame([(str(i), 0.0) for i in range(20)], "qid string, hit double")
    b = spark.createDataFrame([(str(i), float(i < 12)) for i in range(20)], "qid string, hit double")
    assert tuple(P.mcnemar(a, b, "hit").first()) == (12, 0, round(121 / 12, 6), "significant") and P.mcnemar(a, a, "hit").first().verdict == "hold"
    assert rows(P.crosstab(runs, "run_id", "n", ["100", "5"]))[0] == ("r1", 1, 0)
    assert P.rates(runs, "n", F.col("p") > 0.6, F.lit(True)).first().rate == round(2 / 3, 6)


def test_stream_of_events_equals_the_table(spark, tmp_path, rows):
    events = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts, if(id % 2 = 0, 'a', 'b') AS event_type, cast(id AS double) AS value FROM range(100)")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert rows(spark.table("counts")) == rows(windowed_counts(events))


def test_entry_points():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p5_found", "p6_found"} <= set(queries)


def test_first_last_reads_every_load(spark, tmp_path):
    from millrace.plans import extra

    at = datetime.datetime(2025, 1, 1)
    # a type that changes after load 3, and one without the first and last loads
    data = [(k, "NEWS", at if k < 12 else None) for k in range(1, 13)] + [(2, "MAIL", None), (5, "MAIL", at), (None, "MAIL", None)]
    spark.createDataFrame(data, "load_no bigint, doc_type string, published_at timestamp_ntz").write.parquet(f"{tmp_path}/raw.parquet")
    spark.createDataFrame([("EMAIL", "MAIL"), ("NEWS", None)], "code string, aliases string").write.parquet(f"{tmp_path}/source_types.parquet")
    df = extra.first_last(spark, str(tmp_path))
    got = {r.doc_type: r for r in df.collect()}
    assert df.columns == ["doc_type", "load_no", "p", "delta", "regressed"]
    assert sorted((r.doc_type, r.load_no, r.p) for r in df.collect()) == [("EMAIL", 2, 1.0), ("EMAIL", 5, 0.0), *(("NEWS", k, float(k > 11)) for k in range(1, 13))]
    assert (got["NEWS"].delta, got["NEWS"].regressed, got["EMAIL"].delta, got["EMAIL"].regressed) == (1.0, False, -1.0, True)


def test_an_encoding_that_shows_late_in_the_file(spark, tmp_path):
    from millrace.sources import readers

    lines = ["no,word"] + [f"{i},plain" for i in range(20_000)] + ["20000,가격"]
    (tmp_path / "late.csv").write_bytes("\n".join(lines).encode("cp949"))
    got = readers.read_table(spark, str(tmp_path / "late.csv"), "no int, word string")
    assert got.count() == 20_001 and got.where("no = 20000").first().word == "가격"
