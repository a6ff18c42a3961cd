from datetime import datetime as D

from millrace.llm import repeated_lines as L
from millrace.llm import truncation as T

RAW = "raw_no bigint, doc_id string, doc_type string, published_at timestamp_ntz, body string, line string"
TYPES = "code string, ko_name string, aliases string, grp string, security int"


def _types(spark):
    return spark.createDataFrame([("NEWS", "뉴스", "뉴스;기사", "", 0), ("EMAIL", "메일", "MAIL", "", 2), ("BROKER", "증권사", None, "", 1)], TYPES)


def _raw(spark, rows):
    return spark.createDataFrame([(i, d, t, D(2025, 1, 1), b, "x") for i, (d, t, b) in enumerate(rows, 1)], RAW)


def test_repeated_lines(spark, rows):
    note = "저작권자 ⓒ 신문, 2025 무단 전재 금지"
    data = [(f"N{i}", " news" if i % 2 else "기사", f"본문 {'가나다라마바사'[i]} 줄\r\n저작권자 ⓒ 신문,  20{20 + i} 무단 전재 금지\n| 표 |\n\n") for i in range(5)]
    data += [(None, "NEWS", note), ("N9", "NEWS", None), ("N8", "NEWS", ""), ("E1", "MAIL", note), ("Z", "unknown", note), ("Z", None, note), ("B1", "BROKER", note)]
    raw = _raw(spark, data)
    got = rows(L.repeated_cases(raw, _types(spark)))
    assert got == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 2), (6, 1)]
    kept = dict(rows(L.without_repeated(raw, _types(spark))))
    assert kept[1] == "본문 가 줄\r\n| 표 |\n\n" and kept[6] == "" and kept[7] is None and kept[12] == note and 9 not in kept


def test_recollections_are_one_document(spark, rows):
    data = [("N1 " if i % 2 else "n1", "NEWS", "같은 줄") for i in range(20)] + [(f"M{i}", "NEWS", "같은 줄") for i in range(3)]
    assert rows(L.repeated_cases(_raw(spark, data), _types(spark))) == []
    assert len(rows(L.repeated_cases(_raw(spark, [*data, ("M9", "NEWS", "같은 줄")]), _types(spark)))) == 24


def test_republished_documents_are_one_cluster(spark, rows):
    same = "옮겨 실은 글의 줄\n그 글의 다른 줄"
    data = [(f"N{i}", "NEWS", same) for i in range(6)] + [(f"M{i}", "NEWS", f"고유한 글 {'가나다라마바사아'[i]}\n붙은 줄") for i in range(5)]
    raw, types = _raw(spark, data), _types(spark)
    assert {r[0] for r in rows(L.repeated_cases(raw, types))} == set(range(1, 12))
    assert {r for r in rows(L.repeated_cases(raw, types, copies=True))} == {(i, 2) for i in range(7, 12)}
    # keys chained by shared texts are one cluster: N0 has both texts
    chained = _raw(spark, [("N0", "NEWS", "글 가"), ("N0", "NEWS", "글 나"), ("N1", "NEWS", "글 가"), ("N2", "NEWS", "글 나"), ("N3", "BROKER", "글 가"), (None, "NEWS", "글 나")])
    assert len({r.cluster for r in L.clusters(L.typed_bodies(chained, types)).collect()}) == 1 and L.clusters(L.typed_bodies(chained, types)).count() == 3


def test_publication_dates(spark, rows):
    data = [(i, f"N{i}", "NEWS", D(2025, 1, 1 + i % 2), f"고유한 글 {'가나다라마바사아'[i]}\n붙은 줄", "x") for i in range(8)]
    raw, types = spark.createDataFrame(data, RAW), _types(spark)
    assert len(rows(L.repeated_cases(raw, types, least_dates=2))) == 8 and rows(L.repeated_cases(raw, types, least_dates=3)) == []
    assert rows(L.repeated_by_line(raw, types)) == [("NEWS", 0, 2, 8, 2)]


def test_share_of_documents(spark, rows):
    data = [(f"N{i}", "NEWS", "드문 줄" if i < 5 else f"다른 {'가나다라마바사아자차'[i % 10] * (i // 10 + 1)}") for i in range(300)]
    assert rows(L.repeated_cases(_raw(spark, data), _types(spark))) == []  # 5 of 300 is under two per cent
    assert len(rows(L.repeated_cases(_raw(spark, data[:250]), _types(spark)))) == 5


def test_empty_tables(spark, rows):
    raw = spark.createDataFrame([], RAW)
    assert rows(L.repeated_cases(raw, _types(spark))) == [] and rows(L.without_repeated(raw, _types(spark))) == []


CHUNKS = "chunk_id string, doc_id string, seq int, text string, key string, line string"


def _cut(spark, chunks, docs):
    raw = spark.createDataFrame([(d, b, "k") for d, b in docs], "doc_id string, body string, key string")
    table = spark.createDataFrame([(c, d, 1, t, "k", "l") for c, d, t in chunks], CHUNKS)
    return {r.chunk_id for r in T.truncated(table, raw).collect()}


def test_truncated_lines_of_the_own_document(spark):
    body = "제목 - 3차\n\n첫 문장이 여기서 끝났다. 둘째 문장도 여기서  끝났다.\r\n| 가 | 나 |\n| 1.5 | 2.5 |\n홍길동 드림"
    chunks = [("whole", "a1", "제목 - 3차\n첫 문장이 여기서 끝났다. 둘째 문장도 여기서 끝났다."), ("cut", "A1 ", "제목 - 3차\n첫 문장이 여기서 끝났다. 둘째 문"), ("sentence", "A1", "첫 문장이 여기서 끝났다."), ("row", "A1", "| 가 | 나 |\n| 1.5 | 2."), ("rowok", "A1", "| 1.5 | 2.5 |"), ("name", "A1", "홍길동 드림"), ("dots", "A1", "첫 문장이 여기서..."), ("mark", "A1", "홍길동 [생략]"), ("empty", "A1", ""), ("null", "A1", None), ("blank", "A1", " \n "), ("cut", "A1 ", "제목 - 3차\n첫 문장이 여기서 끝났다. 둘째 문")]
    assert _cut(spark, chunks, [("A1", body)]) == {"cut", "sentence", "row", "dots", "mark"}


def test_without_the_own_document_endings_decide(spark):
    docs = [(f"D{i}", f"4. 시사점 {i}\n담당 연구위원, 남미 낸드 담당\n가격이 {i}% 올랐다고 밝혔다.\n| a | {i} |") for i in range(4)]
    chunks = [("ok1", "X", "국내 수급 4. 시사점 2"), ("ok2", "X", "해늘 연구위원, 유럽 낸드 담당"), ("ok3", None, "물량이 크게 늘었다고 밝혔다."), ("ok4", "X", "| b | 7 |"), ("ok5", "X", "4. 시사점 3"), ("bad1", "X", "물량이 크게 늘었다. 내년에는"), ("bad2", "X", "| b | 7"), ("bad3", "X", "유럽 거래선에 저전력 낸드 공급가를 개당 8"), ("bad4", "X", "물량이 크게 …")]
    assert _cut(spark, chunks, docs) == {"bad1", "bad2", "bad3", "bad4"}


def test_no_rows_and_long_texts(spark):
    assert _cut(spark, [], [("A", "x")]) == set()
    assert _cut(spark, [("c", "A", "끝났다.")], []) == set()
    long = "가나다 " * 50_000 + "끝."
    assert _cut(spark, [("w", "A", long), ("c", "A", long[:100_000])], [("A", long)]) == {"c"}


def test_rates(spark, rows):
    raw = spark.createDataFrame([("A", "기사", "온전한 줄이다.")], "doc_id string, doc_type string, body string")
    chunks = spark.createDataFrame([("1", "A", "온전한 줄이다."), ("2", "a", "온전한 줄"), ("3", None, "끝났다.")], "chunk_id string, doc_id string, text string")
    assert set(rows(T.rates(chunks, raw, _types(spark)).fillna("-"))) == {("NEWS", 2, 1, 0.5), ("-", 1, 0, 0.0)}
