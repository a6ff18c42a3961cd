import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokens as K
from millrace.operators import chunking as H


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value, "NEWS")], "t string, k string")
    return tuple(df.select(*(e.alias(f"c{i}") for i, e in enumerate(exprs))).first())


def test_tokenizers(spark):
    words, stems, kiwi = one(spark, "HBM3E의 가격은 12.5% 올랐다, 가격이!", K.tokenizer("space")("t"), K.tokenizer("josa")("t"), K.tokenizer("kiwi")("t"))
    assert words == ["hbm3e의", "가격은", "12.5%", "올랐다", "가격이"] and stems == ["hbm3e", "가격", "12.5%", "올랐다", "가격"] and kiwi
    assert one(spark, None, K.words("t"), K.stems("t")) == ([], [])


def test_grams_and_coverage(spark):
    assert one(spark, "a b\ncd", K.char_grams("t"), K.shingles("t"), K.char_grams("t", 5)) == (["abc", "bcd"], ["a b c", " b cd"], [])
    assert one(spark, "ab", K.char_grams("t"), K.shingles("t")) == ([], ["ab"])
    assert one(spark, "abcd", K.coverage("t", F.lit("xabcx")), K.coverage(F.lit("ab"), "t"), K.coverage(F.lit("ab"), "t", 1.0)) == (0.5, 0.0, 1.0)
    assert one(spark, "가격 상승 HBM", K.keyword_overlap("t", F.lit("HBM 하락 가격")), K.element_hit("t", F.lit("가격표")), K.element_hit(F.lit("수치 제시"), "t")) == (2 / 3, 1 / 3, 0.0)
    assert one(spark, "x", K.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), K.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == (0.5, 0.0)


@pytest.mark.parametrize("text,n", [("가나다", 2), ("abcd efgh", 2), ("", 0), (None, 0), ("가 a", 1)])
def test_token_estimate(spark, text, n):
    assert one(spark, text, T.count_tokens("t")) == (n,)


def test_repeated_lines(spark):
    assert one(spark, "머리\n본문\n 머리 \n끝", T.remove_repeated_lines("t")) == ("본문\n끝",)
    long = "긴" * 61
    assert one(spark, f"{long}\n{long}\n\n\n끝", T.remove_repeated_lines("t")) == (f"{long}\n{long}\n\n\n끝",)
    assert one(spark, None, T.remove_repeated_lines("t")) == ("",)


def test_clean_email(spark):
    mail = "안녕하세요\n> 인용\n새 글\n감사합니다.\n홍길동 드림\n팀 | 02-123-4567 | a@b.c\n본 메일은 기밀입니다\n보낸 사람 : 김\n앞선 글"
    assert one(spark, mail, T.clean_email("t")) == ("안녕하세요\n새 글",)


def test_clean_by_type(spark):
    df = spark.createDataFrame([("제목\n\n\n\n가  나 무단 전재 금지\r\n- 관련", "NEWS"), ("머리\n가\n머리", "REPORT"), ("> q\n새", "EMAIL"), ("가\t나", "OTHER"), (None, "NEWS"), ("x", None)], "t string, k string")
    assert [r[0] for r in df.select(T.clean("t", "k")).collect()] == ["제목\n\n가 나", "가", "새", "가 나", "", "x"]


def test_inspection(spark):
    assert one(spark, "끝났다. ", T.ends_mid_sentence("t")) == (False,) and one(spark, "끝나지 않", T.ends_mid_sentence("t")) == (True,) and one(spark, "", T.ends_mid_sentence("t")) == (False,)
    assert one(spark, "1 2\n3 4\n5 6%", T.table_suspect("t")) == (True,) and one(spark, "1 2\n3 4\n| 5 6 |\n7 8", T.table_suspect("t")) == (False,)
    assert one(spark, "저작권자 ⓒ x", T.noise_left("t", "k")) == (True,) and one(spark, "본문", T.noise_left("t", "k")) == (False,)
    assert one(spark, "2026-07 글", T.has_header("t", F.lit(None)), T.has_header(F.lit("글"), F.lit("글"))) == (True, True)
    assert one(spark, "제목", T.build_header(F.lit("뉴스"), F.lit(None).cast("timestamp"), F.lit(""), "t")) == ("[뉴스 | 날짜미상 | 제목]",)
    assert one(spark, "첫 문장이다. 둘째 문장! 셋\n넷째 줄은 깁니다", T.sentences("t", 5)) == (["첫 문장이다.", "둘째 문장!", "넷째 줄은 깁니다"],)
    assert one(spark, "코드 HBM3 확인", T.difficulty("t"), T.difficulty(F.lit("그냥 문장"))) == ("easy", "mid")


def test_candidates(spark):
    good = "가온셀의 영업이익은 크게 늘어난 것으로 모두 집계됐다."
    bad = ["> " + good, "| 표 | " + good, "3.1 " + good, "짧다.", good[:-3] + "예상", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 집계됐다."]
    assert one(spark, "\n".join([good, *bad]), T.candidate_sentences("t")) == ([good],)


def test_packing_of_paragraphs(spark):
    text = "\n\n".join(["가" * 30, "나" * 30, "| a |\n| b |", "다" * 100, "라"])
    pack = lambda size, table: one(spark, text, H.pack_paragraphs(F.col("t"), F.lit(size), F.lit(table)))[0]
    assert pack(60, True) == ["가" * 30 + "\n\n" + "나" * 30, "| a |\n| b |", "다" * 100, "라"]
    assert pack(1000, False) == [text] and one(spark, None, H.pack_paragraphs(F.col("t"), F.lit(5), F.lit(True)))[0] == []
    for size in (1, 50, 120):
        assert "".join("".join(pack(size, True)).split()) == "".join(text.split())


def test_fixed_chunks(spark, rows):
    df = spark.createDataFrame([("A", "x" * 250, 1), ("B", "", 1), ("C", None, 1)], "doc_id string, body string, seq int")
    assert [(r[0], r[2], len(r[3])) for r in rows(H.fixed_chunks(df))] == [("A_000", 0, 120), ("A_001", 1, 120), ("A_002", 2, 10)]
