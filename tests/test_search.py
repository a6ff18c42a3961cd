import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.operators import dedup as D
from millrace.operators import evalsets as V
from millrace.operators import graph as G
from millrace.operators import metrics as M
from millrace.operators import retrieval as R

CH = "chunk_id string, doc_id string, text string, score double"
Q = "qid string, question string, gold_doc_ids string, gold_text string, q_type string, must_include string"


@pytest.fixture(scope="module")
def data(spark):
    random.seed(4)
    words = "hbm 낸드 가격 물량 재고 유럽 수요 공급 분기 계약".split()
    chunks = [(f"D{i // 2}#{i % 2}", f"D{i // 2}", " ".join(random.choices(words, k=random.randrange(3, 30))), 0.0) for i in range(40)] + [("D0#0", "D0", "zz", 0.0), (None, "D1", "x", 0.0), ("N", None, None, 0.0), ("B", None, "", 0.0)]
    questions = [("q1", "HBM 가격 추이", "D1;D2", "", "수치", "hbm"), ("q2", "유럽 재고와 계약", "D3", "", "사실", ""), ("q3", "없는말뿐", "", "", "답없음", ""), ("q4", None, None, None, None, None)]
    return spark.createDataFrame(chunks, CH), spark.createDataFrame(questions, Q)


def test_bm25_against_loops(data):
    chunks, questions = data
    docs = {r.chunk_id: r.text for r in R.corpus(chunks).collect()}
    assert docs["B"] == "" and None not in docs and "N" not in docs
    toks = {c: t.lower().split() for c, t in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    for qid, words in (("q1", ["hbm", "가격", "추이"]), ("q2", ["유럽", "재고와", "계약"])):
        scores = {}
        for c, t in toks.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in words if w in t)
            if s:
                scores[c] = round(s, 6)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        got = [(r.chunk_id, r.score) for r in R.bm25(R.corpus(chunks), questions, 5).where(f"qid = '{qid}'").orderBy("rank").collect()]
        assert got == want


def test_hashed_vectors_equal_the_long_form(data):
    chunks, _ = data
    docs = R.corpus(chunks)
    vec = {r.chunk_id: np.array(r.vec) for r in R.hashed_vectors(docs, "chunk_id", "text").collect()}
    long = {}
    for r in R.hashed_terms(docs, "chunk_id", "text").collect():
        long.setdefault(r.chunk_id, np.zeros(R.DIMS))[r.dim] = r.w
    assert not vec["B"].any() and all(np.allclose(v, long.get(c, np.zeros(R.DIMS))) for c, v in vec.items())


def test_dense_is_exact_in_blocks(spark, monkeypatch):
    rng = np.random.RandomState(1)
    v = rng.rand(50, 4)
    v[7] = v[3]
    monkeypatch.setattr(R, "BLOCK", 3)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, vec array<double>")
    asked = spark.createDataFrame([(f"q{i:02d}", v[i].tolist()) for i in range(8)], "qid string, vec array<double>")
    got = {}
    for r in R.dense(table, asked, 4, "vec_id").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    for i in range(8):
        want = sorted(range(50), key=lambda j: (-round(float(v[i] @ v[j]), 6), j))[:4]
        assert got[f"q{i:02d}"] == want
    assert R.dense(table, asked.where("false"), 4, "vec_id").count() == 0


def test_fusion_is_free_of_order_and_weighted(spark, rows):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "qid string, chunk_id string, rank int")
    assert rows(R.rrf([a, b])) == rows(R.rrf([b, a])) == [("q", "x", round(1 / 61, 9)), ("q", "y", round(1 / 62 + 1 / 61, 9))]
    assert rows(R.rrf([a, b], weights=[1.0, 0.0]))[1][2] == round(1 / 62, 9)
    assert rows(R.hybrid({"bm25": a, "sparse": b.where("false")}).select("chunk_id", "rank", "via")) == [("x", 1, "rrf(bm25)"), ("y", 2, "rrf(bm25)")]


def test_diversity():
    texts = ["abcdefgh", "abcdefgx", "zzzzyyyy", "q"]
    rel = np.array([0.9, 0.8, 0.5, 0.1])
    assert R.select_diverse(rel, texts, 1.0, 4) == [0, 1, 2, 3] and R.select_diverse(rel, texts, 0.3, 3)[:2] != [0, 1] and R.select_diverse(np.ones(3), texts[:3], 0.7, 2)[0] == 0


def test_modes_and_graph(data):
    chunks, questions = data
    retriever = R.Retriever(chunks)
    lists = retriever.lists(questions)
    for mode in R.MODES:
        hits = retriever.search(questions, mode, k=5, lists=lists).collect()
        per = Counter(r.qid for r in hits)
        assert max(per.values()) <= 5 and per["q1"] == 5 and all(sorted(r.rank for r in hits if r.qid == q) == list(range(1, n + 1)) for q, n in per.items())
        if "mmr" in mode:
            assert max(Counter((r.qid, r.doc_id) for r in hits).values()) <= R.PER_DOC
    with pytest.raises(ValueError):
        retriever.search(questions, "none")
    out = {r.qid: r for r in G.run(questions, retriever, G.preset(mode="bm25")).collect()}
    assert set(out) == {"q1", "q2", "q3", "q4"} and out["q3"].answer == G.REFUSAL and out["q3"].retry == 1 and out["q1"].retry == 0 and [s.node for s in out["q1"].trace][0] == "route"
    summary, detail = G.compare(["v0_baseline"], questions, retriever, questions)
    assert summary.count() == 1 and detail.count() == 4


def test_metrics(spark):
    hits = spark.createDataFrame([("q", 1, "X", "t"), ("q", 2, "A", "t"), ("q", 3, "B", "t"), ("q", 4, "A", "t"), ("r", 1, "X", "t")], "qid string, rank int, doc_id string, text string")
    gold = spark.createDataFrame([("q", "A; B ;", None), ("r", "Z", ""), ("s", "A", ""), ("n", " ", "")], "qid string, gold_doc_ids string, gold_text string")
    got = {r.qid: r for r in M.retrieval_metrics(M.judge(hits, gold), gold).collect()}
    q = got["q"]
    assert set(got) == {"q", "r", "s"} and (q.mrr, q.hit_1, q.hit_3, q.recall_3, q.recall_5) == (0.5, 0, 1, 1.0, 1.0)
    assert q.ap == round((1 / 2 + 2 / 3 + 3 / 4) / 3, 6) and q.precision_5 == 0.6 and got["s"].mrr == 0 and got["r"].first_hit_rank is None
    dcg = sum(1 / math.log2(i + 1) for i in (2, 3, 4))
    assert q.ndcg_5 == round(dcg / (1 + 1 / math.log2(3)), 6)
    twice = spark.createDataFrame([("q", 1, "A", "t"), ("q", 2, "A", "t")], hits.schema)
    one = spark.createDataFrame([("q", "A", "")], gold.schema)
    assert M.retrieval_metrics(M.judge(twice, one), one).first().ndcg_5 > 1


def test_answers(spark):
    data = [("a", "수치", "가격은?", "HBM 가격은 12% 올랐다. [1] 자료가 하나 더 있습니다. [9][DB]", ["HBM 가격은 12% 올랐다."], "HBM 가격(월); 없는 요소", "HBM 가격은 12% 올랐다."), ("b", "답없음", "?", "확인된 자료 없음", [], "", None), ("c", None, None, None, [], None, None)]
    rows = {r.qid: r for r in M.evaluate_answers(spark.createDataFrame(data, "qid string, q_type string, question string, answer string, contexts array<string>, must_include string, gold_text string")).collect()}
    a = rows["a"]
    assert a.n_citation == 3 and a.citation_accuracy == round(2 / 3, 6) and a.answer_correctness == 0.5 and a.context_recall == 1.0 and a.has_number and a.refusal_ok == 1 and a.faithfulness == 0.5
    assert rows["b"].refusal_ok == 1 and rows["b"].citation_accuracy is None and rows["b"].faithfulness is None and rows["c"].faithfulness is None


def test_near_duplicates(spark):
    random.seed(9)
    base = " ".join(f"w{random.randrange(900)}" for _ in range(300))
    near = base[:900] + "changed" + base[907:]
    texts = [base, base, near, " ".join(f"v{random.randrange(900)}" for _ in range(300)), None, "", "short", "short "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    links, members = D.near_classes(docs)
    classes = {int(r.id): r.class_id for r in members.collect()}
    assert len(classes) == 8 and classes[0] == classes[1] == classes[2] != classes[3] and classes[6] == classes[7] and classes[4] == classes[5]
    a, b = D.seeded_coefficients()
    for r in links.collect():
        assert r.similarity == np.mean(D.char_signature(texts[int(r.id_a)], a, b) == D.char_signature(texts[int(r.id_b)], a, b)) >= 0.8
    assert D.near_classes(docs.where("false"))[1].count() == 0


def test_texts_of_one_signature_are_linked(spark):
    random.seed(9)
    words = [f"w{random.randrange(900)}" for _ in range(300)]
    # inner white space makes another text of the same shingles; the last text differs in a word
    texts = [" ".join(words), "  ".join(words), "\n".join(words), " ".join([*words[:150], "changed", *words[151:]])]
    a, b = D.seeded_coefficients()
    signed = [D.char_signature(t, a, b) for t in texts]
    want = {(str(i), str(j)): np.mean(signed[i] == signed[j]) for i in range(4) for j in range(i + 1, 4)}
    assert [want[p] for p in (("0", "1"), ("0", "2"), ("1", "2"))] == [1, 1, 1] and 0.8 <= want["2", "3"] < 1
    links, members = D.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string"))
    found = links.collect()
    assert len(found) == 6 and {(r.id_a, r.id_b): r.similarity for r in found} == want
    assert {r.class_id for r in members.collect()} == {"0"}


def test_components(spark, rows):
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("a", "b"), ("c", "b"), ("x", "x")], "id_a string, id_b string")
    got = dict(rows(D.connected(chain)))
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and got["a"] == got["b"] == got["c"] == "a" and "x" not in got


def test_evaluation_sets(spark, rows):
    golden = spark.createDataFrame([("G1", "이 문서의 수치는 얼마인가요", "없는 근거 문장입니다", "수치", "c1"), ("G2", "가온셀의 이익은 얼마나 늘었나", "가온셀의 이익은 크게 늘었다", "수치", "c1"), ("G3", "가온셀의 이익은 얼마나 늘었나", "", "답없음", ""), ("G4", "짧다", "가온셀의 이익은", "사실", "c1")], "qid string, question string, gold_text string, q_type string, src_chunk string")
    docs = spark.createDataFrame([("c1", "작년에 가온셀의 이익은 크게 늘었다고 회사가 밝혔다.")], "chunk_id string, text string")
    got = {r.qid: (r.verdict, r.reasons) for r in V.self_check(golden, docs).collect()}
    assert got["G1"] == ("보류", "근거 실재 · 지시어 없음") and got["G2"] == ("통과", "") and got["G3"] == ("보류", "중복 아님") and "길이 적정" in got["G4"][1]
    found = spark.createDataFrame([("G2", False)], "qid string, found boolean")
    assert {r.qid: r.reasons for r in V.self_check(golden, docs, found).collect()}["G2"] == "정답 문서 미회수"
    linked = spark.createDataFrame([("q", 1, V.HOLD, "", ""), ("q", 2, V.FOUND, "B", ""), ("q", 3, V.FOUND, "A", "t"), ("r", 1, V.NO_DOCUMENT, "", ""), ("s", 1, None, None, None)], "qid string, cand_rank int, verdict string, doc_id string, gold_text string")
    qs = spark.createDataFrame([("q", "?", "x"), ("r", "?", "x"), ("s", "?", "x")], "qid string, question string, q_type string")
    g, c = V.apply_evidence(linked, qs)
    assert rows(g, "qid", "gold_doc_ids", "gold_text") == [("q", "A;B", "t")] and tuple(V.coverage_report(c).first()) == (3, 1, 1, 1, 0.333)
    sheet = V.to_review({"s": golden.selectExpr("qid", "'mid' as level", "question", "'D' as gold_doc_ids", "gold_text")})
    assert sheet.count() == 4 and V.from_review(sheet).count() == 0
    made = V.synthetic_queries(spark.createDataFrame([("D", "c", "가" * 200), ("D", "d", "짧다")], "doc_id string, chunk_id string, text string"), lambda t: "- 어느 회사의 이익이 늘었나?\n둘째 줄")
    assert [r.question for r in made.collect()] == ["어느 회사의 이익이 늘었나?"]
    parsed = spark.createDataFrame([('x {"question":"q","answer":"a","evidence":"e"} y',), ("none",), ('{"question":"q"}',)], "a string").select(V.parse_item("a").alias("p")).collect()
    assert parsed[0].p.question == "q" and parsed[1].p is None and parsed[2].p is None


def test_a_bucket_split_over_tasks_keeps_every_link(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_PART", 3)
    base = " ".join(f"낱말{i}" for i in range(400))
    docs = spark.createDataFrame([(i, base + f" {'끝' * (i + 1)}") for i in range(12)] + [(99, base + " 끝"), (50, "다른 글")], "doc_id int, body string")
    found = D.near(docs)
    assert found.links().count() == 66
    assert {r.id: r.n_links for r in found.link_counts().collect()} == {str(i): 11 for i in range(12)} | {"50": 0}
    classes = {r.id: r.class_id for r in found.members.collect()}
    assert len({classes[str(i)] for i in [*range(12), 99]}) == 1 and classes["50"] == "50"


def test_synthetic_questions_go_on_until_enough(spark):
    docs = spark.createDataFrame([(f"D{i}", f"c{i:03d}", f"{'가' * 150}{i:03d}") for i in range(60)], "doc_id string, chunk_id string, text string")
    made = V.synthetic_queries(docs, lambda text: "무엇을 물어야 하는 질문인가요" if int(text[-3:]) % 10 == 0 else "", n=5)
    assert made.count() == 5
