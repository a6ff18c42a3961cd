"""Search shuffles what may be among the best, however many texts share a question's words."""

import pytest

import __spark_entry__ as entry

N_CHUNKS, N_QUESTIONS = 3000, 40


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("common"))
    chunks = [(f"D{i // 2}#{i % 2}", f"D{i // 2}", f"hbm 가격 물량 재고 n{i} 계약") for i in range(N_CHUNKS)] + [("D0#0", "D0", "zz")]
    spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string").repartition(2).write.parquet(f"{d}/chunks.parquet")
    golden = [(f"G{50 * i:05d}", f"hbm 가격 물량 n{i}", f"D{i}", "", "수치", "hbm") for i in range(1, N_QUESTIONS + 1)]
    spark.createDataFrame(golden, "qid string, question string, gold_doc_ids string, gold_text string, q_type string, title string").write.parquet(f"{d}/golden_sample100.parquet")
    raw = [(i, f"D{i}", "NEWS", None) for i in range(N_CHUNKS // 2)]
    spark.createDataFrame(raw, "raw_no long, doc_id string, doc_type string, published_at timestamp").write.parquet(f"{d}/raw.parquet")
    return d


def shuffled(spark) -> int:
    """Rows that the stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize(
    "name",
    [
        "bm25_topk",
        "hybrid_rrf",
        "failed_questions",
        "screened_set",
        "smoke_summary",
        "union_dedup",
        "answer_metrics",
        "run_changes",
        "metrics_by_type",
        "uniqueness",
        "faithfulness",
        "cap_per_doc",
        "mode_metrics",
        "run_mcnemar",
        "mode_pivot",
        "search_modes",
        "rerank_overlap",
        "parameter_sweep",
    ],
)
def test_rows_shuffled(spark, tables, name):
    before = shuffled(spark)
    entry.queries()[name](spark, tables).write.format("noop").mode("overwrite").save()
    # every question shares words with every chunk
    assert 0 < shuffled(spark) - before < N_CHUNKS * N_QUESTIONS / 2


def test_all_parts_walk_the_texts_once(spark, tables):
    from pyspark.sql import functions as F

    from millrace.operators import retrieval as R
    from millrace.plans import search as S

    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    chunks = spark.read.parquet(f"{tables}/chunks.parquet").withColumn("text", F.udf(counted, "string").asNondeterministic()("text"))
    R.Retriever(chunks).lists(S.golden(spark, tables))
    # one corpus: rows that stand once, rows that stand more than once, and their ids
    assert 0 < seen.value <= 3 * (N_CHUNKS + 1)


def test_union_walks_the_texts_once(spark, tables, monkeypatch):
    from millrace.operators import retrieval as R

    walks, once = [], R.searches
    monkeypatch.setattr(R, "searches", lambda docs, questions, parts, *rest: walks.append(len(parts)) or once(docs, questions, parts, *rest))
    entry.queries()["union_dedup"](spark, tables)
    assert walks == [2]


def test_sweep_compares_texts_once_a_constant(spark, tables, monkeypatch):
    from millrace.operators import retrieval as R

    made, once = [], R.mmr_each
    monkeypatch.setattr(R, "mmr_each", lambda hits, lams, *rest: made.append(lams) or once(hits, lams, *rest))
    entry.queries()["parameter_sweep"](spark, tables)
    assert made == [(0.5, 0.7, 1.0)] * 2


def test_trade_offs_together_choose_as_each_by_itself(spark):
    import numpy as np

    from millrace.operators import retrieval as R

    texts = ["", "가", "abc", "abcd", "abcda", "𝒜bcd", "abc\x00", "abcd efgh", "abcd efgx", "efgh abcd", "hbm 가격 물량 재고", "hbm 가격 물량 계약", "abcd"]
    grams = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in texts]
    assert R._alike(texts).tolist() == [[len(a & b) / len(a | b) for b in grams] for a in grams]
    wide = ["".join(map(chr, range(0x4E00, 0x9000))), "".join(map(chr, range(0x20000, 0x2A000))), "乁乂七乄"]  # so many characters that four take more than 63 bits
    wide[1] += "".join(map(chr, range(0x1000, 0x4E00)))
    grams = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in wide]
    assert R._alike(wide).tolist() == [[len(a & b) / len(a | b) for b in grams] for a in grams]
    rows = [(q, i + 1, t, round(((i * 7 + len(q)) % 5) / 5, 2)) for q in ("a", "bb") for i, t in enumerate(texts)]
    hits = spark.createDataFrame(rows, "qid string, rank int, text string, rerank double")
    lams = (0.3, 0.7, 1.0)
    found = R.mmr_each(hits, lams, 6).collect()
    for lam in lams:
        for q in ("a", "bb"):
            rel = np.array([r[3] for r in rows if r[0] == q])
            want = [texts[i] for i in R.select_diverse(rel, texts, lam, 6)]
            assert [r.text for r in sorted((r for r in found if r.qid == q and r.lam == lam), key=lambda r: r.rank)] == want


def test_evidence_rows_shuffled(spark, tables, tmp_path):
    d = str(tmp_path)
    for name in ("chunks", "golden_sample100"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{tables}/{name}.parquet")
    spark.read.parquet(f"{tables}/raw.parquet").selectExpr("*", "'t' as title", "'o' as org_name").write.parquet(f"{d}/raw.parquet")
    spark.createDataFrame([("NEWS", "뉴스", "news", "g", 1)], "code string, ko_name string, aliases string, grp string, security int").write.parquet(f"{d}/source_types.parquet")
    test_rows_shuffled(spark, d, "evidence_link")


def test_words_in_workers_are_those_of_the_engine(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from millrace.functions import tokens as K

    texts = ["HBM3.5 가격은 10% 올랐다", "", "ß İ 으로서 에서부터 학교에서부터", "áb x² ½ 𝒜𝟙 𠀀 \u0085 Ⅷ_", "끝", "앞\x00뒤"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = df.select("i", K.words("t"), K.stems("t"), F.lower("t")).orderBy("i").collect()
    held = np.unpackbits(np.frombuffer(K.word_points(spark), np.uint8)).view(bool)
    words, row = K.split_words(*K.points_of([r[3] for r in want]), held)
    got = [[w for w, at in zip(words.to_pylist(), row.tolist(), strict=True) if at == i] for i in range(len(texts))]
    assert got == [r[1] for r in want]
    assert [[K.stem(w) for w in ws] for ws in got] == [r[2] for r in want]


def test_presets_are_measured_together_in_many_tasks(spark, tables, monkeypatch):
    from millrace.operators import metrics as M

    made, once = [], M.evaluate_answers
    monkeypatch.setattr(M, "evaluate_answers", lambda answers: made.append(answers) or once(answers))
    entry.queries()["preset_summary"](spark, tables)
    assert len(made) == 1
    # few bytes, but every part stays
    assert made[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_presets_search_once(spark, tables):
    from pyspark.sql import functions as F

    from millrace.operators import graph as G
    from millrace.operators import retrieval as R

    made = []

    class Counting(R.Retriever):
        def lists(self, questions, cand=R.CANDIDATES):
            made.append(cand)
            return super().lists(questions, cand)

    retriever, shared = Counting(spark.read.parquet(f"{tables}/chunks.parquet").limit(40)), {"decompose": True}
    asked = spark.createDataFrame([("a", "hbm 가격 물량 비교 그리고 재고 계약 n7"), ("b", "n3 계약")], "qid string, question string")
    state = {False: asked.withColumn("subs", F.array("question")), True: asked.withColumn("subs", G.subqueries())}
    found = {}
    for name in ("v1_hybrid", "v4_decompose"):
        p = G.PRESETS[name]
        found[name] = G._retrieve(state[p.decompose], retriever, p, shared).orderBy("qid", "rank").collect()
    assert made == [50]
    # the plain preset has what it finds by itself
    assert found["v1_hybrid"] == G._retrieve(state[False], retriever, G.PRESETS["v1_hybrid"]).orderBy("qid", "rank").collect()
