"""Evaluation sets from the corpus: generation, checks, review, evidence and mix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokens as K
from millrace.operators.dedup import question_key
from millrace.session import cut

ACCEPTED = ["채택", "수정 후 채택"]
FOUND, NO_DOCUMENT, HOLD = "근거 확보", "문서 없음", "보류"
UNANSWERABLE = "답없음"
#: Wanted shares of question types.
TARGET_MIX = {"사실": 0.30, "수치": 0.25, "종합": 0.15, "기간": 0.10, "비교": 0.10, "답없음": 0.10}
#: Words that point at a text that the reader of a question does not see.
DEICTIC = "(이 문서|위 자료|본 자료|해당 문서|아래 표|위 표)"
#: Acceptance limits of the automatic sets, (set, metric, operator, limit).
LIMITS = [("known-item", "recall_5", ">=", 0.95), ("known-item", "recall_1", ">=", 0.80), ("title", "recall_5", ">=", 0.90), ("dup-pair", "recall_10", ">=", 0.70), ("synthetic", "recall_5", ">=", 0.80), ("synthetic", "mrr", ">=", 0.60)]
EVAL_COLUMNS = ["question", "q_type", "level", "gold_doc_ids", "gold_text", "src_chunk"]


def shuffled(*ids: str, seed: int = 7) -> Column:
    """An order that any engine repeats: the md5 of seed and ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def _numbered(df: DataFrame, prefix: str, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order`` with ids; only those n rows reach the one partition that numbers them."""
    first = df.orderBy(*order).limit(n) if n else df
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    return first.withColumn("qid", F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), 4, "0")))


def known_items(docs: DataFrame, n: int = 200, seed: int = 7, least: int = 80, korean: bool = True) -> DataFrame:
    """One sentence of the corpus per document as a question, its document as the answer. Documents without a fit sentence have none."""
    sents = docs.where(F.length("text") >= least).select("doc_id", "chunk_id", F.explode(T.candidate_sentences("text", korean=korean)).alias("s"))
    order = shuffled("doc_id", "chunk_id", "s", seed=seed)
    picked = sents.groupBy("doc_id").agg(F.min(F.struct(order.alias("o"), "chunk_id", "s")).alias("p"))
    rows = picked.select(F.col("p.s").alias("question"), F.lit("known-item").alias("q_type"), T.difficulty(F.col("p.s")).alias("level"), F.col("doc_id").alias("gold_doc_ids"), F.col("p.s").alias("gold_text"), F.col("p.chunk_id").alias("src_chunk"), F.col("p.o").alias("o"))
    return _numbered(rows, "K", ["o", "gold_doc_ids"], n).select("qid", *EVAL_COLUMNS)


def title_queries(docs: DataFrame, n: int = 200, seed: int = 7, least: int = 8) -> DataFrame:
    """Titles as questions for their documents."""
    rows = docs.where(F.length("title") >= least).select(F.col("title").alias("question"), F.lit("title").alias("q_type"), F.lit("easy").alias("level"), F.col("doc_id").alias("gold_doc_ids"), F.lit("").alias("gold_text"), F.lit("").alias("src_chunk"), shuffled("doc_id", "title", seed=seed).alias("o"))
    return _numbered(rows, "T", ["o", "gold_doc_ids", "question"], n).select("qid", *EVAL_COLUMNS)


def duplicate_queries(links: DataFrame, docs: DataFrame, n: int = 100, seed: int = 7, korean: bool = True) -> DataFrame:
    """A sentence of the first document of each near-duplicate link; both documents are right. ``docs``: (id, text)."""
    sents = links.join(docs.select(F.col("id").alias("id_a"), "text"), "id_a").select("id_a", "id_b", "similarity", F.explode(T.candidate_sentences("text", korean=korean)).alias("s"))
    picked = sents.groupBy("id_a", "id_b", "similarity").agg(F.min(F.struct(shuffled("id_a", "id_b", "s", seed=seed).alias("o"), "s")).alias("p"))
    rows = picked.select(F.col("p.s").alias("question"), F.lit("dup-pair").alias("q_type"), F.lit("hard").alias("level"), F.concat_ws(";", "id_a", "id_b").alias("gold_doc_ids"), F.lit("").alias("gold_text"), F.lit("").alias("src_chunk"), F.col("p.o").alias("o"))
    return _numbered(rows, "D", ["o", "gold_doc_ids"], n).select("qid", *EVAL_COLUMNS)


def synthetic_queries(docs: DataFrame, ask: Callable[[str], str], n: int = 100, seed: int = 7, least: int = 120) -> DataFrame:
    """Questions that the injected ``ask(chunk text)`` writes on the executors; too short, too long and copied ones are dropped, failures skipped.

    Chunks are asked in a fixed random order, some at a time, until ``n`` questions are accepted or no chunk is left.
    """
    texts = docs.where(F.length("text") >= least).withColumn("o", shuffled("chunk_id", seed=seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = []
            for text in pdf["text"]:
                try:
                    asked.append(str(ask(text[:1200])).strip().split("\n")[0])
                except Exception:
                    asked.append("")
            yield pdf.assign(question=asked)

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", question string"
    kept, n_kept, last = None, 0, None
    while n_kept < n:
        pool = cut((texts if last is None else texts.where(F.struct("o", "chunk_id") > F.struct(F.lit(last[0]), F.lit(last[1])))).orderBy("o", "chunk_id").limit(3 * n), "pool")
        last = pool.agg(F.max(F.struct("o", "chunk_id")).alias("m")).first().m
        if last is None:
            break
        made = pool.mapInPandas(run, schema).withColumn("question", F.regexp_replace("question", r"^[-*0-9.\s]+", ""))
        fit = cut(made.where(F.length("question").between(8, 120)).where(K.coverage("question", "text") <= 0.6), "asked")
        kept = fit if kept is None else kept.unionByName(fit)
        n_kept += fit.count()
    if kept is None:
        kept = texts.limit(0).withColumn("question", F.lit(""))
    rows = kept.select("question", F.lit("synthetic").alias("q_type"), F.lit("mid").alias("level"), F.col("doc_id").alias("gold_doc_ids"), F.substring("text", 1, 200).alias("gold_text"), F.col("chunk_id").alias("src_chunk"), "o")
    return _numbered(rows, "S", ["o", "src_chunk"], n).select("qid", *EVAL_COLUMNS)


def screen(evals: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """(qid, found, first_rank): whether a right document is among the first k hits and where."""
    gold = evals.select("qid", F.explode(gold_ids("gold_doc_ids")).alias("doc_id")).distinct()
    met = hits.where(F.col("rank") <= k).join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return evals.select("qid").join(met, "qid", "left").select("qid", F.col("first_rank").isNotNull().alias("found"), "first_rank")


def gold_ids(c: str) -> Column:
    """Ids of a semicolon list, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def uniqueness(hits: DataFrame, n: int = 5) -> DataFrame:
    """(qid, uniqueness): share of the first n hits that lie in the document of the first hit."""
    near = hits.where(F.col("rank") <= n)
    first = near.where("rank = 1").select("qid", F.col("doc_id").alias("d"))
    return near.join(first, "qid").groupBy("qid").agg(F.round(F.avg((F.col("doc_id") == F.col("d")).cast("double")), 6).alias("uniqueness"))


def sample_chunks(docs: DataFrame, types: DataFrame, per_type: int = 10, least: int = 150) -> DataFrame:
    """(doc_type, doc_id, chunk_id, text, has_num): up to ``per_type`` chunks a type, those with figures first."""
    met = docs.where(F.length("text") >= least).join(types, "doc_id", "left").withColumn("has_num", F.col("text").rlike(T.NUMBER))
    w = Window.partitionBy("doc_type").orderBy(F.desc("has_num"), "chunk_id")
    return met.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_type).select("doc_type", "doc_id", "chunk_id", "text", "has_num")


def rule_questions(sampled: DataFrame) -> DataFrame:
    """Questions by template: the evidence is the first sentence with a figure, else the first; without a sentence, no row. ``sampled`` needs title too."""
    sents = T.sentences("text", 26)
    evidence = F.coalesce(F.get(F.filter(sents, lambda s: s.rlike(T.NUMBER)), F.lit(0)), F.get(sents, F.lit(0)))
    met = sampled.withColumn("ev", evidence).where(F.col("ev").isNotNull())
    words = F.slice(F.regexp_extract_all("ev", F.lit(K.KEYWORD), F.lit(0)), 1, 4)
    key = F.regexp_replace(F.array_join(words, " "), r"[는은이가을를]\s*$", "")
    subject = F.coalesce(F.nullif(F.substring(F.coalesce("title", F.lit("")), 1, 40), F.lit("")), "doc_type", F.lit(""))
    return met.select(
        F.concat(F.lit("G-"), "chunk_id").alias("qid"), F.concat(subject, F.lit(" 자료에서 "), key, F.lit(" 관련 수치는?")).alias("question"), F.substring("ev", 1, 160).alias("gold_answer"), F.substring("ev", 1, 200).alias("gold_text"),
        F.when(F.col("ev").rlike(T.NUMBER), "수치").otherwise("사실").alias("q_type"), F.lit("mid").alias("level"), F.col("doc_id").alias("gold_doc_ids"), F.col("chunk_id").alias("src_chunk"), "doc_type",
    )


def parse_item(answer: str) -> Column:
    """The JSON object of a model's free answer as a struct; null unless question, answer and evidence are there."""
    found = F.from_json(F.regexp_extract(F.coalesce(F.col(answer), F.lit("")), r"(?s)\{.*\}", 0), "question string, answer string, evidence string, q_type string, level string")
    return F.when(found.question.isNotNull() & found.answer.isNotNull() & found.evidence.isNotNull(), found)


def unanswerable(spark, n: int = 6) -> DataFrame:
    """Questions that no document answers, by template; gold ids are blank."""
    # fixed values: the templates
    base = ["보유 자료에 없는 기간의 월별 수치를 묻는 질문", "보유 자료에 없는 업체의 실적을 묻는 질문", "보유 자료에 없는 지표의 전망을 묻는 질문"]
    pick = F.get(F.array(*map(F.lit, base)), (F.col("id") % 3).cast("int"))
    return spark.range(n).select(F.concat(F.lit("N"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("qid"), F.concat(pick, F.lit(" (변형 "), (F.col("id") + 1).cast("string"), F.lit(")")).alias("question"), F.lit("확인된 자료 없음").alias("gold_answer"), F.lit("").alias("gold_text"), F.lit(UNANSWERABLE).alias("q_type"), F.lit("mid").alias("level"), F.lit("").alias("gold_doc_ids"), F.lit("").alias("src_chunk"))


def self_check(golden: DataFrame, docs: DataFrame, retrievable: DataFrame | None = None) -> DataFrame:
    """(qid, ev_ok, copy_ok, deictic_ok, length_ok, first_ok, recall_ok, verdict, reasons) for generated questions.

    Evidence stands in its chunk (0.8 of its 3-grams), the question is no copy of it (0.6 at most), points at nothing,
    has 8 to 150 characters, and is the first of its key by qid. ``retrievable``: (qid, found) of a search.
    """
    met = golden.join(docs.select(F.col("chunk_id").alias("src_chunk"), F.col("text").alias("src")), "src_chunk", "left")
    has = (F.coalesce("gold_text", F.lit("")) != "") & (F.coalesce("src", F.lit("")) != "")
    question = F.coalesce("question", F.lit(""))
    first = met.groupBy(question_key().alias("k")).agg(F.min("qid").alias("first_qid"))
    met = met.withColumn("k", question_key()).join(first, "k")
    met = met.join(retrievable.select("qid", F.col("found").alias("recall_ok")), "qid", "left") if retrievable is not None else met.withColumn("recall_ok", F.lit(None).cast("boolean"))
    flags = {
        "ev_ok": F.when(has, K.coverage("gold_text", "src") >= 0.8).otherwise(F.col("q_type") == UNANSWERABLE), "copy_ok": K.coverage("question", "src") <= 0.6,
        "deictic_ok": ~question.rlike(DEICTIC), "length_ok": F.length(question).between(8, 150), "first_ok": F.col("qid") == F.col("first_qid"),
    }
    names = {"ev_ok": "근거 실재", "copy_ok": "복붙 아님", "deictic_ok": "지시어 없음", "length_ok": "길이 적정", "first_ok": "중복 아님"}
    out = met.select("qid", *(v.alias(k) for k, v in flags.items()), "recall_ok")
    passed = F.col("ev_ok") & F.col("copy_ok") & F.col("deictic_ok") & F.col("length_ok") & F.col("first_ok") & F.coalesce("recall_ok", F.lit(True))
    reasons = F.concat_ws(" · ", *(F.when(~F.col(k), v) for k, v in names.items()))
    reasons = F.when((reasons == "") & (F.col("recall_ok") == False), "정답 문서 미회수").otherwise(reasons)  # noqa: E712
    return out.withColumn("verdict", F.when(passed, "통과").otherwise("보류")).withColumn("reasons", reasons)


def apply_check(golden: DataFrame, checked: DataFrame) -> DataFrame:
    return golden.join(checked.select("qid", "verdict", "reasons", "recall_ok"), "qid", "left").orderBy("verdict", "q_type", "qid")


def mix_report(golden: DataFrame, target: dict[str, float] = TARGET_MIX) -> DataFrame:
    """(q_type, wanted, actual, share, verdict) for every wanted type; under 0.6 of the wanted number is short, over 1.5 too many."""
    n = golden.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    want = golden.sparkSession.createDataFrame(list(target.items()), "q_type string, part double")
    met = want.join(golden.groupBy("q_type").agg(F.count(F.lit(1)).alias("actual")), "q_type", "left").na.fill(0, ["actual"])
    goal = F.col("part") * n
    word = F.when(F.col("actual") < goal * 0.6, "부족").when(F.col("actual") > goal * 1.5, "과다").otherwise("적정")
    return met.select("q_type", F.round(goal, 6).alias("wanted"), "actual", F.round(F.try_divide("actual", F.lit(n)), 6).alias("share"), word.alias("verdict"))


def to_review(sets: dict[str, DataFrame]) -> DataFrame:
    """The sheet that reviewers fill: questions of all sets with empty review columns."""
    blank = ["verdict", "new_question", "new_gold_doc_ids", "reason", "reviewer", "reviewed_on"]
    parts = [df.select("qid", F.lit(name).alias("set_name"), "level", "question", "gold_doc_ids", "gold_text", *(F.lit("").alias(b) for b in blank)) for name, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_review(sheet: DataFrame, q_type: str = "사실") -> DataFrame:
    """The reviewed questions that were accepted, with edits where they are not blank."""
    edited = lambda new, old: F.coalesce(F.nullif(F.trim(F.coalesce(F.col(new), F.lit(""))), F.lit("")), F.col(old))
    return sheet.where(F.col("verdict").isin(*ACCEPTED)).select("qid", edited("new_question", "question").alias("question"), F.lit(q_type).alias("q_type"), edited("new_gold_doc_ids", "gold_doc_ids").alias("gold_doc_ids"), "gold_text", "level", F.concat(F.lit("자동-"), "set_name").alias("origin"), F.col("reason").alias("memo"))


def link_evidence(questions: DataFrame, hits: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """Candidates for each question to be judged; a question without hits keeps one row of rank 0. ``meta``: one row per doc_id."""
    near = hits.where(F.col("rank") <= k).join(meta.select("doc_id", "doc_type", "published_at"), "doc_id", "left")
    met = questions.select("qid", "question", "q_type").join(near, "qid", "left")
    lead = F.coalesce(F.col("rank"), F.lit(1)) == 1
    return met.select(
        "qid", F.when(lead, F.col("question")).otherwise("").alias("question"), F.when(lead, F.col("q_type")).otherwise("").alias("q_type"), F.coalesce("rank", F.lit(0)).alias("cand_rank"), F.coalesce("doc_id", F.lit("")).alias("cand_doc_id"),
        F.coalesce("doc_type", F.lit("")).alias("cand_doc_type"), F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")).alias("cand_date"), F.coalesce(F.substring("text", 1, 300), F.lit("(검색 결과 없음)")).alias("cand_text"), F.round("score", 4).alias("score"),
    )


def apply_evidence(linked: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(golden, coverage) of judged candidates: found beats no document beats hold; ids joined in order, the first text kept.

    ``linked`` needs qid, cand_rank, verdict, doc_id, gold_text.
    """
    d = linked.select("qid", "cand_rank", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("verdict", "doc_id", "gold_text")))
    ok = d.where(F.col("verdict") == FOUND).groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("doc_id"), F.lit("")))), ";").alias("gold_doc_ids"),
        F.coalesce(F.min_by("gold_text", F.when(F.col("gold_text") != "", F.col("cand_rank"))), F.lit("")).alias("gold_text"),
    )
    state = d.groupBy("qid").agg(F.when(F.max(F.col("verdict") == FOUND), FOUND).when(F.max(F.col("verdict") == NO_DOCUMENT), NO_DOCUMENT).otherwise(HOLD).alias("state"))
    golden = questions.drop("gold_doc_ids", "gold_text").join(ok, "qid")
    return golden, state.join(questions.select("qid", "q_type"), "qid", "left")


def coverage_report(coverage: DataFrame) -> DataFrame:
    c = lambda s: F.count_if(F.col("state") == s)
    n = F.count(F.lit(1))
    return coverage.agg(n.alias("n_questions"), c(FOUND).alias("n_found"), c(NO_DOCUMENT).alias("n_no_document"), c(HOLD).alias("n_hold"), F.round(F.coalesce(F.try_divide(c(FOUND), n), F.lit(0.0)), 3).alias("found_rate"))


def sample_error(n: Column) -> Column:
    """Half width of the 95 % interval of a share of one half, in per cent points."""
    return F.round(F.lit(1.96) * F.sqrt(F.lit(0.25) / n) * 100, 1)


def against_limits(measured: DataFrame, limits: list[tuple] = LIMITS) -> DataFrame:
    """(set_name, metric, op, threshold, value, verdict); a limit that nothing was measured for has verdict '-'. ``measured``: (set_name, metric, value)."""
    table = measured.sparkSession.createDataFrame(limits, "set_name string, metric string, op string, threshold double")
    met = table.join(measured, ["set_name", "metric"], "left")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return met.withColumn("verdict", F.when(F.col("value").isNull(), "-").when(ok, "pass").otherwise("fail"))


def smoke_template(questions: DataFrame, hits: DataFrame, answers: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Hits and answers of each question for people to judge; question, answer and judgement columns only on rank 1."""
    met = hits.where(F.col("rank") <= k).join(questions.select("qid", "q_type", "question"), "qid")
    met = met.join(answers, "qid", "left") if answers is not None else met.withColumn("answer", F.lit(""))
    once = lambda c: F.when(F.col("rank") == 1, c)
    return met.select("qid", "q_type", F.coalesce(once(F.col("question")), F.lit("")).alias("question"), "rank", "doc_id", F.substring("text", 1, 300).alias("text"), F.coalesce(once(F.coalesce("answer", F.lit(""))), F.lit("")).alias("answer"), *(once(F.lit("")).alias(c) for c in ("search_verdict", "answer_verdict", "failure")))
