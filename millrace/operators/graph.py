"""Question answering as a fixed graph of table steps: route, decompose, retrieve, grade, rewrite once, generate, verify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.operators import metrics as M
from millrace.operators import retrieval as R
from millrace.session import cut

#: What makes a question metric, comparing, manifold.
METRIC_HINT = "(매출|출하|재고|가격|ASP|수량|추이|합계|평균|월별|분기별|전월|전년)"
COMPARING = r"(대비|비교|차이|vs\.?|와 |과 |각각)"
MANIFOLD = "(그리고|및|또한|이유|배경|영향|전망|요약)"
CONJUNCTION = r"(?:와|과|,|그리고|및)\s+"
REFUSAL, WITHHELD = "확인된 자료 없음", "확인된 자료 없음 (근거 불충분)"
LONG_QUESTION, GRADE_COVERAGE, GRADE_KEYWORDS, LEAST_FAITH = 25, 0.06, 0.25, 0.6


@dataclass(frozen=True)
class Preset:
    name: str
    mode: str
    decompose: bool = False
    grade: bool = False
    rewrite: bool = False
    verify: bool = False
    k: int = 6
    cand: int = 50


_FULL = "hybrid+rerank+mmr"
PRESETS = {
    p.name: p
    for p in (
        Preset("v0_baseline", "bm25"), Preset("v1_hybrid", "hybrid"), Preset("v2_rerank", "hybrid+rerank"), Preset("v3_mmr", _FULL), Preset("v4_decompose", _FULL, True),
        Preset("v5_grade", _FULL, True, True, True), Preset("v6_verify", _FULL, True, True, True, True),
    )
}


def preset(name: str = "v6_verify", **overrides) -> Preset:
    return replace(PRESETS[name], **overrides)


def route(question: str = "question") -> Column:
    q = F.coalesce(F.col(question), F.lit(""))
    return F.when(q.rlike(METRIC_HINT), F.when(F.length(q) > LONG_QUESTION, "hybrid").otherwise("sql")).otherwise("rag")


def subqueries(question: str = "question") -> Column:
    """The question and up to two of its parts of more than five characters; simple questions stay whole."""
    q = F.coalesce(F.col(question), F.lit(""))
    parts = F.filter(F.transform(F.split(q, CONJUNCTION), lambda x: F.trim(x)), lambda p: F.length(p) > 5)
    return F.when((q.rlike(COMPARING) | q.rlike(MANIFOLD)) & (F.size(parts) > 1), F.concat(F.array(q), F.slice(parts, 1, 2))).otherwise(F.array(q))


def grade(question: str = "question", text: str = "text") -> Column:
    return (K.coverage(question, text) >= GRADE_COVERAGE) | (K.keyword_overlap(question, text) >= GRADE_KEYWORDS)


def rewritten(question: str = "question") -> Column:
    """A shorter query of the first eight keywords, and the question itself."""
    q = F.coalesce(F.col(question), F.lit(""))
    return F.array(F.array_join(F.slice(F.regexp_extract_all(q, F.lit(K.KEYWORD), F.lit(0)), 1, 8), " "), q)


def _retrieve(state: DataFrame, retriever: R.Retriever, p: Preset, shared: dict | None = None) -> DataFrame:
    """Hits of all sub-queries; several lists of one question are fused by rank, one stays as it is.

    ``shared`` keeps the sub-queries, the hits of every part and those of a mode, so that presets search once. Where one
    of them decomposes, all search its sub-queries: the first is the question itself, and the others take that one only.
    """
    own = lambda subs: subs.select("qid", F.posexplode("subs").alias("i", "question")).withColumn("sid", F.concat_ws("#", "qid", "i"))
    asked = lambda subs: subs.select(F.col("sid").alias("qid"), "question")
    if shared is None:
        subs = own(state)
        hits = cut(retriever.search(asked(subs), p.mode, 2 * p.k, p.cand), "sub-hits")
    else:
        wide = p.decompose or shared.get("decompose", False)
        every = _once(shared, ("subs", wide), lambda: cut(own(state.withColumn("subs", subqueries()) if wide else state), "sub-queries"))
        lists = _once(shared, ("lists", wide, p.cand), lambda: retriever.lists(asked(every), p.cand))
        hits = _once(shared, ("hits", wide, p.mode, p.k, p.cand), lambda: cut(retriever.search(asked(every), p.mode, 2 * p.k, p.cand, lists=lists), "sub-hits"))
        subs = every if p.decompose else every.where("i = 0")
    listed = hits.withColumnRenamed("qid", "sid").join(subs.select("sid", "qid", "i"), "sid")
    several = state.select("qid", (F.size("subs") > 1).alias("several"))
    scores = listed.join(several, "qid").groupBy("qid", "chunk_id").agg(F.round(F.sum(F.when(F.col("several"), 1 / (R.RRF_K + F.col("rank"))).otherwise(-F.col("rank").cast("double"))), 9).alias("score"), F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    return R.top(scores, 2 * p.k)


def _once(shared: dict, key: tuple, make: Callable):
    """What ``make`` gives, mostly a table that several presets read, made on first use; ``key`` holds every setting that it depends on."""
    if key not in shared:
        shared[key] = make()
    return shared[key]


def run(questions: DataFrame, retriever: R.Retriever, p: Preset, answer: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, shared: dict | None = None) -> DataFrame:
    """One row per question: route, sub-queries, contexts, answer, faithfulness, retries and trace.

    ``shared`` keeps what presets of equal settings have in common, over the same questions and retriever. The rewrite is
    one further pass over the questions whose hits were all graded out, joined back; generation is extractive unless ``answer(questions, hits, k)`` is given, which is asked once more where its answer is weakly
    grounded; one that stays weak is withheld and says so.
    """
    state = questions.select("qid", "question", route().alias("route"), (subqueries() if p.decompose else F.array(F.coalesce("question", F.lit("")))).alias("subs"))
    shared = {} if shared is None else shared
    ask = ("docs", p.mode, p.decompose, p.k, p.cand)
    docs = _once(shared, ask, lambda: cut(_retrieve(state, retriever, p, shared), "graph-docs"))
    keep = lambda d: d.join(questions.select("qid", "question"), "qid").where(grade()).drop("question") if p.grade else d
    ask = ("graded", *ask[1:], p.grade)
    graded = _once(shared, ask, lambda: cut(keep(docs), "graph-graded")) if p.grade else docs
    retried = questions.select("qid", F.lit(0).alias("retry"))
    if p.rewrite:
        first = graded
        lost = _once(shared, ("lost", *ask[1:]), lambda: cut(questions.join(first.select("qid").distinct(), "qid", "left_anti"), "graph-lost"))
        second = lambda: cut(first.unionByName(keep(_retrieve(lost.select("qid", rewritten().alias("subs")), retriever, p))), "graph-graded2")
        graded = _once(shared, ("graded2", *ask[1:]), lambda: first if lost.isEmpty() else second())
        retried = questions.select("qid").join(lost.select("qid", F.lit(1).alias("retry")), "qid", "left").na.fill(0, ["retry"])
    ranked = graded.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "chunk_id")))
    top = ranked.where(F.col("rank") <= p.k)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    contexts = top.groupBy("qid").agg(in_order("text").alias("contexts"), in_order("chunk_id").alias("chunk_ids"), in_order("doc_id").alias("doc_ids"))
    answers = (answer or (lambda q, h, n: R.extractive_answers(q, h, n, refusal=REFUSAL)))(questions, top, p.k)
    out = state.join(retried, "qid").join(contexts, "qid", "left").join(answers, "qid", "left")
    empty = F.array().cast("array<string>")
    out = out.select("qid", "question", "route", F.size("subs").alias("n_sub"), "retry", F.coalesce("contexts", empty).alias("contexts"), F.coalesce("chunk_ids", empty).alias("chunk_ids"), F.coalesce("doc_ids", empty).alias("doc_ids"), F.coalesce("answer", F.lit(REFUSAL)).alias("answer"))
    if p.verify:
        out = cut(out, "graph-answers")
        out = out.join(M.faithfulness(out.select("qid", "answer", "contexts")), "qid", "left")
        weak = (F.size("contexts") > 0) & (F.col("faithfulness") < LEAST_FAITH)
        out = out.withColumn("regen", F.coalesce(weak, F.lit(False)).cast("int"))
        if answer:
            # a weak answer is made once more; an extractive one would come out the same
            lost = cut(out.where("regen = 1").drop("faithfulness"), "graph-weak")
            again = answer(questions.join(lost.select("qid"), "qid", "left_semi"), top.join(lost.select("qid"), "qid", "left_semi"), p.k)
            second = cut(lost.drop("answer").join(again.select("qid", "answer"), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL))), "graph-second")
            second = second.join(M.faithfulness(second.select("qid", "answer", "contexts")), "qid", "left")
            out = out.where("regen = 0").unionByName(second)
        out = out.withColumn("answer", F.when(F.coalesce(weak, F.lit(False)), WITHHELD).otherwise(F.col("answer")))
    else:
        out = out.withColumn("faithfulness", F.lit(None).cast("double")).withColumn("regen", F.lit(0))
    step = lambda node, value: F.struct(F.lit(node).alias("node"), value.cast("string").alias("result"))
    trace = F.array(step("route", F.col("route")), step("decompose", F.col("n_sub")), step("retrieve", F.size("chunk_ids")), step("rewrite", F.col("retry")), step("generate", F.size("contexts")), step("verify", F.round("faithfulness", 3)))
    return out.withColumn("preset", F.lit(p.name)).withColumn("trace", trace)


def compare(presets: list[str], questions: DataFrame, retriever: R.Retriever, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, detail): every preset over every question, with answer and retrieval metrics averaged per preset.

    ``golden``: (qid, q_type, gold_doc_ids, gold_text, must_include).
    """
    shared: dict = {"decompose": any(PRESETS[n].decompose for n in presets)}
    done = reduce(DataFrame.unionByName, [cut(run(questions, retriever, PRESETS[n], shared=shared), f"preset-{n}") for n in presets])
    info = golden.select("qid", "q_type", "gold_text", "must_include")
    # answers are few bytes and dear to measure, so the parts are not merged by their size; the names of presets hold no line break
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = done.join(info, "qid", "left").withColumn("qid", F.concat_ws("\n", "preset", "qid")).drop("faithfulness").repartition(parts, "qid")
    scored = M.evaluate_answers(answers).withColumn("preset", F.substring_index("qid", "\n", 1)).withColumn("qid", F.expr("substring(qid, length(preset) + 2)"))
    hits = done.select("preset", "qid", F.posexplode(F.arrays_zip("doc_ids", "contexts")).alias("i", "h")).select("preset", "qid", (F.col("i") + 1).alias("rank"), F.col("h.doc_ids").alias("doc_id"), F.col("h.contexts").alias("text"))
    judged = M.judge(hits, golden)
    found = judged.groupBy("preset", "qid").agg(F.max(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("hit_5"))
    scorable = golden.where(F.size(M.gold_ids("gold_doc_ids")) > 0).select("qid", F.lit(True).alias("scorable"))
    detail = done.select("preset", "qid", "route", "n_sub", "retry", "regen", "answer").join(scored, ["preset", "qid"]).join(found, ["preset", "qid"], "left").join(scorable, "qid", "left")
    detail = detail.withColumn("hit_5", F.when(F.col("scorable"), F.coalesce("hit_5", F.lit(0)))).drop("scorable")
    mean = lambda c: F.round(F.avg(c), 3).alias(c)
    refusals = F.round(F.avg(F.when(F.col("q_type") == M.UNANSWERABLE, F.col("refusal_ok"))), 3).alias("refusal_ok")
    summary = detail.groupBy("preset").agg(*map(mean, ("hit_5", "faithfulness", "answer_relevancy", "answer_correctness", "citation_accuracy")), refusals, F.sum("retry").alias("n_retry"), F.sum("regen").alias("n_regen"))
    return summary, detail
