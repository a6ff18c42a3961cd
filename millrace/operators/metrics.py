"""Retrieval and answer metrics, as aggregates over hits and expressions over answers. A metric that does not apply is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.functions.text import sentences
from millrace.operators.evalsets import UNANSWERABLE, gold_ids

KS = (1, 3, 5, 10)
JUDGED, GROUNDED, ELEMENT = 0.5, 0.30, 0.25
#: What shows a figure, a period, a citation, caution or a refusal in an answer.
PATTERNS = {
    "has_number": r"\d[\d,\.]*\s*(?:%|원|달러|USD|EB|TB|GB|억|조|배|bp|p)?",
    "has_period": r"(20\d{2}\s*년|\d\s*분기|[1-4]Q\s*\d{0,2}|\d{1,2}\s*월|상반기|하반기|전년|전분기|전월)",
    "has_citation": r"\[(\d+|DB)[^\]]*\]",
    "has_hedge": r"(전망|추정|예상|가능성|것으로 보|로 추정|전망치)",
    "refused": r"(확인된 자료 없음|자료가 없|확인 불가|알 수 없|제공되지 않)",
}
#: Fixed values: (group, metric, operator, limit) of an accepted system.
CATALOG = [
    ("retrieval", "recall_5", ">=", 0.80), ("retrieval", "recall_10", ">=", 0.90), ("retrieval", "precision_5", ">=", 0.40), ("retrieval", "mrr", ">=", 0.65), ("retrieval", "map", ">=", 0.55), ("retrieval", "ndcg_10", ">=", 0.70),
    ("retrieval", "context_precision", ">=", 0.50), ("retrieval", "context_recall", ">=", 0.75), ("answer", "faithfulness", ">=", 0.85), ("answer", "answer_relevancy", ">=", 0.70), ("answer", "answer_correctness", ">=", 0.75),
    ("answer", "citation_accuracy", ">=", 0.90), ("answer", "hallucination", "<=", 0.05), ("answer", "refusal_ok", ">=", 0.80), ("operation", "search_p95_s", "<=", 2.0), ("operation", "run_drift", "<=", 0.02),
]


def judge(hits: DataFrame, golden: DataFrame, threshold: float = JUDGED) -> DataFrame:
    """``hits`` with ``rel`` and the number of right documents ``n_gold``: the document is right and, where there is a gold text, the chunk covers enough of it."""
    gold = golden.select("qid", gold_ids("gold_doc_ids").alias("gold"), F.coalesce("gold_text", F.lit("")).alias("gold_text"))
    met = hits.join(gold, "qid")
    right = F.array_contains("gold", F.col("doc_id")) & ((F.col("gold_text") == "") | (K.coverage("gold_text", "text", 1.0) >= threshold))
    return met.withColumn("rel", F.coalesce(right, F.lit(False)).cast("int")).withColumn("n_gold", F.size(F.array_distinct("gold"))).drop("gold", "gold_text")


def retrieval_metrics(judged: DataFrame, golden: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per question (and mode): first right rank, mrr, hit, recall, ndcg and precision at each k, average precision.

    Questions without right documents are left out; one without hits scores 0. Gains count chunks, so ndcg may exceed 1
    where several chunks of one document are right.
    """
    by = by or []
    rank, rel = F.col("rank"), F.col("rel")
    at = lambda k: rank <= k
    gain = rel / F.log2(rank + 1)
    aggs = [F.min(F.when(rel == 1, rank)).alias("first_hit_rank"), F.max("n_gold").alias("n_gold")]
    for k in ks:
        aggs += [F.max(F.when(at(k), rel).otherwise(0)).alias(f"hit_{k}"), F.count_distinct(F.when(at(k) & (rel == 1), F.col("doc_id"))).alias(f"__r{k}"), F.sum(F.when(at(k), gain).otherwise(0.0)).alias(f"__g{k}"), F.sum(F.when(at(k), rel).otherwise(0)).alias(f"__p{k}")]
    aggs.append(F.array_sort(F.collect_list(F.when(rel == 1, rank))).alias("__at"))
    per = judged.groupBy("qid", *by).agg(*aggs)
    base = golden.where(F.size(gold_ids("gold_doc_ids")) > 0).select("qid", F.size(F.array_distinct(gold_ids("gold_doc_ids"))).alias("__n"))
    if by:
        # the runs that were judged, a handful of names, so that a question without hits counts in each
        names = [F.struct(*(F.lit(v).alias(c) for c, v in zip(by, r, strict=True))) for r in judged.select(*by).distinct().collect()]
        if names:
            base = base.select("*", F.explode(F.array(*names)).alias("b")).select("qid", "__n", "b.*")
        else:
            base = base.select("*", *(F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in by)).limit(0)
    met = base.join(per, ["qid", *by], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("__n"), F.lit(1)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    hits = F.size(F.coalesce("__at", F.array().cast("array<int>")))
    ap = F.when(hits > 0, F.aggregate(F.transform("__at", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x) / hits).otherwise(0.0)
    r6 = lambda c: F.round(c, 6)
    return met.select(
        "qid", *by, "first_hit_rank", r6(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0))).alias("mrr"), r6(ap).alias("ap"),
        *(x for k in ks for x in (z(f"hit_{k}").alias(f"hit_{k}"), r6(z(f"__r{k}") / F.col("__n")).alias(f"recall_{k}"), r6(z(f"__g{k}") / ideal(k)).alias(f"ndcg_{k}"), r6(z(f"__p{k}") / k).alias(f"precision_{k}"))),
    )


def means(detail: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean of each metric by key, rounded to three digits; nulls are skipped."""
    return detail.groupBy(*by).agg(*(F.round(F.avg(c), 3).alias(c) for c in columns))


def pivot_means(detail: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """Mean of a metric, keys down and ``values`` across."""
    return detail.groupBy(row).pivot(column, values).agg(F.round(F.avg(metric), 3))


def faithfulness(answers: DataFrame, threshold: float = GROUNDED) -> DataFrame:
    """(qid, faithfulness): share of an answer's sentences of ten characters or more that one context covers enough of; null without sentences. ``answers``: (qid, answer, contexts)."""
    sents = answers.select("qid", "contexts", F.explode(sentences("answer", 10)).alias("s"))
    best = F.coalesce(F.array_max(F.transform("contexts", lambda c: K.share_in(K.char_grams("s"), K.char_grams(c), 0.0))), F.lit(0.0))
    per = sents.select("qid", best.alias("best")).groupBy("qid").agg(F.round(F.avg((F.col("best") >= threshold).cast("double")), 6).alias("faithfulness"))
    return answers.select("qid").join(per, "qid", "left")


def citations(answer: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")), F.lit(PATTERNS["has_citation"]), F.lit(1))


def citation_accuracy(answer: str, n_contexts: Column) -> Column:
    """Share of cited numbers that name a context, DB always does; null without citations."""
    names_one = lambda c: (c == "DB") | F.coalesce(c.try_cast("int").between(F.lit(1), n_contexts), F.lit(False))
    return K.let(citations(answer), lambda found: F.when(F.size(found) > 0, F.round(F.size(F.filter(found, names_one)) / F.size(found), 6)))


def structure(answer: str) -> list[Column]:
    text = F.coalesce(F.col(answer), F.lit(""))
    return [text.rlike(p).alias(name) for name, p in PATTERNS.items()]


def refusal_ok(answer: str, unanswerable: Column) -> Column:
    return (F.coalesce(F.col(answer), F.lit("")).rlike(PATTERNS["refused"]) == unanswerable).cast("int")


def element_coverage(must: str, answer: str, threshold: float = ELEMENT) -> Column:
    """Share of the required elements that the answer covers by 3-grams or keywords; parentheses do not count, null without elements."""
    elements = gold_ids(must)
    key = lambda e: F.regexp_replace(e, r"\([^)]*\)", "")
    met = F.filter(elements, lambda e: F.greatest(K.coverage(key(e), answer), K.element_hit(key(e), answer)) >= threshold)
    return F.when(F.size(elements) > 0, F.round(F.size(met) / F.size(elements), 6))


def evaluate_answers(answers: DataFrame) -> DataFrame:
    """One row of metrics per answer. ``answers``: (qid, q_type, question, answer, contexts, must_include, gold_text)."""
    relevance = F.greatest(K.coverage("question", "answer"), K.coverage("answer", "question"))
    recall = F.when(F.trim(F.coalesce("gold_text", F.lit(""))) != "", F.round(K.coverage("gold_text", F.array_join("contexts", " ")), 6))
    rows = answers.select(
        "qid", "q_type", F.round(relevance, 6).alias("answer_relevancy"), element_coverage("must_include", "answer").alias("answer_correctness"), citation_accuracy("answer", F.size("contexts")).alias("citation_accuracy"),
        F.size(citations("answer")).alias("n_citation"), recall.alias("context_recall"), refusal_ok("answer", F.coalesce(F.col("q_type") == UNANSWERABLE, F.lit(False))).alias("refusal_ok"), *structure("answer"),
    )
    return rows.join(faithfulness(answers), "qid", "left")


def against_catalog(measured: DataFrame) -> DataFrame:
    """(grp, metric, op, threshold, value, verdict) of the catalog; a metric that was not measured fails nothing and has '-'. ``measured``: (metric, value)."""
    table = measured.sparkSession.createDataFrame(CATALOG, "grp string, metric string, op string, threshold double")
    met = table.join(measured, "metric", "left")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return met.withColumn("verdict", F.when(F.col("value").isNull(), "-").when(ok, "pass").otherwise("fail"))


def parse_scores(reply: str) -> Column:
    """Integer scores of a judge's JSON reply; an empty map where there is none."""
    body = F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"\{[^{}]+\}", 0)
    return F.coalesce(F.from_json(F.nullif(body, F.lit("")), "map<string,int>"), F.create_map().cast("map<string,int>"))
