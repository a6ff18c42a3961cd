"""Optional services as injected callables: embeddings with a cache table, a search endpoint, a language model."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIED = (429, 500, 502, 503, 504)


class ServiceError(RuntimeError):
    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


def with_retry(call: Callable, tries: int = 3, wait: float = 10.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after transient errors with doubled waits up to ``longest`` seconds."""

    def run(*args, **kwargs):
        pause = wait
        for left in range(tries, -1, -1):
            try:
                return call(*args, **kwargs)
            except ServiceError as error:
                if error.status not in RETRIED or not left:
                    raise
                sleep(pause)
                pause = min(pause * 2, longest)

    return run


def paced(call: Callable, per_minute: int, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable:
    """``call``, at most ``per_minute`` times a minute in each process: calls wait for their turn."""
    turn = [float("-inf")]

    def run(*args, **kwargs):
        now = clock()
        wait = turn[0] + 60 / per_minute - now
        if wait > 0:
            sleep(wait)
        turn[0] = max(now, now + wait)
        return call(*args, **kwargs)

    return run


#: What a model is asked for; {context}, {question}, {answer} and {schema} are filled in.
ANSWER_PROMPT = "다음 근거만 써서 질문에 답하고 문장마다 근거 번호를 [1]처럼 붙인다. 근거에 없으면 '확인된 자료 없음'이라고만 쓴다.\n\n{context}\n\n질문: {question}\n답:"
JUDGE_PROMPT = 'Score the answer from 1 to 5 by its contexts. Reply with one JSON object of integers with the keys "faithfulness", "relevancy" and "correctness".\n\n{context}\n\nQuestion: {question}\nAnswer: {answer}'
SQL_PROMPT = "{schema}\n\nWrite one SELECT for the question, over these views and columns only, without a semicolon and without comment.\n\nQuestion: {question}\nSQL:"


def no_model(prompt: str) -> str:
    """Stands in where no model is configured: it says nothing, and callers fall back to their rules."""
    return ""


def ask_model(rows: DataFrame, ask: Callable[[str], str], prompt: str, out: str = "reply") -> DataFrame:
    """``rows`` with the reply of ``ask`` to the prompt filled with each row's columns, asked on the executors; a failed call gives an empty reply, nulls fill in as blanks."""
    names = [c for c in rows.columns if "{" + c + "}" in prompt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for values in pdf[names].itertuples(index=False):
                text = prompt
                for name, value in zip(names, values, strict=True):
                    text = text.replace("{" + name + "}", "" if value is None else str(value))
                try:
                    replies.append(str(ask(text) or "").strip())
                except Exception:
                    replies.append("")
            yield pdf.assign(**{out: replies})

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` string")


def model_answers(ask: Callable[[str], str] = no_model, build: Callable[[DataFrame, int], DataFrame] | None = None, fallback: str = "확인된 자료 없음") -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """An ``answer(questions, hits, k)`` by a model over the numbered texts of the hits; questions without hits, and empty replies, get the fallback."""

    def answer(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"), F.col("text"))
        context = hits.where(F.col("rank") <= k).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n\n").alias("context"))
        context = build(hits, k) if build else context
        asked = ask_model(questions.select("qid", "question").join(context, "qid"), ask, ANSWER_PROMPT)
        return questions.select("qid").join(asked.select("qid", F.nullif("reply", F.lit("")).alias("reply")), "qid", "left").select("qid", F.coalesce("reply", F.lit(fallback)).alias("answer"))

    return answer


def embed_missing(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 64) -> DataFrame:
    """(key, dense) for the distinct texts that the cache table, keyed by md5 of the text, does not hold yet.

    ``embed`` runs on the executors, a batch at a time; union the result with the cache to have all vectors. ``paced``
    keeps a service's limit of calls.
    """
    asked = texts.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    misses = asked.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"], "dense": embed(part["text"].tolist())})

    return misses.mapInPandas(run, "key string, dense array<float>")


def dig(js: dict | list, path: str):
    """The value at a dotted path of a nested answer; None where it ends early."""
    for step in path.split("."):
        if isinstance(js, list):
            js = js[int(step)] if step.isdigit() and int(step) < len(js) else None
        elif isinstance(js, dict):
            js = js.get(step)
        else:
            return None
    return js


def search_service(questions: DataFrame, call: Callable[[str, int], list[dict]], fields: dict[str, str], k: int = 10) -> DataFrame:
    """(qid, rank, chunk_id, doc_id, text, score) of an external search, called on the executors for each question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for qid, question in zip(pdf["qid"], pdf["question"], strict=True):
                for rank, hit in enumerate(call(question, k)[:k], 1):
                    rows.append((qid, rank, *(None if (v := dig(hit, fields[c])) is None else str(v) for c in ("chunk_id", "doc_id", "text")), float(dig(hit, fields["score"]) or 0)))
            yield pd.DataFrame(rows, columns=["qid", "rank", "chunk_id", "doc_id", "text", "score"])

    return questions.select("qid", "question").mapInPandas(run, "qid string, rank int, chunk_id string, doc_id string, text string, score double")


def load_env(path: str) -> dict[str, str]:
    """Settings of a ``KEY=value`` file; comments, blank lines and quotes around values are dropped. The process environment wins."""
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return out | {k: os.environ[k] for k in out if k in os.environ}


def masked(settings: dict[str, str]) -> dict[str, str]:
    """Settings for display: what looks like a secret shows its last two characters only."""
    secret = ("key", "password", "secret", "token")
    return {k: ("****" + v[-2:] if v and any(s in k.lower() for s in secret) else v) for k, v in settings.items()}
