"""Exact and near duplicates of documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.functions.text import strip
from millrace.session import cut

PERMUTATIONS, BANDS, SIMILARITY, SHINGLE_WORDS = 64, 16, 0.8, 5
_PRIME = 2**31 - 1
#: Shingles whose hash a worker remembers.
KNOWN_SHINGLES = 1_000_000
#: Texts of one bucket that one task compares with the bucket; larger buckets are split.
BUCKET_PART = 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """(id, hash, n): every row whose stripped text another row has too, with the size of its group; null texts are left out."""
    hashed = docs.where(F.col(text_col).isNotNull()).select(id_col, F.sha2(strip(F.col(text_col)), 256).alias("hash"))
    # groups are counted before the join, so a group's rows never meet in one window
    sizes = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(sizes, "hash").select(id_col, "hash", "n")


def copy_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, n_rows, n_copies): rows beyond the first of each value; nulls count as one value."""
    n = F.count(F.lit(1))
    pieces = [F.struct(F.lit(c).alias("column_name"), n.alias("n_rows"), (n - F.count_distinct(c) - F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias("n_copies")) for c in columns]
    return df.select(*columns).agg(F.array(*pieces).alias("a")).select(F.inline("a"))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; a grouped minimum of one struct, so no group is sorted."""
    rest = [c for c in df.columns if c not in key]
    ordered = [*order, *(c for c in rest if c not in order)]
    found = df.groupBy(*key).agg(F.min(F.struct(*ordered)).alias("__row"))
    return found.select(*key, *(F.col("__row")[c].alias(c) for c in rest if c in ordered))


def question_key(question: str = "question"):
    """Questions are the same when their first 40 letters, digits and underscores are."""
    return F.substring(F.regexp_replace(F.coalesce(F.col(question), F.lit("")), r"[^\p{L}\p{N}_]", ""), 1, 40)


def seeded_coefficients(n: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    return rng.randint(1, _PRIME, n, dtype=np.int64), rng.randint(0, _PRIME, n, dtype=np.int64)


def shingle_hashes(text: str, size: int = 5, known: dict[str, int] | None = None) -> np.ndarray:
    """First 32 bits of the md5 of each distinct character shingle; ``known`` keeps those of former texts."""
    t = re.sub(r"\s+", " ", text or "")
    known = {} if known is None else known
    if len(known) > KNOWN_SHINGLES:
        known.clear()
    out = []
    for s in {t[i : i + size] for i in range(max(1, len(t) - size + 1))}:
        h = known.get(s)
        if h is None:
            h = known[s] = int.from_bytes(hashlib.md5(s.encode(), usedforsecurity=False).digest()[:4], "big")
        out.append(h)
    return np.array(out, np.int64)


def char_signature(text: str, a: np.ndarray, b: np.ndarray, size: int = 5, known: dict[str, int] | None = None) -> np.ndarray:
    """MinHash over the character shingles of a text: md5, first 32 bits, (a * h + b) mod (2^31 - 1), least per permutation."""
    h = shingle_hashes(text, size, known)
    out = np.full(len(a), _PRIME, np.int64)
    for i in range(0, len(h), 4096):  # bounded memory for very long texts
        np.minimum(out, ((h[i : i + 4096, None] * a + b) % _PRIME).min(0), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """(id, sig): MinHash signatures by an Arrow UDF; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    a, b = seeded_coefficients(n, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "sig": [char_signature(t, a, b, known=known) for t in pdf[text_col]]})

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, sig array<bigint>")


@dataclass(frozen=True)
class Near:
    """Near duplicates by heads: the least ids of the texts of one signature, one of each text's exact copies.

    heads (id, head): every different text under the least id of its copies. head_links (id_a, id_b, similarity): every
    pair of heads that reaches the threshold. members (id, class_id): one row per document.
    """

    heads: DataFrame
    head_links: DataFrame
    members: DataFrame

    def links(self) -> DataFrame:
        """(id_a, id_b, similarity): every pair of different texts, those of one signature at 1.0; as many rows as there are links."""
        of_a, of_b = self.heads.select(F.col("id").alias("a"), F.col("head").alias("id_a")), self.heads.select(F.col("id").alias("b"), F.col("head").alias("id_b"))
        across = self.head_links.join(of_a, "id_a").join(of_b, "id_b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity")
        several = self.heads.where("id <> head").select("head").distinct()
        alike = self.heads.join(several, "head", "left_semi")
        within = alike.select("head", F.col("id").alias("id_a")).join(alike.select("head", F.col("id").alias("id_b")), "head").where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
        return across.unionByName(within)

    def link_counts(self) -> DataFrame:
        """(id, n_links) of every different text, counted over heads without making the links."""
        sizes = self.heads.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
        both = self.head_links.select(F.col("id_a").alias("head"), F.col("id_b").alias("other")).unionByName(self.head_links.select(F.col("id_b").alias("head"), F.col("id_a").alias("other")))
        far = both.join(sizes.withColumnRenamed("head", "other"), "other").groupBy("head").agg(F.sum("size").alias("far"))
        return self.heads.join(sizes, "head").join(far, "head", "left").select("id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))


def near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", threshold: float = SIMILARITY, bands: int = BANDS, n: int = PERMUTATIONS) -> Near:
    """Near duplicates by the share of equal slots of MinHash signatures, see ``Near``.

    Exact copies are collapsed by hash, ids only; a text is fetched once for its signature. Of the texts of one signature
    a head is compared in the bands. A bucket of more than ``BUCKET_PART`` heads is split, so its pairs are spread over
    tasks; none is left out. Ids are cast to strings; null ids are left out, a null text counts as empty.
    """
    ids = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    hashed = ids.select("id", F.sha2(strip(F.coalesce("text", F.lit(""))), 256).alias("h"), "text")
    copies = cut(hashed.select("id", "h"), "text-hashes")
    reps = copies.groupBy("h").agg(F.min("id").alias("id"))
    # an id that stands for several texts has a signature of each, and the least one counts
    signed = signatures(hashed.join(reps, ["id", "h"], "left_semi").select("id", "text"), "id", "text", n)
    by_sig = cut(signed.select("id", "sig", F.md5(F.array_join("sig", ",")).alias("s")).groupBy("id").agg(F.min(F.struct("s", "sig")).alias("x")).select("id", "x.*"), "sigs")
    heads = by_sig.groupBy("s").agg(F.min("id").alias("head"), F.min_by("sig", "id").alias("sig"))
    rows = n // bands
    banded = heads.select("head", "sig", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("sig", i * rows + 1, rows)).alias("bucket")))).alias("b")).select("head", "sig", "b.*")
    # buckets of one head pair with nothing
    shared = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = banded.join(shared, ["band", "bucket"]).withColumn("parts", F.ceil(F.col("size") / BUCKET_PART).cast("int"))
    left = keyed.select("band", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("id_a"), F.col("sig").alias("sig_a"))
    right = keyed.select("band", "bucket", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int").alias("part"), F.col("head").alias("id_b"), F.col("sig").alias("sig_b"))
    met = left.join(right, ["band", "bucket", "part"]).where("id_a < id_b")
    alike = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e)) / F.lit(float(n))
    head_links = cut(met.withColumn("similarity", alike).where(F.col("similarity") >= threshold).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity")), "links")
    to_head = cut(by_sig.select("id", "s").join(heads.select("s", "head"), "s").select("id", "head"), "heads")
    components = connected(head_links.select("id_a", "id_b"))
    classed = to_head.join(components.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("class_id", "head").alias("class_id"))
    members = copies.join(reps.select(F.col("id").alias("rep"), "h"), "h").join(classed.withColumnRenamed("id", "rep"), "rep").select("id", "class_id")
    return Near(to_head, head_links, members)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", threshold: float = SIMILARITY, bands: int = BANDS, n: int = PERMUTATIONS) -> tuple[DataFrame, DataFrame]:
    """The links and members of ``near``."""
    found = near(docs, id_col, text_col, threshold, bands, n)
    return found.links(), found.members


def connected(links: DataFrame) -> DataFrame:
    """(id, class_id): the least id of each connected component, by alternating large-star and small-star rounds.

    Each round is two joins over the links that are left; lineage is cut after each. Rounds go on until the links stand
    still, which takes about as many as the logarithm of the longest chain. Isolated ids have no row.
    """
    edges = cut(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        after = cut(small.where("u <> v").distinct(), "edges")
        settled = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if settled:
            break
    found = edges.groupBy("u").agg(F.min("v").alias("class_id"))
    roots = found.select("class_id").distinct().select(F.col("class_id").alias("id"), "class_id")
    return found.withColumnRenamed("u", "id").unionByName(roots).distinct()


def earliest_of_class(members: DataFrame, docs: DataFrame, id_col: str = "doc_id", at: str = "published_at") -> DataFrame:
    """(class_id, kept, n): the document of each class that came first, the least id of those of one time; undated ones come last."""
    dated = docs.select(F.col(id_col).cast("string").alias("id"), F.col(at).alias("at")).groupBy("id").agg(F.min("at").alias("at"))
    met = members.join(dated, "id", "left")
    return met.groupBy("class_id").agg(F.min_by("id", F.struct(F.col("at").isNull(), F.col("at"), F.col("id"))).alias("kept"), F.count(F.lit(1)).alias("n"))


def title_jaccard(docs: DataFrame, keys: DataFrame, n: int = 4) -> DataFrame:
    """(id_a, id_b, jaccard) of given pairs by the character n-grams of their texts; ``keys``: (id_a, id_b)."""
    grams = docs.select("id", K.grams(F.coalesce("text", F.lit("")), n).alias("g"))
    a = keys.join(grams.select(F.col("id").alias("id_a"), F.col("g").alias("ga")), "id_a")
    b = a.join(grams.select(F.col("id").alias("id_b"), F.col("g").alias("gb")), "id_b")
    return b.select("id_a", "id_b", F.round(K.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))
