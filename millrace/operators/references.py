"""References to records that do not exist, from signed counts on both sides.

Every change is an event ``(key, kind, at, n)`` with a signed count ``n``: a collection of a record (+1, or -1 when the
collection is withdrawn), a removal, or a reference. Adding counts and dropping zeros maintains the table; the existence
of a key, now and at any past time, and what refers to it follow from its maintained counts alone. Orphans are the
keys, by time of reference, with positive references and zero existence; rows of the referring table are read only to
name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import doc_key
from millrace.operators.counts import CountStore, added_up
from millrace.operators.skew import left_join_by_state

COLLECTED, REMOVED, REFERENCED = "collected", "removed", "referenced"
COUNTS = "key string, kind string, at timestamp_ntz, n bigint"


def collection_deltas(raw: DataFrame, sign: int = 1) -> DataFrame:
    """Existence deltas of the records of ``raw``, pre-aggregated; rows without a key give none."""
    return _events(raw, "collected_at", COLLECTED, sign)


def removal_deltas(removals: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of the removals; a removal without a key gives none."""
    return _events(removals, "removed_at", REMOVED, sign)


def _events(df: DataFrame, at: str, kind: str, sign: int) -> DataFrame:
    return (
        df.select(doc_key("doc_id").alias("key"), F.lit(kind).alias("kind"), F.col(at).alias("at"))
        .where("key is not null and key <> ''")
        .groupBy("key", "kind", "at")
        .agg((F.count(F.lit(1)) * sign).alias("n"))
    )


def reference_deltas(refs: DataFrame, sign: int = 1, ref_id: str = "chunk_id", ref_at: str = "indexed_at") -> DataFrame:
    """Deltas of the references of ``refs``; rows of one id, key and time are one reference, null and blank keys refer to nothing."""
    keyed = refs.select(F.col(ref_id).alias("id"), doc_key("doc_id").alias("key"), F.col(ref_at).alias("at")).where("key is not null and key <> ''").distinct()
    return keyed.groupBy("key", F.lit(REFERENCED).alias("kind"), "at").agg((F.count(F.lit(1)) * sign).alias("n"))


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The event counts after the deltas; what falls to zero leaves the table."""
    return added_up(["key", "kind", "at"], *([state] if state is not None else []), *deltas)


class ReferenceCounts(CountStore):
    """The event counts of a record table, its removals and the references to it, kept on disk."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, COUNTS)

    def maintain(self, raw: DataFrame, removals: DataFrame, refs: DataFrame) -> DataFrame:
        """The state brought up to date: of each table that changed, the signed difference to what stands in the state is applied.

        A table is known by the print of the columns that count; one that stands in the state as it is costs one scan of these.
        """
        sources = {
            COLLECTED: (raw, ["doc_id", "collected_at"], collection_deltas),
            REMOVED: (removals, ["doc_id", "removed_at"], removal_deltas),
            REFERENCED: (refs, ["chunk_id", "doc_id", "indexed_at"], reference_deltas),
        }
        prints = [_print(df.select(*columns), kind) for kind, (df, columns, _) in sources.items()]
        ledger = self.ledger()
        changes = self.stale(prints[0].unionByName(prints[1]).unionByName(prints[2]), ledger)
        if changes:
            kinds = [kind for kind, _, _ in changes]
            deltas = [sources[k][2](sources[k][0]) for k in kinds]
            if any(former is not None for _, _, former in changes):
                deltas.append(self.state(ledger).where(F.col("kind").isin(kinds)).withColumn("n", -F.col("n")))
            return self.apply(*deltas, prints=[(kind, now) for kind, now, _ in changes], ledger=ledger)
        return self.state(ledger)


def _print(df: DataFrame, part: str) -> DataFrame:
    """(part, print): number of rows and sums of their hashes."""
    h = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(20,0)")).cast("string"), F.lit("-"))
    return df.agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), h(1), h(2)).alias("print")).select(F.lit(part).alias("part"), "print")


def existence(state: DataFrame) -> DataFrame:
    """One row per key of the collections and removals: collections ever, collections that outlive the latest removal, and the first collection.

    A collection without a time counts as earlier than any time: it never outlives a removal, and the key then has
    existed before every reference (``always``).
    """
    is_in, is_out = F.col("kind") == COLLECTED, F.col("kind") == REMOVED
    return state.groupBy("key").agg(
        F.sum(F.when(is_in, F.col("n")).otherwise(0)).alias("n_collected"),
        F.max(F.when(is_in, F.col("at"))).alias("last_in"),
        F.min(F.when(is_in, F.col("at"))).alias("first_in"),
        F.max(is_in & F.col("at").isNull()).alias("always"),
        F.max(is_out).alias("removed"),
        F.max(F.when(is_out, F.col("at"))).alias("last_out"),
    )


def orphan_counts(state: DataFrame) -> DataFrame:
    """(key, at, n, reason) of the references counted in ``state`` whose key does not exist: missing, removed or later.

    A reference without a time is never ``later``. A removal without a time comes before every timed collection, and no
    untimed one outlives it. A key that very many references name meets its state by broadcast, see ``left_join_by_state``.
    """
    refs = state.where((F.col("kind") == REFERENCED) & (F.col("n") > 0)).select("key", "at", "n")
    met = left_join_by_state(refs, existence(state.where(F.col("kind") != REFERENCED)), "key")
    outlives = F.coalesce(F.col("last_in") > F.col("last_out"), F.col("last_in").isNotNull() & F.col("last_out").isNull())
    reason = (
        F.when(F.coalesce(F.col("n_collected"), F.lit(0)) <= 0, "missing")
        .when(F.col("removed") & ~outlives, "removed")
        .when(~F.col("always") & (F.col("first_in") > F.col("at")), "later")
    )
    return met.withColumn("reason", reason).where("reason is not null").select("key", "at", "n", "reason")


def orphans(refs: DataFrame, state: DataFrame, ref_id: str = "chunk_id", ref_at: str = "indexed_at") -> DataFrame:
    """(ref_id, ref_at, key, reason) of the rows of ``refs`` that are orphans by the counts of ``state``.

    ``state`` holds the counts of these references too, see ``reference_deltas``. Null and blank keys give no row. Only
    the id, key and time of ``refs`` are read, so extra or clashing columns do no harm. Rows meet the orphans by key and
    time, which spreads the references of one hot key.
    """
    keyed = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_at).alias("ref_at"), doc_key("doc_id").alias("key")).where("key is not null and key <> ''")
    found = orphan_counts(state).select(F.col("key").alias("k"), "at", "reason")
    return keyed.join(found, (keyed.key == found.k) & keyed.ref_at.eqNullSafe(found.at)).select("ref_id", "ref_at", "key", "reason")
