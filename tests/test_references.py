import random
from datetime import datetime as D
from datetime import timedelta

from millrace.operators import references as R
from millrace.operators.skew import hot_keys, left_join_by_state

RAW, REM, CH = "doc_id string, collected_at timestamp_ntz, key string", "doc_id string, removed_at timestamp_ntz, reason string", "chunk_id string, doc_id string, indexed_at timestamp_ntz, key string, reason string"


def _run(spark, raw, rem, chunks):
    refs = spark.createDataFrame(chunks, CH)
    state = R.apply_deltas(None, R.collection_deltas(spark.createDataFrame(raw, RAW)), R.removal_deltas(spark.createDataFrame(rem, REM)), R.reference_deltas(refs))
    return {(r.ref_id, r.reason) for r in R.orphans(refs, state).collect()}


def test_reasons_and_edges(spark):
    t = D(2025, 1, 1)
    day = lambda n: t + timedelta(n)
    raw = [("A", day(1), "x"), ("b ", day(1), "x"), ("C", day(9), "x"), ("D", None, "x"), ("E", day(1), "x"), ("E", day(6), "x"), ("F", None, "x"), (None, day(1), "x")]
    rem = [("B", day(3), None), ("e", day(5), None), ("F", day(3), "x"), (None, day(1), None), ("G", day(1), None)]
    chunks = [("a", " a", day(2), "k", "r"), ("b", "B", day(9), "k", "r"), ("c", "c", day(2), "k", "r"), ("c2", "c", day(9), "k", "r"), ("d", "D", day(0), "k", "r"), ("e", "E", day(9), "k", "r"), ("f", "f", day(9), "k", "r"), ("g", "G", day(9), "k", "r"), ("n", None, day(1), "k", "r"), ("s", "  ", day(1), "k", "r"), ("u", "C", None, "k", "r")]
    assert _run(spark, raw, rem, chunks) == {("b", "removed"), ("c", "later"), ("f", "removed"), ("g", "missing")}


def test_withdrawn_collections_leave_the_state(spark):
    raw = spark.createDataFrame([("A", D(2025, 1, 1), "x"), ("A", D(2025, 1, 2), "x")], RAW)
    state = R.apply_deltas(R.apply_deltas(None, R.collection_deltas(raw)), R.collection_deltas(raw, sign=-1))
    assert state.isEmpty()
    chunks = spark.createDataFrame([("a", "A", D(2025, 2, 1), "", "")], CH)
    state = R.apply_deltas(state, R.reference_deltas(chunks))
    assert [r.reason for r in R.orphans(chunks, state).collect()] == ["missing"]
    # withdrawn references too: nothing refers to the key any more
    state = R.apply_deltas(state, R.reference_deltas(chunks, sign=-1))
    assert state.isEmpty() and R.orphan_counts(state).isEmpty()


def test_maintained_counts_follow_the_tables(spark, tmp_path):
    t = lambda n: D(2025, 1, n)
    raw, rem = spark.createDataFrame([("A", t(1), "x"), ("B", t(1), "x")], RAW), spark.createDataFrame([("B", t(2), "x")], REM)
    chunks = spark.createDataFrame([("a", "A", t(3), "", ""), ("a", "A", t(3), "", ""), ("b", "b", t(3), "", ""), ("c", "C", None, "", "")], CH)
    found = lambda r, m, c: {(x.key, x.n, x.reason) for x in R.orphan_counts(R.ReferenceCounts(spark, str(tmp_path)).maintain(r, m, c)).collect()}
    assert found(raw, rem, chunks) == {("B", 1, "removed"), ("C", 1, "missing")}
    n = len(R.ReferenceCounts(spark, str(tmp_path)).batches())
    assert found(raw, rem, chunks) == {("B", 1, "removed"), ("C", 1, "missing")} and len(R.ReferenceCounts(spark, str(tmp_path)).batches()) == n
    late = raw.unionByName(spark.createDataFrame([("C", t(5), "x")], RAW))
    assert found(late, rem.limit(0), chunks) == set()
    assert found(raw.where("doc_id = 'B'"), rem.limit(0), chunks.where("chunk_id = 'a'")) == {("A", 1, "missing")}


def test_one_key_with_half_of_the_references(spark):
    chunks = [(str(i), "hot" if i % 2 else f"k{i}", D(2025, 1, 1 + i % 28), "", "") for i in range(2000)]
    assert len(_run(spark, [(f"k{i}", D(2024, 1, 1), "x") for i in range(0, 2000, 2)], [], chunks)) == 1000


def test_empty_tables(spark):
    assert _run(spark, [], [], []) == set()


def test_hot_keys_give_the_same_join(spark, rows):
    random.seed(3)
    big = spark.createDataFrame([(i, "hot" if i % 3 else str(random.randrange(50)) if i % 7 else None) for i in range(3000)], "id int, key string")
    state = spark.createDataFrame([("hot", 1), ("7", 2), ("9", 3)], "key string, v int")
    assert rows(hot_keys(big, "key", 10)) == [("hot",)]
    for one_in in (2, 10, 1000):
        got = {(r.id, r.key, r.v) for r in left_join_by_state(big, state, "key", one_in).collect()}
        assert got == {(r.id, r.key, r.v) for r in big.join(state, "key", "left").collect()} and len(got) == 3000
