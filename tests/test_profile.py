import math
from datetime import datetime as D

from millrace.operators import profile as P

RAW = "load_no bigint, published_at timestamp_ntz, collected_at timestamp_ntz, title string, flags int"
LOADS = "load_no bigint, started_at timestamp_ntz, finished_at timestamp_ntz"


def _loads(spark, n=5):
    return spark.createDataFrame([(i, D(2025, 1, i, 8), D(2025, 1, i, 18)) for i in range(1, n + 1)], LOADS)


def _raw(spark, changed=()):
    data = []
    for i in range(1, 6):
        for k in range(10):
            data.append((i, D(2025, 1, i, 7, k, 1), D(2025, 1, i, 9, k, 2), f"제목이 충분히 긴 기사 {i} {k}", 7))
    for at, row in changed:
        data[at] = row
    return spark.createDataFrame(data, RAW)


def test_usual_loads_have_no_departure(spark, rows):
    counts = P.apply_deltas(None, P.load_deltas(_raw(spark), _loads(spark)))
    assert rows(P.departures(counts, _loads(spark))) == []


def test_each_check_is_found_where_it_departs(spark, rows):
    bad = [(i, (1, None, None, "  ", None)) for i in range(3)]
    bad += [(10 + i, (2, D(1999, 1, 1), D(2025, 1, 2, 20), "짧다 ☃", None)) for i in range(3)]
    bad += [(20 + i, (3, D(2024, 11, 1), D(2025, 1, 3, 9), "제목이 충분히 긴 기사 같은 것", None)) for i in range(4)]
    counts = P.apply_deltas(None, P.load_deltas(_raw(spark, bad), _loads(spark)))
    assert set(rows(P.departures(counts, _loads(spark)))) == {
        (1, "collected_at", "missing"), (1, "published_at", "missing"), (1, "title", "missing"),
        (2, "published_at", "out_of_range"), (2, "published_at", "midnight"), (2, "published_at", "stale"), (2, "collected_at", "out_of_range"), (2, "collected_at", "on_hour"), (2, "title", "length"), (2, "title", "charset"),
        (3, "published_at", "midnight"), (3, "published_at", "stale"), (3, "published_at", "distinct"), (3, "collected_at", "distinct"), (3, "collected_at", "on_hour"), (3, "title", "distinct"),
    }


def test_signed_deltas_step_by_step_equal_one_pass_and_cancel(spark, rows, tmp_path):
    raw, loads = _raw(spark), _loads(spark)
    store = P.ValueCounts(spark, str(tmp_path))
    for i in range(1, 6):
        store.apply(P.load_deltas(raw.where(f"load_no = {i}"), loads))
    assert rows(store.read(), *P.KEYS, "n") == rows(P.apply_deltas(None, P.load_deltas(raw, loads)), *P.KEYS, "n")
    store.apply(P.load_deltas(raw.where("load_no > 1"), loads, sign=-1))
    assert rows(store.read().select("load_no").distinct()) == [(1,)]


def test_a_store_opened_again_goes_on_where_the_first_ended(spark, rows, tmp_path):
    raw, loads = _raw(spark), _loads(spark)
    P.ValueCounts(spark, str(tmp_path)).apply(P.load_deltas(raw.where("load_no = 1"), loads), batch="a")
    second = P.ValueCounts(spark, str(tmp_path))
    first_counts = rows(second.read(), *P.KEYS, "n")
    second.apply(P.load_deltas(raw.where("load_no = 2"), loads), batch="b")
    third = P.ValueCounts(spark, str(tmp_path))
    assert set(first_counts) < set(rows(third.read(), *P.KEYS, "n"))
    assert rows(third.read(), *P.KEYS, "n") == rows(P.apply_deltas(None, P.load_deltas(raw.where("load_no < 3"), loads)), *P.KEYS, "n")


def test_replayed_batches_count_once_and_merging_keeps_the_state(spark, rows, tmp_path):
    raw, loads = _raw(spark), _loads(spark)
    store, delta = P.ValueCounts(spark, str(tmp_path)), P.load_deltas(raw, loads)
    want = rows(store.apply(delta, batch="a"), *P.KEYS, "n")
    assert rows(store.apply(delta, batch="a"), *P.KEYS, "n") == want
    store.compact()
    assert rows(P.ValueCounts(spark, str(tmp_path)).apply(delta, batch="a"), *P.KEYS, "n") == want and len(store.batches()) == 1
    # a batch that was written but never entered in the ledger is no part of the state
    delta.write.parquet(f"{tmp_path}/batch-torn")
    assert rows(store.read(), *P.KEYS, "n") == want


def test_maintained_counts_follow_new_changed_and_vanished_loads(spark, tmp_path, monkeypatch):
    raw, loads = _raw(spark), _loads(spark)
    rows = lambda df, *order: sorted(df.select(*(order or df.columns)).collect(), key=str)
    want = lambda df: rows(P.apply_deltas(None, P.load_deltas(df, loads)), *P.KEYS, "n")
    path = str(tmp_path)
    assert rows(P.ValueCounts(spark, path).maintain(raw.where("load_no < 3"), loads), *P.KEYS, "n") == want(raw.where("load_no < 3"))
    assert rows(P.ValueCounts(spark, path).maintain(raw, loads), *P.KEYS, "n") == want(raw)
    n = len(P.ValueCounts(spark, path).batches())
    assert rows(P.ValueCounts(spark, path).maintain(raw, loads), *P.KEYS, "n") == want(raw) and len(P.ValueCounts(spark, path).batches()) == n
    changed = _raw(spark, [(0, (1, None, None, "다른 제목으로 바뀌었다", 7))]).where("load_no <> 5")
    monkeypatch.setattr("millrace.operators.counts.MOST_BATCHES", 2)
    store = P.ValueCounts(spark, path)
    assert rows(store.maintain(changed, loads), *P.KEYS, "n") == want(changed)
    assert rows(P.ValueCounts(spark, path).maintain(changed, loads), *P.KEYS, "n") == want(changed)
    assert rows(P.ValueCounts(spark, path + "/none").maintain(raw.limit(0), loads)) == []


def test_profile_and_entropy(spark):
    raw = spark.createDataFrame([(1, None, None, t, 0) for t in ("a", "a", "b", None, " ")], RAW)
    p = {r.col_name: r for r in P.profile(P.apply_deltas(None, P.load_deltas(raw, _loads(spark)))).collect()}
    t = p["title"]
    assert (t.n_rows, t.n_missing, t.n_distinct, t.n_values, t.min_value, t.max_value) == (5, 2, 2, 3, "a", "b")
    assert abs(t.entropy_bits - (math.log2(3) - 2 / 3)) < 1e-6
    assert p["published_at"].n_values == 0 and p["published_at"].entropy_bits == 0


def test_empty_tables(spark, rows):
    raw, loads = spark.createDataFrame([], RAW), spark.createDataFrame([], LOADS)
    counts = P.apply_deltas(None, P.load_deltas(raw, loads))
    assert rows(P.departures(counts, loads)) == [] and rows(P.profile(counts)) == [] and rows(P.drift(counts)) == []
    assert rows(P.departures(counts, _loads(spark))) == []  # loads without rows all have share 0


def test_drift_is_total_variation_to_the_load_before(spark):
    data = [(1, None, None, t, 0) for t in ("a1", "a2", "b")] + [(2, None, None, t, 0) for t in ("a9", "c", "c")]
    got = {(r.load_no, r.col_name): r.distance for r in P.drift(P.apply_deltas(None, P.load_deltas(spark.createDataFrame(data, RAW), _loads(spark)))).collect()}
    assert got[1, "title"] is None and abs(got[2, "title"] - 2 / 3) < 1e-6


def test_drift_sees_moves_behind_a_common_start_and_moves_of_dates(spark):
    start = "같은 말로 시작하는 긴 제목 " * 4
    data = [(1, D(2025, 1, k, 7), D(2025, 1, 9), f"{start} 앞", 0) for k in (1, 2)] + [(2, D(2025, 1, k, 8), D(2025, 2, 9), f"{start} {t}", 0) for k, t in ((2, "앞"), (3, "뒤"))]
    got = {(r.load_no, r.col_name): r.distance for r in P.drift(P.apply_deltas(None, P.load_deltas(spark.createDataFrame(data, RAW), _loads(spark)))).collect()}
    assert (got[2, "title"], got[2, "published_at"], got[2, "collected_at"]) == (0.5, 0.5, 1.0)
