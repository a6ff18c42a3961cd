import pytest

from millrace.operators import unpack as U

SINGLES = ["N00000001", "B00000002", '"XR,00000003"', "'RP/0000-0004'", '"MT;00000005"', "I00000006", "TMP-00000007"] * 5
CASES = [
    ("N00000001;B00000002", ["N00000001", "B00000002"]), ("N00000001, B00000002；E00000003", ["N00000001", "B00000002", "E00000003"]), ('["N00000001", "XR,00000003"]', ["N00000001", "XR,00000003"]), ("{N00000001,B00000002}", ["N00000001", "B00000002"]),
    ("'XR,00000003'|N00000001", ["XR,00000003", "N00000001"]), ("N00000001 / 'RP/0000-0004'", ["N00000001", "RP/0000-0004"]), ("1) N00000001\n2) B00000002", ["N00000001", "B00000002"]), ("N00000001 and B00000002 및 E00000003", ["N00000001", "B00000002", "E00000003"]),
    ("“N00000001” & “MT;00000005”", ["N00000001", "MT;00000005"]), ('"RP/0000-0004"<br>"MT;00000005"<br>N00000001', ["RP/0000-0004", "MT;00000005", "N00000001"]), (";N00000001;;N00000001; ", ["N00000001", "N00000001"]), ("N00000001 B00000002\tE00000003", ["N00000001", "B00000002", "E00000003"]),
    ("XR,00000003", ["XR,00000003"]), ("RP/0000-0004", ["RP/0000-0004"]), ("N00000001\\nB00000002", ["N00000001", "B00000002"]), ("없음", []), ("[]", []), ("-", []), ("N/A", []), ("  ", []), ("", []), (None, []), ("(N00000001 · B00000002)", ["N00000001", "B00000002"]),
]


def test_dialects(spark):
    rows = [(i, v, "x") for i, v in enumerate(SINGLES + [c for c, _ in CASES])]
    got: dict = {}
    for r in U.unpack(spark.createDataFrame(rows, "id int, packed string, field string"), "id", "packed").orderBy("item_pos").collect():
        got.setdefault(r.id, []).append(r.item)
        assert r.item_pos == len(got[r.id])
    for i, (field, want) in enumerate(CASES, len(SINGLES)):
        assert got.get(i, []) == want, field


def test_empty_and_equal_fields(spark, rows):
    schema = "id int, packed string"
    assert rows(U.unpack(spark.createDataFrame([], schema), "id", "packed")) == []
    assert rows(U.unpack(spark.createDataFrame([(1, None), (2, "none")], schema), "id", "packed")) == []
    twice = U.unpack(spark.createDataFrame([(1, "A1;B2"), (1, "A1;B2"), (2, "A1"), (3, "C3")], schema), "id", "packed")
    assert rows(twice) == [(1, 1, "A1"), (1, 1, "A1"), (1, 2, "B2"), (1, 2, "B2"), (2, 1, "A1"), (3, 1, "C3")]


@pytest.mark.parametrize("item,want", [("AB12-3", "A9-9"), ("가나 12", "한 9"), ("ab,0001", "a,9")])
def test_shapes(item, want):
    assert U.shape(item) == want


def test_very_long_field(spark):
    field = ";".join(f"N{i:08d}" for i in range(5000))
    got = U.unpack(spark.createDataFrame([(1, field), (2, "N00000001")], "id int, packed string"), "id", "packed")
    assert got.where("id = 1").count() == 5000


def test_a_field_with_more_than_six_kinds_of_delimiter(spark):
    # the true dialect is three of the eight kinds present: no single one, no pair, not all but one
    field = "N00000001;B 0/0·0+1&2|x|;E00000003,I00000006"
    kinds = {d for c, _ in U.dialects(field) for d in c}
    chosen = {frozenset(c) for c, _ in U.dialects(field)}
    assert len(kinds) > 6 and len(chosen) == 2 ** len(kinds)
    got = U.unpack(spark.createDataFrame([(i, v) for i, v in enumerate([*SINGLES, *["B 0/0·0+1&2|x|"] * 9, field])], "id int, packed string"), "id", "packed")
    last = len(SINGLES) + 9
    assert [r.item for r in got.where(f"id = {last}").orderBy("item_pos").collect()] == ["N00000001", "B 0/0·0+1&2|x|", "E00000003", "I00000006"]
