import base64
import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, canonical, packing

needs_vocab = pytest.mark.skipif(not os.path.exists(bpe.vocab_path()), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(bpe.vocab_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocab
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="가나다 abc\n0.,ééＡ🙂", max_size=200))
def test_encoding_equals_the_library(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe.encoder(bpe.vocab_path()).encode(text)
    assert ids == reference.encode_ordinary(text) and bpe.encoder(bpe.vocab_path()).decode(ids) == text


@needs_vocab
def test_encode_table(spark):
    texts = [None, "", " ", "<|endoftext|> is text", "가" * 30_000, "a" * 5000, "같은", "같은"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as ids")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert len(got) == 8 and got[0] == [] and got[1] == [] and 50256 not in got[3]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.where("false")).count() == 0


def test_stale_entries_are_skipped(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"cd"]
    (tmp_path / "v.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    e = bpe.BytePairEncoder(str(tmp_path / "v.tiktoken"))
    assert e.encode("abcd") == [258, ord("d")] and e.encode("aabbc") == [ord("a"), 257, 256]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bound_and_packing(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    where, fill = packing.best_fit_decreasing(sizes, 50)
    assert (np.bincount(where, sizes, len(fill)) == fill).all() if len(sizes) else len(fill) == 0
    assert (fill <= 50).all() and packing.lower_bound(sizes, 50) <= len(fill)


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.array([51] * 10), 100) == 10 and packing.lower_bound(np.array([34] * 9), 100) == 5


@pytest.mark.parametrize("per_partition", [20, 10_000])
def test_pack(spark, per_partition):
    random.seed(5)
    data = [(i, random.choice([0, None, 5, 30, 60, 100, 250, 333, 41, 59])) for i in range(400)]
    sizes = spark.createDataFrame(data, "doc_id int, n_tokens int").selectExpr("doc_id", "n_tokens", "1 as piece", "2 as container")
    out = packing.pack(sizes, capacity=100, partition_items=per_partition).collect()
    fill, total, pieces = {}, {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
    assert max(fill.values()) <= 100 and total == {i: n for i, n in data if n}
    assert all(len(p) == 1 for i, p in pieces.items() if dict(data)[i] <= 100)
    used = len(fill)
    cert = packing.certificate(sizes, packing.pack(sizes, capacity=100, partition_items=per_partition), capacity=100).first()
    assert cert.lower_bound <= cert.n_containers == used <= cert.lower_bound * (1.3 if per_partition == 20 else 1.03) + 1


def test_exchange_saves_containers(spark):
    sizes = spark.range(240).selectExpr("id as doc_id", "case when id % 2 = 0 then 60 else 40 end as n_tokens")
    alone = packing.pack(sizes, capacity=100, partition_items=8, rounds=0).select("container").distinct().count()
    exchanged = packing.pack(sizes, capacity=100, partition_items=8).select("container").distinct().count()
    assert 120 <= exchanged < alone


def test_exchange_goes_on_until_nothing_is_saved(spark):
    random.seed(9)
    sizes = spark.createDataFrame([(i, random.randrange(1, 60)) for i in range(300)], "doc_id int, n_tokens int")
    packed = packing.pack(sizes, capacity=100, partition_items=15)
    few = packing.pack(sizes, capacity=100, partition_items=15, rounds=1).select("container").distinct().count()
    cert = packing.certificate(sizes, packed, capacity=100).first()
    assert packed.count() == 300 and cert.lower_bound <= cert.n_containers <= few


def test_pack_nothing(spark):
    none = spark.createDataFrame([], "doc_id int, n_tokens int")
    assert packing.pack(none).count() == 0 and packing.certificate(none, packing.pack(none)).first().n_containers == 0


def _plain(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", "".join(map(canonical._folded, text)))


MARKS = "ạ̧̀́각가Aোﬁа​\r\n　Ａêạがｶﾞ\U0001d15e ½①²㎚"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=MARKS, max_size=12) | st.text(max_size=12), max_size=6))
def test_fold_equals_plain_strings(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert canonical.fold_array(pa.array(texts, pa.string())).to_pylist() == [_plain(t) for t in texts]


def test_what_looks_alike_and_what_does_not():
    fold = lambda t: canonical.fold_array(pa.array([t])).to_pylist()[0]
    for a, b in (("ＡＢ １２％", "AB 12%"), ("é", "é"), ("асе", "ace"), ("ﬁn", "fin"), ("a​b﻿", "ab"), ("a b c\td", "a b c d"), ("한", "한"), ("ÅΩK", "ÅΩK"), ("a\r\nb", "a\nb"), ("µ", "μ"), ("x‑y", "x-y")):
        assert fold(a) == fold(b), (a, b)
    for a, b in (("A", "a"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("㎚", "nm"), ("a.b", "a,b"), ("a\nb", "a b"), ("a  b", "a b"), ("ⓒ", "c")):
        assert fold(a) != fold(b), (a, b)
    assert fold("") == "" and canonical.fold_array(pa.array([], pa.string())).to_pylist() == []


def test_pairs(spark, rows):
    texts = ["abc", "аbc", "abc", "ａｂｃ", "abd", None, "", "​", " ", "가", "가", "Abc", "hot", "hot", "hot", "hоt"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "text", "'x' as id", "'y' as folded")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and _plain(a).strip() and _plain(a) == _plain(b)}
    got = rows(canonical.look_alike_pairs(df))
    assert set(got) == want and len(got) == len(want)
    assert rows(canonical.look_alike_pairs(df.where("false"))) == []
    classes = {r.id: (r.class_id, r.variant_id, r.n_links) for r in canonical.variant_classes(df).collect()}
    links = {i: sum(i in p for p in want) for p in want for i in p}
    assert {i: n for i, (_, _, n) in classes.items()} == links and classes[12] == (12, 12, 1) and classes[15] == (12, 15, 3) and classes[3][0] == 0
    form = dict(rows(canonical.canonical(df)))
    assert form[1] == "abc" and form[5] is None and form[7] == ""


def test_confusables_of_the_public_format(tmp_path):
    path = tmp_path / "confusables.txt"
    path.write_text("\ufeff# comment\n0430 ;\t0061 ;\tMA\t# ( а → a )\n13AA ;\t0041 ;\tMA\n0031 ; 006C ; MA\n33A6 ; 006B 006D ; MA\n\n", encoding="utf-8")
    assert canonical.confusables(str(path)) == {"а": "a", "\u13aa": "A"}
