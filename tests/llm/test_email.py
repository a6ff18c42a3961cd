import pytest

from millrace.llm import email as M

#: A message, and the lines (from 1) that its sender did not newly write.
CASES = [
    ("안녕하세요, 김하나 님.\n\n재고가 늘었다.\n감사합니다만 물량은 어렵습니다.\n\n감사합니다.\n이두리 드림\n수급팀 | 07-000-1111 | a@b.example", {6, 7, 8}),
    ("재고 > 5주인 구간입니다.\n> 앞선 글\n답입니다.\n\n > 또 앞선 글\n> > 더 앞선 글", {2, 5, 6}),
    ("새 글\n\n2025-04-06 12:13에 김하나 님이 쓰신 글:\n| 앞선 글이다.\n| 감사합니다.", {3, 4, 5}),
    ("새 글\n| 품목 | 3 | 유럽 |\n\n-----원본 메시지-----\n보낸 사람: 김하나 <a@b.example>\n보낸 날짜: 2025-01-01\n받는 사람: 이두리\n제목: 건\n\n앞선 글\n감사합니다.\n김하나 드림", {4, 5, 6, 7, 8, 10, 11, 12}),
    ("보낸 사람 칸에 담당자가 빠졌습니다.\n제목: 칸은 형식을 맞춰 주십시오.\n----- 유럽 정리 -----\n원본 메시지에 있던 값은 틀립니다.", set()),
    ("On 4/1/2026, at 9:36, Lior Brindel\n<a@b.example> wrote:\n\n> Old text.\nNew answer below.\n\n-- \nGreer Corvane\nMeradic | c@d.example", {1, 2, 4, 7, 8, 9}),
    ("On Monday Meradic wrote: ship 74 pallets.\nThe original message from Skyrane gave 2 dollars.\nThanks, Elowen\n\nSent from my handset", {3, 5}),
    ("새 글\n━━━━━━━━━━\n이두리 매니저\n회사 수급팀\nM. 06-000-5144  E. a@b.example\n━━━━━━━━━━\n\n본 메일은 기밀 정보를 담고 있으며 지정된 수신인 외의 사용을 금합니다.", {2, 3, 4, 5, 6, 8}),
    ("새 글\n본 메일은 남미 건만 다룹니다, 다른 건은 따로 보내겠습니다.\n\n- 이두리 -\n\n휴대전화에서 보냄", {4, 6}),
    ("New text.\n\nCael Vantrell (a@b.example) said on 3.7.2026:\nOld text without marks.\nRegards,\nCael Vantrell", {3, 4, 5, 6}),
    ("", set()), ("\n \n", set()), ("한 줄", set()),
]


#: Closings as a corpus would give them.
LEARNT = M.Dictionary(["본 메일은 기밀 정보를 담고 있으며 지정된 수신인 외의 사용을 금합니다.", "Sent from my handset", "투자관리팀 | 9 | @memco.example"])
NONE = M.Dictionary()


def _numbers(body, closings=LEARNT, senders=NONE, ancestors=None, sender=""):
    return {n for n, _ in M.not_new(M.framed(body, sender), closings, senders, ancestors or {}, sender)}


@pytest.mark.parametrize("body,want", CASES)
def test_lines(body, want):
    assert _numbers(body) == want
    assert _numbers(body.replace("\n", "\r\n")) == want


def test_without_dictionaries_notices_and_unseen_closings_stay():
    body = CASES[7][0]
    assert _numbers(body) - _numbers(body, NONE) == {8}
    contact = "새로 쓴 글이다.\n\n다른 팀 / 투자관리팀 | 02-111-2222 | x@memco.example"
    assert _numbers(contact) == {3} and _numbers(contact, NONE) == set()  # pieces of a line that the dictionary holds


def test_closings_of_the_sender():
    body = "새로 쓴 글이다.\n\n늘 하던 인사\n내 자리 31층"
    assert _numbers(body) == set() and _numbers(body, senders=M.Dictionary(["늘 하던 인사", "내 자리 9층"])) == {3, 4}


def test_a_long_signature_and_a_long_ruled_block():
    names = [f"{x}리나" for x in "가나다라마바사아자차"]
    assert _numbers("\n".join(["새 글이다.", "감사합니다.", *names]), NONE) == set(range(2, 13))
    assert _numbers("\n".join(["새 글이다.", "=======", *names, "======="]), NONE) == set(range(2, 14))


def test_gain_needs_the_dictionary():
    notice = "이 안내는 모든 메일에 붙는 고정 문구이므로 답장하지 마십시오."
    assert M.gain(notice, notice.encode()) > 0.6 > M.gain(notice, b"unrelated words of another kind")


RAW = "raw_no bigint, doc_id string, doc_type string, author string, published_at timestamp_ntz, body string, line string"
TYPES = "code string, aliases string"


def test_recurring_notices_and_ancestors(spark, rows):
    notice = "사내 게시판의 새 공지를 매주 확인하여 주시기를 거듭 부탁드립니다"
    old = ["재고 실사에서 나온 첫째 문단은 이만큼 길고 고유한 내용을 담는다.", "둘째 문단 또한 이만큼 길고 다른 메일에 없는 내용을 담는다."]
    bodies = ["\n".join(["안녕하세요, 님.", *old, notice])] + [f"새로 쓴 글 {i}번은 서로 다릅니다.\n\n{notice}" for i in range(4)] + ["\n".join(["새로 쓴 답", *old, "끝에 덧붙인 새 글"])]
    data = [(i, f"E{i}", "mail", None, None, b, "x") for i, b in enumerate(bodies, 1)] + [(90, "E90", "MAIL", None, None, None, "x"), (91, "N", "NEWS", None, None, notice, "x")]
    raw = spark.createDataFrame(data, RAW)
    types = spark.createDataFrame([("EMAIL", "메일;MAIL"), ("NEWS", None)], TYPES)
    assert rows(M.not_new_lines(raw, types)) == [(1, 4), (2, 3), (3, 3), (4, 3), (5, 3), (6, 2), (6, 3)]
    new = dict(rows(M.newly_written(raw, types)))
    assert new[6] == "새로 쓴 답\n끝에 덧붙인 새 글" and new[2] == "새로 쓴 글 0번은 서로 다릅니다." and 90 not in new


def test_exact_overlaps_beyond_one_window():
    old = [f"{chr(0xAC00 + 7 * i)}{chr(0xB098 + 5 * i)} 지점의 {i * 7919}번 실사에서 나온 내용은 {chr(0xC0AC + 3 * i)}{i * 104729} 건이다." for i in range(900)]
    body = "\n".join(["새로 쓴 답", *old, "끝에 덧붙인 새 글"])
    assert _numbers(body, NONE, ancestors=dict.fromkeys(old, False)) == set(range(2, 902))
    notices = [x + " 알림" for x in old]
    many = M.Dictionary(map(M.shape, notices))
    assert _numbers("\n".join(["새 글", *notices]), many) == set(range(2, 902)) and len(many.blocks) > 1
    # a closing in other words is found by the block that has it, whichever it is
    spread = M.Dictionary([f"{a}{b} 줄" for a in map(chr, range(0xAC00, 0xAC80)) for b in map(chr, range(0xB000, 0xB040))][:4000] + ["고객품질팀 | 9 | @memco.example"] + [f"{a}{b} 단" for a in map(chr, range(0xAD00, 0xAD80)) for b in map(chr, range(0xB000, 0xB040))])
    assert spread.shrinks("새 고객품질팀 | 9 | @memco.example") and len(spread.blocks) > 3 and b"".join(spread.blocks[::2]).count(b"@memco") >= 1


def test_one_line_of_the_same_subject_is_enough(spark, rows):
    a, b = "재고 실사에서 나온 첫째 문단은 이만큼 길고 고유한 내용을 담는다.", "둘째 문단 또한 이만큼 길고 다른 메일에 없는 내용을 담는다."
    data = [(1, "E1", "MAIL", None, None, f"{a}\n{b}", "x", "재고 건"), (2, "E2", "MAIL", None, None, f"새로 쓴 답\n{a}\n끝", "x", "회신: RE: 재고 건"), (3, "E3", "MAIL", None, None, f"새로 쓴 답\n{b}\n끝", "x", "다른 건")]
    raw, types = spark.createDataFrame(data, RAW + ", title string"), spark.createDataFrame([("EMAIL", "MAIL")], TYPES)
    assert rows(M.line_paths(raw, types)) == [(2, 2, "ancestor")]


def test_a_sender_with_half_of_the_messages(spark, rows):
    data = [(i, f"E{i}", "MAIL", "갑돌이" if i % 2 else f"s{i}", None, f"이번에 새로 쓴 글 {'가나다라마바사아자차'[i % 10] * (i + 1)}이다.\n\n늘 하던 인사 갑돌이" if i % 2 else f"또 다른 글 {'거너더러머버서어저처'[i % 10] * (i + 1)}이다.", "x") for i in range(40)]
    raw, types = spark.createDataFrame(data, RAW), spark.createDataFrame([("EMAIL", "MAIL")], TYPES)
    assert rows(M.not_new_lines(raw, types)) == [(i, 3) for i in range(1, 40, 2)]


def test_lines_of_a_thread_that_many_messages_quote(spark, rows):
    old = ["재고 실사에서 나온 첫째 문단은 이만큼 길고 고유한 내용을 담는다.", "둘째 문단 또한 이만큼 길고 다른 메일에 없는 내용을 담는다."]
    bodies = ["\n".join(old)] + ["\n".join([f"새로 쓴 답 {i}", *old, f"끝에 덧붙인 새 글 {i}"]) for i in range(5)]
    raw = spark.createDataFrame([(i, f"E{i}", "MAIL", None, None, b, "x") for i, b in enumerate(bodies, 1)], RAW)
    types = spark.createDataFrame([("EMAIL", "MAIL")], TYPES)
    assert [r for r in rows(M.not_new_lines(raw, types)) if r[0] > 1] == [(i, n) for i in range(2, 7) for n in (2, 3)]


def test_empty_table(spark, rows):
    raw, types = spark.createDataFrame([], RAW), spark.createDataFrame([("EMAIL", "MAIL")], TYPES)
    assert rows(M.not_new_lines(raw, types)) == [] and rows(M.newly_written(raw, types)) == []
