"""Emails reduced to what their sender newly wrote.

Dictionaries come from the corpus, none is given. Closings: lines that recur over the messages' own parts, below
everything else (formulas, names, contacts, device notes, notices). Closings of the sender: lines that recur over one
sender's messages. Ancestors: lines that an earlier message of another key holds, of the same subject or not.

A line that a dictionary holds word for word shrinks to a reference, so it needs no deflate. Any other line is deflated
with and without the dictionaries; one that shrinks abnormally is suspected, and verified when exact pieces of the
dictionaries cover most of its letters. Closings must stand directly above the end of the message or above an earlier
message, one below the other. What no dictionary can show, since the earlier message is not in the corpus or a
signature was never seen before, is found by the frame of a message: quote marks, lines that introduce a quote, header
blocks, closing formulas with what looks like a signature below. All that is not verified is new and kept.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import doc_key, with_type
from millrace.operators.skew import left_join_by_state
from millrace.session import cut

#: A line is a closing when it stands in this share of the messages, and in so many of them. There are at most
#: (mean lines of a message) / CLOSING_SHARE closings, so the set can be sent to every worker.
CLOSING_SHARE, CLOSING_LEAST = 0.001, 3
#: The same for the messages of one sender, so a sender has at most (mean lines of a message) / SENDER_SHARE closings.
SENDER_SHARE, SENDER_LEAST = 0.02, 2
#: Share of a closing's places at which it stands as closings do, see ``closing_counts``.
SETTLED = 0.8
#: A recurring line that opens so great a share of the messages it stands in is a greeting.
OPENING = 0.5
#: Shorter lines say too little to be an exact overlap with an ancestor.
OVERLAP_CHARS = 25
#: Share of its deflated length that a line must lose by the dictionaries to be suspect.
ABNORMAL_GAIN = 0.35
#: Characters of an exact piece, line ends included, and the share of a line's letters that pieces must cover.
PIECE, COVERED = 5, 0.6
#: The same share for a line that ends a sentence, which may be newly written in part.
SENTENCE_COVERED = 0.8
#: A dictionary is tried in blocks within the deflate window; half of each is the next one's too, so no passage of half a block is cut.
BLOCK = 30_000
ANCESTOR, CLOSING_PATH, FRAME = "ancestor", "closing", "frame"

_DATE = r"(?:\d{4}\s*[-./년]\s*\d{1,2}|\d{1,2}[./]\d{1,2})"
#: Single lines that introduce an earlier message.
INTRO = re.compile(
    rf"^(?:{_DATE}.{{0,60}}(?:님이|께서|이|가)\s*(?:쓰신 글|작성|보낸 글|보낸 내용)\s*[.:]?|.{{1,40}}님이\s.{{0,40}}(?:보낸 내용입니다|쓰신 글입니다|보낸 글입니다)[.:]?"
    r"|On\s.{3,120}\swrote:|-{1,3}\s?.{2,60}\swrote on\s.{4,40}\s-{1,3}|.{2,60}\([^()\s]+@[^()\s]+\)\s(?:said|wrote) on\s.{4,40}:|.{2,60}<[^<>\s]+@[^<>\s]+>\s?(?:wrote|said|님이 작성|작성|님이 쓴 글)\s?:)$"
)
INTRO_HEAD = re.compile(rf"^(?:{_DATE}.{{0,60}},\s*\S.{{0,40}}|On\s.*\d.{{0,60}})$")
INTRO_TAIL = re.compile(r"^<[^<>\s]+@[^<>\s]+>\s?(?:님이\s)?(?:작성|wrote|쓴 글|쓰신 글|said)\s?:$")
SEPARATOR = re.compile(r"^(?:[-=_*<\[]{1,20}\s*(?:원본\s?(?:메시지|메일)|전달(?:된 메시지)?|original (?:message|mail)|forwarded (?:message|mail))\s*[-=_*>\]]{1,20}|begin forwarded message:|_{10,})$", re.I)
HEADER = re.compile(r"^(보낸\s?사람|보낸\s?날짜|받는\s?사람|참조|제목|날짜|일시|from|sent|to|cc|bcc|date|subject|reply-to)\s*:", re.I)
MARK = re.compile(r"^\s*((?:[>|]\s?)+)(.*)$")
TABLE_ROW = re.compile(r"^\s*\|[^|]*\|.*\|\s*$")
GREETING = re.compile(r"^(?:안녕하(?:세요|십니까).*|\S{1,12}\s?(?:님|께)[,.]?|(?:hi|hello|dear)\b.{0,40}[,!.]?|[A-Z][a-z]+,)$", re.I)
_CLOSE = r"(?:대단히\s)?(?:감사합니다|감사드립니다|고맙습니다|수고하십시오|수고하세요|이만\s줄입니다|(?:best|kind|warm)?\s?regards|thanks(?: again)?|thank you|cheers|sincerely|best|yours(?: truly| sincerely)?)"
CLOSING = re.compile(rf"^{_CLOSE}[.,!]?(?:\s+\S{{1,12}}(?:\s\S{{1,12}})?(?:\s(?:올림|드림|배상))?[.]?)?$", re.I)
CLOSING_STEM = re.compile(rf"^{_CLOSE}(?=[\s.,!]|$)", re.I)
SIGNED = re.compile(r"^\S{1,12}(?:\s\S{1,12}){0,2}\s(?:올림|드림|배상)[.]?$")
RULE = re.compile(r"^(?:[━─═=*~_]{5,}|-{6,})$")
DASHES = re.compile(r"^--\s*$")
DASHED_NAME = re.compile(r"^-\s[^\d\s-][^\d-]{0,24}\s-$")
DEVICE = re.compile(r"^(?:(?:나의 |내 )?(?:휴대전화|휴대폰|스마트폰|모바일|아이폰|갤럭시)(?:에서|로) 보(?:냄|냈습니다|낸 메일입니다)[.]?|(?:sent|get outlook) (?:from|for) (?:my )?[\w .-]{2,30}|(?:My )?(?:handset|phone) sent this[.]?)$", re.I)
CONTACT = re.compile(r"\d{2,4}-\d{3,4}-\d{3,4}|\S+@\S+\.\w+|\b(?:ext|tel|phone|fax|mobile|전화|내선)\b[.: ]|^M\. |전화 ", re.I)
ROLE = re.compile(r"(?:팀|파트|실|본부|그룹|부|센터|책임|매니저|선임|수석|대리|과장|차장|부장|sales|manager|director|team)\s*$", re.I)
SENTENCE = re.compile(r"(?:다|요|까|오|음|함)[.!?]$|[a-z0-9)%][.!?]$")
NAME = re.compile(r"^[^\W\d_]{2,12}(?:[ -][^\W\d_]{2,14}){0,2}$")


@functools.lru_cache(64)
def _deflater(dictionary: bytes) -> object:
    return zlib.compressobj(6, zlib.DEFLATED, -15, 8, zdict=dictionary) if dictionary else zlib.compressobj(6, zlib.DEFLATED, -15, 8)


def _deflated(text: bytes, dictionary: bytes) -> int:
    c = _deflater(dictionary).copy()
    return len(c.compress(text)) + len(c.flush())


def gain(text: str, dictionary: bytes) -> float:
    """Share of its deflated length that ``text`` loses when ``dictionary`` precedes it."""
    data = text.encode()
    return 1 - _deflated(data, dictionary) / max(1, _deflated(data, b""))


def blocks(dictionary: bytes, size: int = BLOCK) -> list[bytes]:
    """Blocks of ``dictionary`` that overlap by half and hold all of it."""
    last = max(len(dictionary) - size, 0)
    return [dictionary[i : i + size] for i in [*range(0, last, size // 2), last]] if dictionary else []


_DIGITS, _RUNS, _MAILBOX = re.compile(r"\d[\d-]*\d"), re.compile(r"(\W)\1{4,}"), re.compile(r"[^\s@|<>(]+@")


def shape(line: str) -> str:
    """A line with numbers of two digits or more as 9, mail boxes without their name, and runs of one sign as five."""
    return _RUNS.sub(r"\1\1\1\1\1", _DIGITS.sub("9", _MAILBOX.sub("@", line)))


def _pieces(line: str) -> set[str]:
    t = f"\n{line}\n"
    return {t[i : i + PIECE] for i in range(max(1, len(t) - PIECE + 1))}


class Dictionary:
    """Lines, as shapes, with their exact pieces and the blocks to deflate by; the most frequent lines last, where deflate finds them nearest."""

    def __init__(self, lines: Iterable[str] = ()):
        listed = list(dict.fromkeys(lines))
        self.lines = frozenset(listed)
        self.pieces = frozenset().union(*map(_pieces, listed))
        self.blocks = blocks("\n".join(listed).encode())
        self._shrinks = functools.lru_cache(100_000)(lambda line: any(gain(f"\n{line}\n", b) >= ABNORMAL_GAIN for b in self.blocks))

    def shrinks(self, line: str) -> bool:
        """Whether ``line`` shrinks abnormally by any block; remembered, since such lines recur."""
        return self._shrinks(line)


def covered(line: str, dictionaries: list[Dictionary], name: str = "") -> float:
    """Share of the letters and digits of ``line`` that lie in exact pieces of the dictionaries' lines, or in ``name``."""
    t = f"\n{line}\n"
    hit = bytearray(len(t))
    for i in range(max(1, len(t) - PIECE + 1)):
        if any(t[i : i + PIECE] in d.pieces for d in dictionaries):
            hit[i : i + PIECE] = b"\1" * PIECE
    if name and name in t:
        at = t.index(name)
        hit[at : at + len(name)] = b"\1" * len(name)
    letters = [i for i, c in enumerate(t) if c.isalnum()]
    return sum(hit[i] for i in letters) / len(letters) if letters else 0.0


def _marks(line: str) -> tuple[int, str]:
    """Depth of quoting and the rest of the line; rows of tables are not quoted."""
    m = MARK.match(line)
    if not m or TABLE_ROW.match(line):
        return 0, line
    return m[1].count(">") + m[1].count("|"), m[2]


def _quotes(lines: list[str]) -> list[bool]:
    """Lines of earlier messages and those that introduce them."""
    n, out = len(lines), [False] * len(lines)
    text = [x.strip() for x in lines]
    depth = [_marks(x)[0] for x in lines]
    following = lambda i: next((j for j in range(i, n) if text[j]), n)
    i = 0
    while i < n:
        if depth[i]:
            out[i] = True
            i += 1
            continue
        j = following(i + 1)
        start = end = None
        if INTRO.match(text[i]):
            start, end = i, i
        elif INTRO_HEAD.match(text[i]) and j < n and j == i + 1 and INTRO_TAIL.match(text[j]):
            start, end = i, j
        elif SEPARATOR.match(text[i]) and (not text[i].startswith("___") or (j < n and HEADER.match(text[j]))):
            start, end = i, i
        elif HEADER.match(text[i]) and i + 1 < n and HEADER.match(text[i + 1]) and text[i].split(":")[0] != text[i + 1].split(":")[0]:
            start, end = i, i
        if start is None:
            i += 1
            continue
        k = following(end + 1)
        while k < n and (HEADER.match(text[k]) or (k == end + 1 and INTRO_TAIL.match(text[k]))):
            end = k
            k = following(k + 1)
        for x in range(start, end + 1):
            out[x] = True
        if k < n and depth[k]:
            i = k  # marked lines follow; what stands between them is an answer
        else:
            for x in range(k, n):  # without marks the earlier message goes on to the end
                out[x] = True
            break
    return out


def _signature_like(text: str, sender: str) -> bool:
    if not text or len(text) > 70:
        return False
    if RULE.match(text) or CONTACT.search(text) and not SENTENCE.search(text) or SIGNED.match(text) or DASHED_NAME.match(text):
        return True
    if SENTENCE.search(text):
        return False
    if sender and sender in text and len(text) <= len(sender) + 30:
        return True
    return bool(len(text) <= 50 and (ROLE.search(text) or NAME.match(text) or re.match(r"^[^,/|]{2,24}\s?[,/|]\s?[^,/|]{2,30}$", text)))


def _signature(lines: list[str], skip: list[bool], sender: str) -> list[bool]:
    """Closing formulas, device notes, signatures and their rules among the lines that are not skipped."""
    n, out = len(lines), [False] * len(lines)
    text = [x.strip() for x in lines]
    own = [i for i in range(n) if not skip[i] and text[i]]
    for at, i in enumerate(own):
        if out[i]:
            continue
        rest = own[at + 1 :]
        t = text[i]
        if DEVICE.match(t):
            out[i] = True
            continue
        if RULE.match(t):
            # the lines up to the next rule, as long as each may stand in a signature
            inside: list[int] = []
            for j in rest:
                if RULE.match(text[j]):
                    if inside:
                        for x in (i, *inside, j):
                            out[x] = True
                    break
                if len(text[j]) > 70 or SENTENCE.search(text[j]):
                    break
                inside.append(j)
            continue
        if not (CLOSING.match(t) or SIGNED.match(t) or DASHES.match(t) or DASHED_NAME.match(t)):
            continue
        if DASHES.match(t) and not (rest and _signature_like(text[rest[0]], sender)):
            continue
        if GREETING.match(t) and not CLOSING.match(t) and not SIGNED.match(t):
            continue
        out[i] = True
        previous = i
        for j in rest:
            # a signature is one block, at most one blank line below its closing
            if j - previous > 2 or CLOSING.match(text[j]) or DEVICE.match(text[j]) or GREETING.match(text[j]) or not _signature_like(text[j], sender):
                break
            out[j] = True
            previous = j
    return out


#: Bits of a line of a message's own part: a row of a table, the last one before the end or an earlier message, in a signature by its frame.
TABLE, LAST, SIGNED_BIT = 1, 2, 4


@dataclass(frozen=True)
class Frame:
    """A message by its frame: numbers of quoted lines, and number, tidy text and flags of each line of the own part."""

    quoted: list[int]
    no: list[int]
    text: list[str]
    flags: list[int]
    long: list[str] = field(default_factory=list)  # long lines of the whole message without quote marks


def framed(body: str, sender: str = "") -> Frame:
    lines = [x.rstrip("\r") for x in body.split("\n")]
    quoted = _quotes(lines)
    signed = _signature(lines, quoted, sender)
    text = [" ".join(line.split()) for line in lines]
    own = [i for i, t in enumerate(text) if t and not quoted[i]]
    following = {i: quoted[j] for i, j in zip((k for k, t in enumerate(text) if t), [k for k, t in enumerate(text) if t][1:], strict=False)}
    flags = [TABLE * bool(TABLE_ROW.match(lines[i])) + LAST * following.get(i, True) + SIGNED_BIT * signed[i] for i in own]
    bare = (" ".join(_marks(x)[1].split()) if quoted[i] else text[i] for i, x in enumerate(lines))
    return Frame([i + 1 for i, t in enumerate(text) if t and quoted[i]], [i + 1 for i in own], [text[i] for i in own], flags, [x for x in bare if len(x) >= OVERLAP_CHARS])


def not_new(message: Frame, closings: Dictionary, senders: Dictionary, ancestors: dict[str, bool], sender: str = "") -> list[tuple[int, str]]:
    """(number, path) of the lines, from 1, that the sender did not newly write, and what showed it.

    ``ancestors``: lines of this message that an earlier one holds, with whether that one has the same subject.
    """
    n = len(message.no)
    path: list[str | None] = [FRAME if f & SIGNED_BIT else None for f in message.flags]
    # an overlap with another subject's message is verified when neighbours share it; one line alone may agree by chance
    held = [t in ancestors for t in message.text]
    for i, t in enumerate(message.text):
        if held[i] and not message.flags[i] & TABLE and (ancestors[t] or held[i - 1 : i] == [True] or held[i + 1 : i + 2] == [True]):
            path[i] = ANCESTOR
    both = [d for d in (closings, senders) if d.lines]

    def closing(i: int) -> bool:
        s = shape(message.text[i])
        if any(s in d.lines for d in both):
            return True
        if message.flags[i] & TABLE or GREETING.match(message.text[i]) or not any(d.shrinks(s) for d in both):
            return False
        return covered(s, both, sender) >= (SENTENCE_COVERED if SENTENCE.search(message.text[i]) else COVERED)

    below = False
    for i in range(n - 1, -1, -1):
        if message.flags[i] & LAST:
            below = True
        if below and path[i] != ANCESTOR and closing(i):
            path[i] = CLOSING_PATH
        below = below and path[i] is not None
    return sorted([(no, p) for no, p in zip(message.no, path, strict=True) if p] + [(no, FRAME) for no in message.quoted])


def typed_emails(raw: DataFrame, source_types: DataFrame, code: str = "EMAIL") -> DataFrame:
    """(raw_no, key, sender, at, subject, body) of the rows of type ``code`` that have a body; a subject without reply and forward marks."""
    title = F.col("title") if "title" in raw.columns else F.lit(None).cast("string")
    typed = with_type(raw.select("raw_no", "doc_id", "doc_type", "author", "published_at", title.alias("title"), "body"), source_types).where(F.col("type_code") == code)
    subject = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?i)^(?:\s*(?:re|fw|fwd|회신|답장|전달)\s*:)+", "")))
    return typed.where("body is not null").select("raw_no", F.coalesce(doc_key("doc_id"), F.concat(F.lit("#"), "raw_no")).alias("key"), F.col("author").alias("sender"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"), subject.alias("subject"), "body")


def frames(emails: DataFrame) -> DataFrame:
    """Every message by its frame, see ``Frame``; the body is not needed after this."""
    kept = ", ".join(f"{c} {emails.schema[c].dataType.simpleString()}" for c in ("raw_no", "key", "sender", "at", "subject"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [framed(body, sender or "") for body, sender in zip(batch["body"], batch["sender"], strict=True)]
            yield batch.drop(columns="body").assign(quoted=[x.quoted for x in found], no=[x.no for x in found], text=[x.text for x in found], flags=[x.flags for x in found], long=[x.long for x in found])

    return emails.mapInPandas(run, f"{kept}, quoted array<int>, no array<int>, text array<string>, flags array<int>, long array<string>")


def recurring(messages: DataFrame, n_messages: int) -> DataFrame:
    """(line): lines that recur over the messages' own parts and are no greetings; at most (mean lines of a message) / CLOSING_SHARE rows."""
    least = max(CLOSING_LEAST, CLOSING_SHARE * n_messages)
    lines = messages.select("key", F.posexplode("text").alias("pos", "line"), "flags").where(F.get("flags", F.col("pos")).bitwiseAND(TABLE) == 0)
    # one row per line and key first, so that a hot line is counted with a map-side combine
    per_key = lines.groupBy("line", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("opens"))
    counts = per_key.groupBy("line").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"), F.sum("opens").alias("opens"))
    return counts.where((F.col("keys") >= least) & (F.col("opens") < OPENING * F.col("n"))).select("line")


def closing_counts(messages: DataFrame, known: list[str]) -> DataFrame:
    """(shape, sender, keys, n, settled): how often the shapes of own lines stand in the messages of a sender, and how often as closings do.

    A line is settled when it stands at or below a recurring line, and above the end, a recurring line or no sentence.
    """
    sent = messages.sparkSession.sparkContext.broadcast(frozenset(known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, sender, text, flags in zip(batch["key"], batch["sender"], batch["text"], batch["flags"], strict=True):
                below = False
                for i, (line, flag) in enumerate(zip(text, flags, strict=True)):
                    if flag & TABLE:
                        continue
                    below = below or line in sent.value
                    ends = flag & LAST or text[i + 1] in sent.value or not SENTENCE.search(text[i + 1])
                    rows.append((shape(line), key, sender, bool(below and ends)))
            yield pd.DataFrame(rows, columns=["shape", "key", "sender", "settled"])

    rows = messages.select("key", "sender", "text", "flags").mapInPandas(run, "shape string, key string, sender string, settled boolean")
    per_key = rows.groupBy("shape", "sender", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("settled").alias("settled"))
    return per_key.groupBy("shape", "sender").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"), F.sum("settled").alias("settled"))


def sender_closings(messages: DataFrame, counts: DataFrame) -> DataFrame:
    """(sender, closings): the lines that recur over the messages of a sender; at most (mean lines of a message) / SENDER_SHARE each."""
    sizes = messages.where("sender is not null").groupBy("sender", "key").agg(F.lit(1)).groupBy("sender").agg(F.count(F.lit(1)).alias("messages"))
    often = counts.where((F.col("keys") >= SENDER_LEAST) & (F.col("settled") >= SETTLED * F.col("n"))).join(sizes, "sender").where(F.col("keys") >= SENDER_SHARE * F.col("messages"))
    return often.groupBy("sender").agg(F.sort_array(F.collect_list(F.struct("keys", "shape"))).alias("c")).select("sender", F.transform("c", lambda x: x["shape"]).alias("closings"))


def ancestor_lines(messages: DataFrame, n_messages: int) -> DataFrame:
    """(raw_no, ancestors): a message's long lines that an earlier message of another key holds, with whether the first such message has its subject.

    Only prints are grouped. Lines of threads that many messages quote are few (their places are counted by
    ``CLOSING_SHARE``), so their first messages are broadcast and no line's group is shuffled whole. Of messages of one
    time the lesser key is the earlier; those without a time come last.
    """
    long = messages.select("raw_no", "key", "at", "subject", F.explode("long").alias("line")).select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    order = F.struct(F.col("at").isNull(), F.col("at"), F.col("key"))
    first = cut(
        long.groupBy("h", "h2").agg(F.min_by(F.struct("key", "subject"), order).alias("f"), F.max("key").alias("a"), F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("h", "h2", F.col("f.key").alias("first"), F.col("f.subject").alias("its"), "n"),
        "shared-lines",
    )
    least = max(CLOSING_LEAST, CLOSING_SHARE * n_messages)
    hot = F.broadcast(first.where(F.col("n") >= least).drop("n"))
    cold = first.where(F.col("n") < least).drop("n")
    thread = (F.col("subject") == F.col("its")) & (F.col("subject") != "")
    met = [long.join(part, ["h", "h2"]).where("key <> first").select("raw_no", "line", thread.alias("thread")) for part in (hot, cold)]
    return met[0].unionByName(met[1]).groupBy("raw_no").agg(F.collect_set(F.struct("line", "thread")).alias("ancestors"))


def line_paths(raw: DataFrame, source_types: DataFrame) -> DataFrame:
    """(raw_no, line_no, path) of every non-blank email line that its sender did not newly write, and what showed it.

    Null bodies and rows of other types give no row, an empty table an empty table. Only the columns named in
    ``typed_emails`` are read; a missing or null title is no subject, a null sender has no closings of its own.
    """
    messages = cut(frames(typed_emails(raw, source_types)), "messages")
    n = messages.select("key").distinct().count()
    known = [r.line for r in recurring(messages, n).collect()]  # bounded, see CLOSING_SHARE
    counts = cut(closing_counts(messages, known), "closings")
    least = max(CLOSING_LEAST, CLOSING_SHARE * n)
    often = counts.groupBy("shape").agg(F.sum("keys").alias("keys"), F.sum("n").alias("n"), F.sum("settled").alias("settled")).where((F.col("keys") >= least) & (F.col("settled") >= SETTLED * F.col("n")))
    common = [r["shape"] for r in often.orderBy("keys", "shape").collect()]  # bounded likewise
    sent = messages.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closings, empty = Dictionary(sent.value), Dictionary()
        for batch in batches:
            rows = []
            for m in batch.itertuples(index=False):
                own = Dictionary(m.closings) if m.closings is not None and len(m.closings) else empty
                ancestors = {} if m.ancestors is None else {a["line"]: a["thread"] for a in m.ancestors}
                found = Frame(list(m.quoted), list(m.no), list(m.text), list(m.flags))
                rows += [(m.raw_no, *x) for x in not_new(found, closings, own, ancestors, m.sender or "")]
            yield pd.DataFrame(rows, columns=["raw_no", "line_no", "path"]).astype({"line_no": "int32"})

    met = left_join_by_state(messages.drop("long", "key", "at", "subject"), sender_closings(messages, counts), "sender").join(ancestor_lines(messages, n), "raw_no", "left")
    return met.mapInPandas(run, f"raw_no {raw.schema['raw_no'].dataType.simpleString()}, line_no int, path string")


def not_new_lines(raw: DataFrame, source_types: DataFrame) -> DataFrame:
    """(raw_no, line_no) of the lines of ``line_paths``."""
    return line_paths(raw, source_types).select("raw_no", "line_no")


def newly_written(raw: DataFrame, source_types: DataFrame) -> DataFrame:
    """(raw_no, body) of every email: its newly written lines, blank lines at the ends left out."""
    emails = typed_emails(raw, source_types)
    gone = not_new_lines(raw, source_types).groupBy("raw_no").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i + 1))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+|\s+\z", "")
    return emails.join(gone, "raw_no", "left").select("raw_no", text.alias("body"))
