"""Inspection, cleaning and sentence functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.tokens import let
from millrace.sources.registry import SOURCES

#: What begins the quoted original of an email, its signatures and notices.
EMAIL_CUT = [r"-{3,}\s*Original Message\s*-{3,}", r"^보낸 사람\s*:", r"^From\s*:", r"^-----.*원본 메시지"]
EMAIL_SIGNATURE = [r"감사합니다\.?\s*$", r".*\|\s*0\d{1,2}-\d{3,4}-\d{4}.*", r".*\S+@\S+\.\S+.*", r".*드림\s*$"]
EMAIL_NOTICE = [r"본 메일은.*", r"This e-?mail.*confidential.*"]
#: How a whole sentence or label ends.
WHOLE_END = r"([.!?。…]|다|요|음|함|임|됨|중|것|\)|\]|%|원|EB|달러)\s*$"
#: Figures with units, unique codes.
NUMBER = r"\d[\d,\.]*\s*(?:%|원|달러|억|조|배|EB|TB|GB|bp|나노|단)"
UNIQUE = r"([A-Z]{2,}[-_]?\d+|\d[\d,\.]{2,}\s*(?:%|억|조|EB|TB|GB|달러|원)?|[A-Z]{3,})"
REPEATED_LEAST, REPEATED_LONGEST = 2, 60


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column | str) -> Column:
    return F.split(_c(c), "\n")


def count_tokens(c: Column | str) -> Column:
    """Estimated tokens: 0.8 a Hangul syllable and a quarter of any other visible character, rounded half up."""
    hangul = F.length(F.regexp_replace(_c(c), "[^가-힣]", ""))
    other = F.length(F.regexp_replace(_c(c), r"[가-힣\s]", ""))
    return F.floor(hangul * F.lit(0.8) + other / 4 + 0.5).cast("int")


def remove_repeated_lines(c: Column | str, least: int = REPEATED_LEAST, longest: int = REPEATED_LONGEST) -> Column:
    """Every occurrence of a short line that stands ``least`` times or more is taken out.

    Lines are sorted once: a line is repeated when an equal one stands ``least - 1``
    places further on, so no line is compared with all others.
    """
    trimmed = lambda ls: F.array_sort(F.filter(F.transform(ls, strip), lambda x: (x != "") & (F.length(x) <= longest)))
    repeated = lambda t: F.array_distinct(F.filter(t, lambda x, i: (i + least - 1 < F.size(t)) & (F.get(t, i + least - 1) == x)))
    without = lambda ls, gone: F.array_join(F.filter(ls, lambda x: ~F.array_contains(gone, strip(x))), "\n")
    return let(lines(c), lambda ls: let(let(trimmed(ls), repeated), lambda gone: without(ls, gone)))


def clean_email(c: Column | str) -> Column:
    """The part before the first quoted original, without ``>`` lines, signatures and notices."""
    all_lines = lines(c)
    cut = "|".join(f"(?:{p})" for p in EMAIL_CUT)
    marked = F.transform(all_lines, lambda x: strip(x).rlike(cut))
    at = F.array_position(marked, True).cast("int")
    head = let(at, lambda n: F.when(n > 0, F.slice(all_lines, 1, F.greatest(n - 1, F.lit(0)))).otherwise(all_lines))
    drop = "^(?:" + "|".join(f"(?:{p})" for p in EMAIL_SIGNATURE + EMAIL_NOTICE) + ")"
    return strip(F.array_join(F.filter(head, lambda x: ~F.ltrim(x).startswith(">") & ~strip(x).rlike(drop)), "\n"))


def clean(c: Column | str, doc_type: Column | str) -> Column:
    """The cleaning of a document's type: email, repeated lines, noise patterns, then white space. Unknown types get the last only."""
    kind = F.col(doc_type) if isinstance(doc_type, str) else doc_type
    of = lambda flag: [code for code, s in SOURCES.items() if getattr(s, flag)]
    email = let(_c(c), lambda t: F.when(kind.isin(*of("strip_email")), clean_email(t)).otherwise(t))
    single = let(email, lambda t: F.when(kind.isin(*of("strip_repeat")), remove_repeated_lines(t)).otherwise(t))

    def without_noise(t: Column) -> Column:
        out = None
        for code, source in SOURCES.items():
            own = t
            for pattern in source.noise:
                own = F.regexp_replace(own, f"(?md){pattern}", "")
            out = F.when(kind == code, own) if out is None else out.when(kind == code, own)
        return out.otherwise(t)

    text = let(single, without_noise)
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def noise_left(c: Column | str, doc_type: Column | str) -> Column:
    """True where a pattern that cleaning would remove still occurs."""
    kind = F.col(doc_type) if isinstance(doc_type, str) else doc_type
    found = F.lit(False)
    for code, source in SOURCES.items():
        patterns = [*source.noise, *(EMAIL_CUT + EMAIL_NOTICE if source.strip_email else [])]
        if patterns:
            found = found | ((kind == code) & _c(c).rlike("(?md)" + "|".join(f"(?:{p})" for p in patterns)))
    return F.coalesce(found, F.lit(False))


def ends_mid_sentence(c: Column | str) -> Column:
    text = F.regexp_replace(_c(c), r"\s+$", "")
    return (text != "") & ~text.rlike(WHOLE_END)


def table_suspect(c: Column | str) -> Column:
    """Three lines or more in a row with two figures each, under 60 characters and without a bar: a table without delimiters."""
    row = lambda x: (F.regexp_count(x, F.lit(r"\d+(?:\.\d+)?%?")) >= 2) & (F.length(x) < 60) & ~F.contains(x, F.lit("|"))
    marks = F.array_join(F.transform(lines(c), lambda x: F.when(row(x), "1").otherwise("0")), "")
    return F.contains(marks, F.lit("111"))


def has_header(c: Column | str, title: Column | str) -> Column:
    """A date or the first eight characters of the title within the first 120 characters."""
    start = F.substring(_c(c), 1, 120)
    head = F.substring(_c(title), 1, 8)
    return start.rlike(r"20\d\d[-./]\d{1,2}") | ((head != "") & F.contains(start, head))


def build_header(kind: Column | str, at: Column | str, org: Column | str, title: Column | str, section: Column | None = None) -> Column:
    """``[type | date | organisation | title | section]``; blank parts are left out, a missing date is named so."""
    at = F.col(at) if isinstance(at, str) else at
    parts = [_c(kind), F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("날짜미상")), _c(org), _c(title), *([_c(section)] if section is not None else [])]
    return F.concat(F.lit("["), F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " | "), F.lit("]"))


def sentences(c: Column | str, least: int = 10) -> Column:
    """Sentences of ``least`` characters or more, cut after . ! ? before white space and at line ends."""
    cut = F.split(F.regexp_replace(_c(c), r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(cut, strip), lambda x: F.length(x) >= least)


def candidate_sentences(c: Column | str, least: int = 25, most: int = 160, korean: bool = True) -> Column:
    """Sentences fit to be asked for: no quotes, headings, tables or lists of figures; whole sentences of several words."""
    def fit(x):
        ok = (F.length(x) <= most) & x.rlike(r"[\p{L}\p{N}_]") & ~x.rlike(r"^(>|-----|#|\[)") & ~F.contains(x, F.lit("이전 메일")) & ~F.contains(x, F.lit("|")) & ~x.rlike(r"^\s*[0-9.]+\s") & (F.regexp_count(x, F.lit(r"\.")) <= 6)
        return ok & x.rlike(r"(다|요|음|함|임|됨|것|정|표)[.!?]?$") & (F.regexp_count(x, F.lit("[가-힣]{2,}")) >= 3) if korean else ok

    return F.filter(sentences(c, least), fit)


def difficulty(c: Column | str) -> Column:
    """easy where a sentence holds a unique code or figure, else mid."""
    return F.when(_c(c).rlike(UNIQUE), "easy").otherwise("mid")
