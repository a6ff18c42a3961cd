"""Tokenizers, n-grams and overlap measures as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The characters of a word: letters, digits, underscore, per cent and full stop, over all scripts.
WORD = r"[\p{L}\p{N}_%.]+"
#: Words that overlap measures compare: Hangul, Latin letters and digits, two or more.
KEYWORD = "[가-힣A-Za-z0-9]{2,}"
#: Korean particles, longer ones first, taken off the end of a token.
PARTICLES = ["으로부터", "에서부터", "이라고", "에게서", "으로서", "으로써", "에서", "에게", "께서", "부터", "까지", "마저", "조차", "처럼", "보다", "이나", "이며", "이고", "으로", "하고", "의", "는", "은", "이", "가", "을", "를", "에", "로", "와", "과", "도", "만", "나", "랑", "며"]
#: Words that required elements are not judged by.
ELEMENT_STOP_WORDS = ["또는", "제시", "표기", "수치", "내용"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """Lower-case words in order of appearance; null text has none."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(0))


def stems(c: Column | str) -> Column:
    """Words without one trailing particle, for words of three or more characters that end in Hangul."""
    particle = f"({'|'.join(PARTICLES)})$"
    return F.transform(words(c), lambda w: F.when((F.length(w) > 2) & w.rlike("[가-힣]$"), F.regexp_replace(w, particle, "")).otherwise(w))


_PARTICLE = re.compile(f"({'|'.join(PARTICLES)})$")
_points: list[bytes] = []


def stem(word: str) -> str:
    """What ``stems`` makes of a word."""
    return _PARTICLE.sub("", word) if len(word) > 2 and "가" <= word[-1] <= "힣" else word


def word_points(spark: SparkSession) -> bytes:
    """A bit for each code point: whether words hold it. The engine's own expression is asked, once a driver, so that ``split_words`` agrees with ``words``."""
    if not _points:
        plain = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        rows = [("".join(map(chr, plain[i : i + 0x4000])),) for i in range(0, len(plain), 0x4000)]
        found = spark.createDataFrame(rows, "t string").select(F.array_join(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "").alias("w")).collect()
        flags = np.zeros(0x110000, bool)
        for r in found:
            flags[np.frombuffer(r.w.encode("utf-32-le"), np.uint32)] = True
        _points.append(np.packbits(flags).tobytes())
    return _points[0]


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def split_words(points: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> tuple:
    """(words, row of each) of lower-case texts given as ``points_of``: the runs of code points for which ``held`` is true."""
    import pyarrow as pa

    kept = np.flatnonzero(held[points])
    row = np.repeat(np.arange(len(sizes)), sizes)[kept]
    own = points[kept]
    starts = np.flatnonzero(np.append(True, (np.diff(kept) != 1) | (np.diff(row) != 0))) if len(kept) else kept
    ends = np.append(0, np.cumsum(1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)))
    offsets = ends[np.append(starts, len(kept))].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(own.tobytes().decode("utf-32-le").encode()))
    return words, row[starts]


def keywords(c: Column | str) -> Column:
    """Distinct keywords of a text."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(KEYWORD), F.lit(0)))


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters; none for a shorter text."""
    return F.array_distinct(all_grams(text, n))


def all_grams(text: Column, n: int) -> Column:
    """Substrings of ``n`` characters in order, repetitions kept; none for a shorter text.

    A match of no width before every character that has ``n`` or more to go, so the text is walked once, not once a place.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def char_grams(c: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams of a text without its white space."""
    return grams(F.regexp_replace(_c(c), r"\s+", ""), n)


def shingles(c: Column | str, n: int = 5) -> Column:
    """Distinct n-grams of a text with white space as one space; a shorter text is its own single shingle."""
    text = F.regexp_replace(_c(c), r"\s+", " ")
    return let(text, lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(grams(t, n)))


def share_in(a: Column, b: Column, empty: float) -> Column:
    """Share of the array ``a`` that is in ``b``; ``empty`` where ``a`` has nothing."""
    return let(a, lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)).otherwise(F.lit(empty)))


def coverage(a: Column | str, b: Column | str, empty: float = 0.0, n: int = 3) -> Column:
    """Share of the n-grams of ``a`` that occur in ``b``. Relevance judgement takes an empty ``a`` as covered (1.0), answer metrics as not (0.0)."""
    return share_in(char_grams(a, n), char_grams(b, n), empty)


def keyword_overlap(a: Column | str, b: Column | str) -> Column:
    return share_in(keywords(a), keywords(b), 0.0)


def stem_overlap(query: Column | str, text: Column | str) -> Column:
    """Share of the distinct stems of the query found among those of the text."""
    return share_in(F.array_distinct(stems(query)), F.array_distinct(stems(text)), 0.0)


def element_hit(element: Column | str, answer: Column | str) -> Column:
    """Share of an element's keywords, repetitions kept, that occur anywhere in the answer."""
    found = F.filter(F.regexp_extract_all(_c(element), F.lit(KEYWORD), F.lit(0)), lambda w: ~w.isin(*ELEMENT_STOP_WORDS))
    return let(found, lambda f: F.when(F.size(f) > 0, F.size(F.filter(f, lambda w: F.contains(_c(answer), w))) / F.size(f)).otherwise(F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return let(union, lambda u: F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0)))


def _morphemes(c: Column | str) -> Column:
    """Nouns, stems, foreign words and numbers by the optional morphological analyser; without it, stems."""
    try:
        import kiwipiepy  # noqa: F401
    except ImportError:
        return stems(c)
    import pandas as pd

    @F.pandas_udf("array<string>")
    def analysed(texts: pd.Series) -> pd.Series:
        from kiwipiepy import Kiwi

        kiwi = Kiwi()
        kept = ("NN", "NP", "NR", "VV", "VA", "SL", "SN", "SH", "XR")
        return texts.map(lambda t: [m.form.lower() for m in kiwi.tokenize(t or "") if m.tag.startswith(kept)])

    return analysed(F.col(c) if isinstance(c, str) else c)


#: Tokenizers by name, each a function of a text column.
TOKENIZERS: dict[str, Callable[[Column | str], Column]] = {"space": words, "josa": stems, "kiwi": _morphemes}


def tokenizer(name: str) -> Callable[[Column | str], Column]:
    """The tokenizer of that name; an unknown name gives plain words."""
    return TOKENIZERS.get(name, words)
