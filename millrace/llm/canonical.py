"""One form for texts that look alike, computed on code-point arrays.

The Arrow text of a batch becomes one numpy array of code points. A lookup table over all of Unicode gives each code
point its expansion (nothing, itself, its base with marks, the letters of a typographic join, the Latin letter it looks
like); the expansions are gathered by offsets, marks are put in canonical order and composed by vector operations, and
the array goes back to Arrow. No step runs per row.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Letters of other scripts and the Latin letters they are drawn like.
LOOK_ALIKES = {
    "а": "a", "в": "в", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɡ": "g", "ɑ": "a", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    "µ": "μ", "‐": "-", "‑": "-", "∶": ":", "⁄": "/", "∕": "/", "⁎": "*", "∗": "*", "ꓸ": ".", "․": ".", "‚": ",", "ǃ": "!",
}
def confusables(path: str) -> dict[str, str]:
    """Look-alikes of a file in the public format of Unicode's confusables data: ``source ; target ; type # comment``, code points in hex.

    Only single characters that stand for a single Latin letter or sign are taken, since others would change what a
    reader sees; the table can replace ``LOOK_ALIKES`` where the file is at hand.
    """
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            source, _, rest = line.partition("#")[0].partition(";")
            target = rest.partition(";")[0].split()
            if source.split() and len(source.split()) == len(target) == 1:
                a, b = chr(int(source.strip(), 16)), chr(int(target[0], 16))
                if not a.isascii() and b.isascii():
                    out[a] = b
    return out


#: Joins of Latin letters, written as one sign.
JOINS = [*range(0xFB00, 0xFB07), 0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3]
#: Signs that leave no mark though their category is not Cf: grapheme joiner, jamo fillers, Khmer vowels, variation selectors.
NO_MARK = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Bytes of text folded at once; the arrays of a slice take some sixty times as much.
SLICE_BYTES = 1 << 20
LINE_BREAKS = [0x0B, 0x0C, 0x85, 0x2028, 0x2029]
BLANK_SIGNS = [0x09, 0x2800]
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _folded(ch: str) -> str:
    """What one character stands for, before marks are composed."""
    code, kind = ord(ch), unicodedata.category(ch)
    if code in LINE_BREAKS:
        return "\n"
    if ch in "\n\r":
        return ch
    if kind == "Zs" or code in BLANK_SIGNS:
        return " "
    if kind in ("Cf", "Cc") or code in NO_MARK:
        return ""
    shape = unicodedata.decomposition(ch)
    if code in JOINS or shape.startswith(("<wide>", "<narrow>")):
        folded = unicodedata.normalize("NFKD", ch)
        return "".join(map(_folded, folded)) if folded != ch else ch
    return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", ch))


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Expansion start and length by code point, the expansions, combining classes, composable pairs and their results."""
    size = sys.maxunicode + 1
    begin, length = np.arange(size, dtype=np.int64), np.ones(size, np.int8)
    extra: list[int] = []
    ccc = np.zeros(size, np.uint8)
    pairs: dict[int, int] = {}
    for code in range(size):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or 0x3400 <= code < 0xA000 or 0x17000 <= code < 0x18D00 or 0x20000 <= code < 0x2F800 or 0x2FA20 <= code < 0xE0000 or code >= 0xE0200:
            continue  # syllables are composed by rule; ideographs and private signs stand for themselves
        ch = chr(code)
        folded = _folded(ch)
        if folded != ch:
            begin[code], length[code] = size + len(extra), len(folded)
            extra += map(ord, folded)
        ccc[code] = unicodedata.combining(ch)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<" and len(parts.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in parts.split())
            pairs[a << 21 | b] = code
    keys = np.array(sorted(pairs), np.int64)
    return begin, length, np.concatenate([np.arange(size, dtype=np.uint32), np.array(extra, np.uint32)]), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _pair(a: np.ndarray, b: np.ndarray, keys: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The composed code point of each pair, 0 where there is none."""
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, made[at], 0)


def fold(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, one after another, in their common form; ``ends`` has 0 and each row's end."""
    begin, length, expansion, ccc_of, keys, made = _tables()

    def keep(mask: np.ndarray) -> None:
        nonlocal codes, ends
        ends = np.concatenate([[0], np.cumsum(mask)])[ends]
        codes = codes[mask]

    # CR LF is one line break, a lone CR too
    cr = codes == 13
    if cr.any():
        before_lf = np.zeros(len(codes), bool)
        before_lf[:-1] = cr[:-1] & (codes[1:] == 10)
        last = ends[1:][ends[1:] > ends[:-1]] - 1
        before_lf[last] = False
        codes = np.where(cr, np.uint32(10), codes)
        keep(~before_lf)
    # gather the expansions
    count = length[codes].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    where = np.repeat(begin[codes] - total[:-1], count) + np.arange(total[-1])
    codes, ends = expansion[where], total[ends]
    if not len(codes):
        return codes, ends
    # marks: canonical order within the marks after one base
    ccc = ccc_of[codes]
    if ccc.any():
        starts = np.zeros(len(codes), bool)
        starts[ends[:-1][ends[:-1] < len(codes)]] = True
        run = np.cumsum((ccc == 0) | starts)
        wrong = np.zeros(len(codes), bool)
        wrong[1:] = (ccc[1:] > 0) & (ccc[1:] < ccc[:-1]) & (run[1:] == run[:-1])
        if wrong.any():
            at = np.flatnonzero(np.isin(run, run[wrong]))
            order = np.lexsort((np.arange(len(at)), ccc[at], run[at]))
            codes[at] = codes[at[order]]
    # Hangul: leading consonant and vowel, then the trailing consonant
    for least, n, is_first in ((_V, 21, lambda c: (c >= _L) & (c < _L + 19)), (_T + 1, 27, lambda c: (c >= _S) & (c < _S + 11172) & ((c - _S) % 28 == 0))):
        second = (codes >= least) & (codes < least + n)
        if second.any():
            second[ends[:-1][ends[:-1] < len(codes)]] = False
            at = np.flatnonzero(second)
            at = at[is_first(codes[at - 1])]
            first, other = codes[at - 1], codes[at]
            codes[at - 1] = _S + (first - _L) * 588 + (other - _V) * 28 if least == _V else first + (other - _T)
            mask = np.ones(len(codes), bool)
            mask[at] = False
            keep(mask)
    # other marks: the first one that composes with each base, until none does
    seconds = np.unique(keys & (1 << 21) - 1)
    while True:
        ccc = ccc_of[codes]
        at = np.flatnonzero((ccc > 0) | ((codes >= seconds[0]) & (codes <= seconds[-1]) & np.isin(codes, seconds)))
        first_of_row = np.zeros(len(codes) + 1, bool)
        first_of_row[ends[:-1]] = True
        at = at[~first_of_row[at]]
        if not len(at):
            break
        base = np.maximum.accumulate(np.where((ccc == 0) | first_of_row[:-1], np.arange(len(codes)), 0))
        prev = ccc[at - 1]
        near = np.where(ccc[at] > 0, base[at], at - 1)
        open_ = (near == at - 1) | ((prev > 0) & (prev < ccc[at]))
        open_ &= ccc[near] == 0
        result = np.where(open_, _pair(codes[near], codes[at], keys, made), 0)
        hit = result > 0
        if not hit.any():
            break
        near, first = np.unique(near[hit], return_index=True)
        done = at[hit][first]
        ok = ~np.isin(near, done)  # a base that itself composes now waits for the next round
        codes[near[ok]] = result[hit][first][ok]
        mask = np.ones(len(codes), bool)
        mask[done[ok]] = False
        keep(mask)
    return codes, ends


def fold_array(texts: pa.Array) -> pa.Array:
    """The common form of every string of an Arrow array, nulls as empty strings; rows are taken in slices of bounded size."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return pa.array([], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    parts, i = [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        parts.append(_fold_slice(texts.slice(i, j - i)))
        i = j
    return pa.concat_arrays(parts)


def _fold_slice(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]] if n else np.zeros(1, np.int64)
    codes, ends = fold(codes, ends)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    out_ends = np.concatenate([[0], np.cumsum(width)])[ends].astype(np.int64)
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(out_ends.tobytes()), pa.py_buffer(data))


def canonical(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "canonical") -> DataFrame:
    """(id, canonical): every text in its common form; null stays null, an empty text stays empty.

    Width variants, spaces of any kind, line breaks of any kind, joins of letters, look-alike letters and composed or
    separate marks become one; signs without a visible mark vanish. Case, accents, punctuation, raised, circled and
    squared signs stay. A map over Arrow batches without a shuffle; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(1)
            out = fold_array(texts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(texts), out, pa.scalar(None, pa.string()))], [id_col, out_col])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` string")


def _prints(text: str, name: str) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit("second"), F.col(text)).alias(f"{name}2")]


FORM, VARIANT = ["c1", "c2"], ["r1", "r2"]


def _alike(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r1, r2, c1, c2) of the rows whose common form has two stored variants or more: prints of the text and of the form.

    Null and blank texts have no form. Texts meet by 128-bit prints, so no text is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), fold_array(batch.column(3)).cast(pa.string())], ["id", "r1", "r2", "folded"])

    folded = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *_prints(text_col, "r"), text_col).mapInArrow(run, f"id {kind}, r1 bigint, r2 bigint, folded string")
    rows = folded.where(F.translate("folded", " \n", "") != "").select("id", "r1", "r2", *_prints("folded", "c"))
    rows = cut(rows, "prints")  # read several times; 48 bytes a row
    # a form with one variant has equal least and greatest prints; this needs no list of a form's rows
    several = rows.groupBy(*FORM).agg(F.min(F.struct(*VARIANT)).alias("lo"), F.max(F.struct(*VARIANT)).alias("hi")).where("lo <> hi").select(*FORM)
    return rows.join(several, FORM, "left_semi")


def variant_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, variant_id, n_links): one row per row whose text looks like a differently stored one.

    class_id is the least id of the rows that look alike, variant_id the least id of the exact copies, n_links the number
    of rows of the class that are stored differently. Nothing is paired, so a common form costs as many rows as it has.
    """
    members = _alike(df, id_col, text_col)
    variants = members.groupBy(*FORM, *VARIANT).agg(F.min("id").alias("variant_id"), F.count(F.lit(1)).alias("n"))
    classes = variants.groupBy(*FORM).agg(F.min("variant_id").alias("class_id"), F.sum("n").alias("total"))
    linked = variants.join(classes, FORM).select(*FORM, *VARIANT, "class_id", "variant_id", (F.col("total") - F.col("n")).alias("n_links"))
    return members.join(linked, [*FORM, *VARIANT]).select("id", "class_id", "variant_id", "n_links")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows whose texts differ as stored but have one common form.

    Null and blank texts form no pair. Exact copies are collapsed to variants, variants are paired, and the copies of
    either side are attached to the pairs, so copies of one text never meet each other. The result has as many rows as
    there are pairs; ``variant_classes`` says the same in one row per row.
    """
    form, variant = FORM, VARIANT
    members = _alike(df, id_col, text_col)
    variants = members.select(*form, *variant).distinct()
    others = variants.select(*form, F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    pairs = variants.join(others, form).where("struct(r1, r2) < struct(s1, s2)")
    left = pairs.join(members.select(*form, *variant, F.col("id").alias("x")), [*form, *variant])
    right = left.join(members.select(*form, F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("id").alias("y")), [*form, "s1", "s2"])
    return right.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b")
