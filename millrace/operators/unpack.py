"""Several values packed in one field, split by the dialect of least description length.

A dialect is a set of delimiters plus a quoting rule. Every field is parsed under each dialect that its characters
allow; the length of a parse is what it costs to name the dialect plus what it costs to write its items. An item's
code length comes from how often its shape (letters and digit runs as classes) occurs over the whole column, so ids
that hold punctuation themselves are cheaper whole than in pieces. The cheapest dialect parses the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Delimiters in use, as patterns; white space alone is the weakest.
DELIMITERS = {
    "semicolon": "[;；]", "comma": "[,，、]", "bar": r"[|｜]", "slash": "[/／]", "dot": "[·•]", "plus": r"\+", "amp": "&", "and": r"(?<=\s)(?:and|or|및|또는)(?=\s)",
    "break": r"(?:<br\s*/?>|\\r\\n|\\n|\r\n|\r|\n)", "tab": r"(?:\t|\\t)", "space": r"[ \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]",
}
#: What stands for no value.
NONE_WORDS = {"", "-", "--", "–", "—", "n/a", "na", "none", "null", "nil", "nan", "없음", "해당 없음", "해당없음", "미상"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "「": "」", "`": "`"}
BRACKETS = {"[": "]", "{": "}", "(": ")", "<": ">", "【": "】"}
LIST_NUMBER = re.compile(r"^\s*(?:\(?\d{1,3}[.)]|[-*•])\s+(?=\S)")
#: Bits: for naming a delimiter of a dialect, for ending an item, and for a character of a shape never seen.
DELIMITER_BITS, ITEM_BITS, UNSEEN_BITS = 3.0, 1.0, 6.5
#: Characters of parses that a worker holds before it hands them on.
HELD_CHARS = 8_000_000


def shape(item: str) -> str:
    """The class of an item: runs of digits as 9, letters of each kind as one letter kept by case, the rest as it is."""
    out = re.sub(r"\d+", "9", item)
    return re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a" if m[0].isascii() else "한", out)


def _clean(item: str) -> str:
    """An item without outer spaces, quotes, brackets and list number."""
    before = None
    while item != before:
        before = item
        item = LIST_NUMBER.sub("", item.strip())
        if len(item) > 1 and QUOTES.get(item[0]) == item[-1] and item[-1] not in item[1:-1]:
            item = item[1:-1]
        elif len(item) > 1 and BRACKETS.get(item[0]) == item[-1]:
            item = item[1:-1]
        else:
            item = item.strip("\"'“”‘’`") if item[:1] in "\"'“”‘’`" or item[-1:] in "\"'“”‘’`" else item
    return item


def _outer(field: str) -> str:
    """A field without the brackets around the whole of it."""
    field = field.strip()
    while len(field) > 1 and BRACKETS.get(field[0]) == field[-1]:
        field = field[1:-1].strip()
    return field


def parse(field: str, delimiters: tuple[str, ...], quoting: bool) -> list[str]:
    """The items of ``field`` under one dialect; empty items have no place. Delimiters within quotes do not split."""
    inner = _outer(field)
    splits = "|".join(DELIMITERS[d] for d in delimiters)
    if not splits:
        return [x for x in [_clean(inner)] if x]
    if quoting:
        quoted = "|".join(f"{re.escape(a)}[^{re.escape(b)}]*{re.escape(b)}" for a, b in QUOTES.items())
        finder = re.compile(f"({splits})|(?:{quoted})")
        pieces, last, at = [], 0, 0
        while m := finder.search(inner, at):
            at = m.end()
            if m[1] is not None:
                pieces.append(inner[last : m.start()])
                last = at
            elif LIST_NUMBER.sub("", inner[last : m.start()] + ".").strip(" \t\n([{."):
                at = m.start() + 1  # a quote within an item opens nothing
        pieces.append(inner[last:])
    else:
        pieces = re.split(f"(?:{splits})", inner)
    return [x for x in map(_clean, pieces) if x]


def dialects(field: str) -> list[tuple[tuple[str, ...], bool]]:
    """Every dialect that the characters of ``field`` allow: all subsets of the delimiters present, of which there are eleven kinds at most."""
    inner = _outer(field)
    present = [d for d, p in DELIMITERS.items() if re.search(p, inner)]
    chosen = [c for n in range(len(present) + 1) for c in combinations(present, n)]
    has_quotes = any(q in inner for q in QUOTES)
    return [(c, q) for c in chosen for q in ((False, True) if has_quotes and c else (False,))]


def _parses(fields: DataFrame) -> DataFrame:
    """(field, dialect, n_delims, items) for every field and each of its dialects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["field", "dialect", "n_delims", "items", "shapes"]
        for batch in batches:
            rows, held = [], 0
            for field in batch["field"]:
                seen = set()
                for delimiters, quoting in dialects(field):
                    items = tuple(parse(field, delimiters, quoting))
                    if hash(items) not in seen:  # dialects come with few delimiters first, so the cheapest name is kept
                        seen.add(hash(items))
                        rows.append((field, "+".join(delimiters) + ("/quoted" if quoting else ""), len(delimiters), list(items), [shape(x) for x in items]))
                        held += 3 * len(field)
                        if held > HELD_CHARS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return fields.mapInPandas(run, "field string, dialect string, n_delims int, items array<string>, shapes array<string>")


def unpack(df: DataFrame, id_col: str, packed_col: str, item_col: str = "item") -> DataFrame:
    """(id, item_pos, item): one row per packed value in the order of the field, positions from 1.

    Null, empty and blank fields and those that only say none give no row; an item named twice gives two rows. Equal
    fields are parsed once. Shapes are counted over the parses of all fields that hold no delimiter, weighted by how
    many rows hold them, and the counts meet the parses in a join, so no table of shapes is sent to the workers.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(packed_col).alias("field"))
    fields = rows.where(F.trim("field") != "").groupBy("field").agg(F.count(F.lit(1)).alias("weight"))
    # parsed once, read three times; a fixed number of partitions, since a small table takes long to parse
    spread = fields.select("field").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "field")
    parses = cut(_parses(spread), "parses")
    shaped = parses.select("field", "dialect", "n_delims", F.posexplode("shapes").alias("pos", "shape"))
    # a field whose only parse has no delimiter names its shape beyond doubt
    sure = parses.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.max("n_delims").alias("most"), F.first("shapes").alias("shapes")).where("n = 1 and most = 0")
    seen = sure.join(fields, "field").select(F.explode("shapes").alias("shape"), "weight").groupBy("shape").agg(F.sum("weight").alias("seen"))
    total = seen.agg(F.sum("seen")).first()[0] or 0
    bits = seen.select("shape", (-F.log2(F.col("seen") / F.lit(total + 1))).alias("bits"))
    unseen = F.lit(UNSEEN_BITS) * (F.length("shape") + 1) + 8
    costs = shaped.join(bits, "shape", "left").groupBy("field", "dialect", "n_delims").agg((F.sum(F.coalesce("bits", unseen) + ITEM_BITS) + F.first("n_delims") * DELIMITER_BITS).alias("cost"))
    best = costs.groupBy("field").agg(F.min_by("dialect", F.struct(F.round("cost", 6), "n_delims", "dialect")).alias("dialect"))
    chosen = parses.join(best, ["field", "dialect"]).select("field", "dialect", "items")
    said = F.filter("items", lambda x: ~F.lower(x).isin(*NONE_WORDS))
    listed = rows.join(chosen, "field").select("id", F.posexplode(said).alias("pos", "item"))
    return listed.select(F.col("id").alias(id_col), (F.col("pos") + 1).alias("item_pos"), F.col("item").alias(item_col))
