"""Keys, types and white space, as the data model defines them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of every kind, as a character class that Java, RE2 and (after ``python_class``) Python read alike.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, one by one.
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def doc_key(c: Column | str) -> Column:
    """Outer spaces off, upper case; null stays null. Keys are compared in this form only."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only strings."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.translate(c, SPACES, "") == "")


def type_aliases(source_types: DataFrame) -> DataFrame:
    """(alias, doc_type): each code and each of its aliases in upper case.

    A registry table of fixed size (seven source types), so callers may broadcast it.
    An alias named by two codes goes to the lesser code.
    """
    words = F.concat(F.array("code"), F.split(F.coalesce("aliases", F.lit("")), ";"))
    return (
        source_types.where(F.col("code").isNotNull())
        .select(F.col("code").alias("doc_type"), F.explode(words).alias("word"))
        .select(F.upper(F.trim("word")).alias("alias"), "doc_type")
        .where("alias <> ''")
        .groupBy("alias")
        .agg(F.min("doc_type").alias("doc_type"))
    )


def with_type(raw: DataFrame, source_types: DataFrame, out: str = "type_code") -> DataFrame:
    """``raw`` with the code of its type in ``out``; null where doc_type is null or unknown."""
    names = type_aliases(source_types).select(F.col("alias").alias("__alias"), F.col("doc_type").alias(out))
    keyed = raw.withColumn("__alias", F.upper(F.trim("doc_type")))
    return keyed.join(F.broadcast(names), "__alias", "left").drop("__alias")
