"""Texts cut off before their passage ends, found as strict prefixes of longer copies.

Only the last line of a text can be cut. It is compared with the lines of reference texts in a self-join by prefix:

1. A line that stands whole among the lines of its own document is complete.
2. One that is a strict prefix of a line of its own document is cut. Lines meet by hashed prefixes of fixed lengths
   (1, 2, 4, 8, ...): a cut line looks itself up under the longest of these lengths it has, so even one hot document
   splits into many groups.
3. What its own document does not settle (the document is gone, changed or never collected) is compared with all lines
   of the corpus: a line found whole is complete. Else prose is complete when it ends a sentence, a table row when it has
   its closing bar, and any other line when whole lines of several documents end in the same words.

A mark of omission at the end (three dots, an ellipsis, a bracketed note) is taken off before the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import SPACES, doc_key, with_type
from millrace.session import cut

#: Fixed lengths of the hashed prefixes.
PREFIXES = [1, 2, 4, 8, 16, 32, 64, 128, 256]
#: Marks that a cutting system leaves at the end.
OMISSION = r"(?:\.{2,}|…+|\x{FFFD}+|[\[(<](?:생략|중략|이하 생략|truncated|cut|more|snip|계속)[\])>])$"
#: A sentence that ends; a full stop after a digit may be a decimal point.
SENTENCE_END = r"""(?:[^\d.…][.]|[!?。！？])["'”’)\]]*$"""
#: Prose: a sentence ends within the line, so the line must end with one.
PROSE = r"[^\d.…|][.!?] "
#: Lines of more words are known by their last two.
SHORT_WORDS = 4
#: Whole lines of at least so many documents must end in a word before it counts as an ending.
ENDING_DOCS = 2


def tidy(c: Column) -> Column:
    """Runs of white space as one space, outer ones off."""
    return F.trim(F.regexp_replace(F.translate(c, SPACES, " " * len(SPACES)), " {2,}", " "))


def _ending(line: Column) -> Column:
    """How a line ends: its last word, or its last two if it is long or ends in a number; digit runs as 9, mail boxes off."""
    words = F.split(line, " ")
    last = F.element_at(words, -1)
    two = (F.size(words) > SHORT_WORDS) | last.rlike("^[0-9.,%]+$")
    end = F.concat_ws(" ", F.slice(words, -F.least(F.size(words), F.when(two, 2).otherwise(1)), 2))
    return F.regexp_replace(F.regexp_replace(end, r"[^ @]+@", "@"), "[0-9]+", "9")


def _lines(docs: DataFrame) -> DataFrame:
    """(key, line) of every non-blank line of the reference bodies, tidy."""
    one_space = F.regexp_replace("body", r"[\t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+| {2,}", " ")
    lines = docs.select(doc_key("doc_id").alias("key"), F.explode(F.split(one_space, "\n")).alias("line"))
    return lines.select("key", F.trim(F.regexp_replace("line", " {2,}", " ")).alias("line")).where("line <> ''")


def truncated(chunks: DataFrame, raw: DataFrame) -> DataFrame:
    """(chunk_id) of every chunk whose text stops before its passage does, each once.

    ``chunks`` needs chunk_id, doc_id and text, ``raw`` doc_id and body; other columns are not read. Null and blank
    texts are never truncated. Equal chunks of one id are one; without ``raw`` only endings decide.
    """
    rows = chunks.select("chunk_id", doc_key("doc_id").alias("key"), F.rtrim("text", F.lit(SPACES)).alias("text")).where("text <> ''")
    tail = tidy(F.substring_index("text", "\n", -1))
    marked = rows.select("chunk_id", F.coalesce("key", F.lit("")).alias("key"), tail.alias("shown")).withColumn("line", F.rtrim(F.regexp_replace("shown", OMISSION, "")))
    cand = marked.select("chunk_id", "key", "line", "shown", (F.col("line") != F.col("shown")).alias("marked"))

    # reference lines, and the chunks that stay open after step 1, are read several times, so each is made once
    lines = cut(_lines(raw), "lines")
    # 1: whole lines of the own document, by one print of key and line, which spreads a hot document's lines
    known = lines.select(F.xxhash64(F.coalesce("key", F.lit("")), "line").alias("own")).distinct()
    open1 = cut(cand.withColumn("own", F.xxhash64("key", "shown")).join(known, "own", "left_anti").drop("own"), "open-lines").withColumn("whole", F.xxhash64("shown"))

    # 2: strict prefixes of lines of the own document; only documents that still have open chunks send lines
    # ended sentences are cut only where a longer own line shows it
    wanted = open1.where("key <> ''").select("key").distinct()
    longer = lines.where("key is not null").select("key", "line").join(wanted, "key", "left_semi").distinct()
    sizes = F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length("line"))
    # equal lines of one document are looked up once
    probes = open1.where("line <> '' and key <> ''").select("key", "line").distinct().select("key", "line", F.array_max(sizes).alias("n"))
    probes = probes.select("*", F.xxhash64("n", F.substring(F.col("line"), F.lit(1), F.col("n"))).alias("p"))
    stored = longer.select("key", F.col("line").alias("long"), F.explode(F.transform(sizes, lambda n: F.xxhash64(n, F.substring(F.col("line"), F.lit(1), n)))).alias("p"))
    met = probes.join(stored, ["key", "p"]).where("length(long) > length(line) and startswith(long, line)").select("key", "line").distinct()
    own_cut = cut(open1.join(met, ["key", "line"], "left_semi").select("chunk_id").distinct(), "own-cut")

    # 3: what is left, against the corpus
    rest = open1.join(own_cut, "chunk_id", "left_anti")
    unended = rest.where(F.col("marked") | (F.col("line") == "") | ~F.col("line").rlike(SENTENCE_END))
    asked = unended.where("not marked").select("whole").distinct()
    anywhere = lines.select(F.xxhash64("line").alias("whole")).join(asked, "whole", "left_semi").distinct()
    left = cut(unended.join(anywhere, "whole", "left_anti").select("chunk_id", "line", "marked"), "unsettled")
    # a table row is whole with its closing bar, prose never without a full stop; one after a digit is left to the endings
    row, prose = F.col("line").startswith("|"), F.col("line").rlike(PROSE) & ~F.col("line").rlike("[0-9][.]$")
    sure = left.where(F.col("marked") | prose | (row & ~F.col("line").endswith("|")))
    open3 = left.where(~(F.col("marked") | prose | row))
    asked_ends = open3.select(_ending(F.col("line")).alias("ending")).distinct()
    endings = (
        lines.select(_ending(F.col("line")).alias("ending"), F.xxhash64("key").alias("k"))
        .join(asked_ends, "ending", "left_semi")
        .distinct()
        .groupBy("ending")
        .agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= ENDING_DOCS)
        .select("ending")
    )
    open4 = open3.withColumn("ending", _ending(F.col("line"))).join(endings.withColumn("usual", F.lit(True)), "ending", "left")
    corpus_cut = open4.where("usual is null").select("chunk_id").unionByName(sure.select("chunk_id"))
    return own_cut.unionByName(corpus_cut).distinct()


def rates(chunks: DataFrame, raw: DataFrame, source_types: DataFrame) -> DataFrame:
    """(doc_type, n_chunks, n_truncated, share): how often each type of record has its chunks cut.

    A chunk's type is the least type of the raw rows with its key; chunks without such a row count under null.
    """
    types = with_type(raw.select("doc_id", "doc_type"), source_types).select(doc_key("doc_id").alias("key"), "type_code").where("key is not null").groupBy("key").agg(F.min("type_code").alias("doc_type"))
    ids = chunks.select("chunk_id", doc_key("doc_id").alias("key")).groupBy("chunk_id").agg(F.min("key").alias("key"))
    marked = ids.join(truncated(chunks, raw).withColumn("cut", F.lit(1)), "chunk_id", "left")
    # counted per key first, with a map-side combine, so a hot document is one row of the join
    counts = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cut", F.lit(0))).alias("c"))
    by_type = counts.join(types, "key", "left").groupBy("doc_type").agg(F.sum("n").alias("n_chunks"), F.sum("c").alias("n_truncated"))
    return by_type.withColumn("share", F.round(F.col("n_truncated") / F.col("n_chunks"), 6))
