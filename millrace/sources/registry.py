"""Registry of source types: names, aliases, required fields, cleaning and chunk sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMON_REQUIRED = ["title", "published_at"]


@dataclass(frozen=True)
class Source:
    name: str
    group: str = ""
    security: int = 0
    required: list[str] = field(default_factory=list)
    noise: list[str] = field(default_factory=list)
    chunk: int = 500
    table: bool = False
    strip_email: bool = False
    strip_repeat: bool = False
    aliases: list[str] = field(default_factory=list)


#: The source types of the corpus and the patterns of noise in each.
SOURCES = {
    "NEWS": Source("뉴스", "외부", 0, ["org_name"], [r"무단\s*전재.*", r"재배포\s*금지.*", r"저작권자\s*ⓒ.*", r"^관련기사.*", r"^-\s.*", r"\S+@\S+\.\S+", r"^\S+\s기자\s*$"], 500),
    "BROKER": Source("증권사", "외부", 1, ["org_name", "author"], [r"Compliance Notice.*", r"본 자료는 투자 참고용.*", r"당사는 자료 작성일 현재.*", r"투자의견\s*(매수|중립|비중확대).*"], 600, True, False, True),
    "INSTITUTION": Source("기관", "외부", 1, ["org_name"], [r"^목차$", r".*\.{5,}\s*\d+\s*$"], 600, True, False, True),
    "EMAIL": Source("메일", "내부", 2, ["author"], [], 400, False, True),
    "MEETING": Source("회의록", "내부", 2, ["org_name"], [r"^참석\s*:.*", r"^회의명\s*:.*"], 450),
    "REPORT": Source("사내 보고서", "내부", 2, ["org_name", "author"], [r"※\s*본 문서는 사내 한정.*"], 600, True, False, True),
    "EXEC_REPORT": Source("임원 보고서", "내부", 3, ["org_name"], [r"^보고\s*:.*→.*"], 500, True, False, True),
}


def codes() -> list[str]:
    return list(SOURCES)


def required(code: str) -> list[str]:
    """Required fields of a type, the common ones first."""
    return COMMON_REQUIRED + [x for x in (SOURCES[code].required if code in SOURCES else []) if x not in COMMON_REQUIRED]


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a table of fixed size, one row a type."""
    rows = [(c, s.name, s.group, s.security, required(c), s.noise, s.chunk, s.table, s.strip_email, s.strip_repeat) for c, s in SOURCES.items()]
    return spark.createDataFrame(rows, "code string, ko_name string, grp string, security int, required array<string>, noise array<string>, chunk_size int, split_table boolean, strip_email boolean, strip_repeat boolean")


def unmapped(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_type_raw, n_docs, doc_type, status, remedy): every stored type and whether the registry knows it."""
    names = aliases.select(F.col("alias").alias("__a"), F.col("doc_type").alias("__t"))
    counts = raw.groupBy(F.col("doc_type").alias("doc_type_raw")).agg(F.count(F.lit(1)).alias("n_docs"))
    met = counts.withColumn("__a", F.upper(F.trim("doc_type_raw"))).join(F.broadcast(names), "__a", "left")
    known = F.col("__t").isNotNull()
    return met.select("doc_type_raw", "n_docs", F.col("__t").alias("doc_type"), F.when(known, "known").otherwise("unknown").alias("status"), F.when(known, "").otherwise("add an alias or a type").alias("remedy"))
