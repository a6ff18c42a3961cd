"""Metric questions over governed tables: routing, rule-made SQL, a guard on the parsed plan, execution and scoring."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import ParseException

MAX_ROWS = 200
#: Words that ask for figures, for explanations, and for what must not be answered.
NUMBER_WORDS = ["얼마", "몇", "수치", "합계", "총", "평균", "최대", "최소", "추이", "증감", "변동", "비중", "점유율", "대비", "전월", "전년", "전분기", "누적", "건수", "금액", "단가", "가격", "물량", "출하", "재고", "매출", "%"]
TEXT_WORDS = ["왜", "이유", "배경", "경위", "동향", "전망", "리스크", "영향", "대응", "평가", "의견", "요약", "정리", "내용"]
BLOCKED_WORDS = ["개인정보", "연봉", "급여"]
PERIOD_WORDS = r"(\d{4}\s*년|\d\s*분기|[1-4]Q|\d{1,2}\s*월|최근|올해|작년|전년|주간|월별|분기별)"


@dataclass(frozen=True)
class Metric:
    id: str
    name: str
    aliases: tuple[str, ...]
    view: str
    expr: str
    filter: str = ""
    unit: str = ""
    period: str = "월"
    period_col: str = "ym"


@dataclass(frozen=True)
class Code:
    kind: str
    code: str
    name: str
    aliases: tuple[str, ...]
    column: str


@dataclass(frozen=True)
class Allowed:
    table: str
    columns: tuple[str, ...] = ("*",)
    use: str = "Y"


@dataclass
class Catalog:
    metrics: list[Metric] = field(default_factory=list)
    codes: list[Code] = field(default_factory=list)
    allow: list[Allowed] = field(default_factory=list)

    def allow_map(self) -> dict[str, set[str] | None]:
        """Table -> allowed columns, None for all; only rows in use. Names are compared in lower case."""
        return {a.table.lower(): None if "*" in a.columns or not a.columns else {c.strip().lower() for c in a.columns} for a in self.allow if a.use.upper() == "Y"}

    def alias_index(self) -> dict[str, tuple[str, str]]:
        """Alias in lower case -> (metric or code, id); a later entry wins."""
        out = {}
        for kind, entries in (("metric", [(m.id, m.name, m.aliases) for m in self.metrics]), ("code", [(c.code, c.name, c.aliases) for c in self.codes])):
            for id_, name, aliases in entries:
                out |= {a.strip().lower(): (kind, id_) for a in (name, *aliases) if a.strip()}
        return out

    def alias_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, k, i) for a, (k, i) in self.alias_index().items()], "alias string, kind string, id string")


#: The sheets of a catalog workbook and their columns, headed in the fourth row.
SHEETS = {
    "metrics": ("지표정의", {"지표ID": "id", "지표명 (업무 용어)": "name", "별칭 (; 구분)": "alias", "대상 뷰 · 테이블": "view", "집계식 (SQL)": "expr", "기본 필터": "filter", "단위": "unit", "기간 단위": "period"}),
    "codes": ("코드값사전", {"구분": "kind", "코드": "code", "표준명": "name", "별칭 (; 구분)": "alias", "사용 컬럼": "column"}),
    "allow": ("allow_list", {"뷰 · 테이블": "table", "허용 컬럼 (; 구분, * 면 전체)": "columns", "사용": "use"}),
}
SHEET_HEADER_ROW = 3


def catalog_of(sheets: dict[str, list[dict]]) -> Catalog:
    """The catalog of rows by standard column name, see ``SHEETS``; lists are split at semicolons, rows without an id, code or table are left out."""
    listed = lambda v: tuple(x.strip() for x in str(v or "").split(";") if x.strip())
    text = lambda r, c, default="": str(r.get(c) or default).strip()
    return Catalog(
        [Metric(text(r, "id"), text(r, "name"), listed(r.get("alias")), text(r, "view"), text(r, "expr"), text(r, "filter"), text(r, "unit"), text(r, "period", "월")) for r in sheets.get("metrics", []) if text(r, "id")],
        [Code(text(r, "kind"), text(r, "code"), text(r, "name"), listed(r.get("alias")), text(r, "column")) for r in sheets.get("codes", []) if text(r, "code")],
        [Allowed(text(r, "table"), listed(r.get("columns")) or ("*",), text(r, "use", "Y")) for r in sheets.get("allow", []) if text(r, "table")],
    )


def read_catalog(path: str) -> Catalog:
    """The catalog of a workbook; a sheet of the workbook is small and is read on the driver."""
    import pandas as pd

    rows = {}
    for key, (sheet, names) in SHEETS.items():
        found = pd.read_excel(path, sheet_name=sheet, header=SHEET_HEADER_ROW, dtype=str, keep_default_na=False).rename(columns=names)
        rows[key] = found[[c for c in names.values() if c in found.columns]].to_dict("records")
    return catalog_of(rows)


def _count(question: Column, words: list[str]) -> Column:
    return sum((F.contains(question, F.lit(w)).cast("int") for w in words), F.lit(0))


def route(questions: DataFrame, catalog: Catalog) -> DataFrame:
    """(qid, route, reason, n_number, n_text, has_metric, has_period) of every question, by the catalog and word lists.

    The catalog is a driver-side configuration, so aliases become one expression and no join is needed.
    """
    q = F.coalesce("question", F.lit(""))
    names = [a for a, (k, _) in catalog.alias_index().items() if k == "metric"]
    hit = F.lit(False)
    for a in names:
        hit = hit | F.contains(F.lower(q), F.lit(a))
    facts = questions.select("qid", _count(q, NUMBER_WORDS).alias("n_number"), _count(q, TEXT_WORDS).alias("n_text"), hit.alias("has_metric"), q.rlike(PERIOD_WORDS).alias("has_period"), (_count(q, BLOCKED_WORDS) > 0).alias("blocked"))
    asks = F.col("has_metric") | ((F.col("n_number") >= 2) & F.col("has_period"))
    to = F.when(F.col("blocked"), "none").when(F.col("has_metric") & (F.col("n_text") >= 1), "hybrid").when(asks, "sql").otherwise("rag")
    why = F.when(F.col("blocked"), "sensitive").when(F.col("has_metric") & (F.col("n_text") >= 1), "metric and explanation").when(asks, "metric or figures").when((F.col("n_text") >= 1) | (F.col("n_number") == 0), "text").otherwise("default")
    return facts.select("qid", to.alias("route"), why.alias("reason"), "n_number", "n_text", "has_metric", "has_period")


def alias_hits(questions: DataFrame, catalog: Catalog) -> DataFrame:
    """(qid, kind, id): catalog entries a question names. The alias table is broadcast, it is the catalog."""
    names = F.broadcast(catalog.alias_table(questions.sparkSession))
    return questions.join(names, F.contains(F.lower(F.coalesce("question", F.lit(""))), F.col("alias"))).select("qid", "kind", "id").distinct()


def period_of(question: Column | str) -> Column:
    """(lo, hi) of the period a question names as yyyymm bounds; null where it names none. A quarter without a year gives none."""
    q = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    group = lambda p, i: F.nullif(F.regexp_extract(q, p, i), F.lit(""))
    quarter, short, month, year = r"(20\d{2})\s*년\s*([1-4])\s*분기", r"([1-4])Q\s*(\d{2})", r"(20\d{2})\s*년\s*(\d{1,2})\s*월", r"(20\d{2})\s*년"
    y = F.coalesce(group(quarter, 1), F.concat(F.lit("20"), group(short, 2)))
    k = F.coalesce(group(quarter, 2), group(short, 1)).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    bounds = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    m = F.concat(group(month, 1), two(group(month, 2).cast("int")))
    return F.when(k.isNotNull(), bounds(F.concat(y, two(k * 3 - 2)), F.concat(y, two(k * 3)))).when(m.isNotNull(), bounds(m, m)).when(group(year, 1).isNotNull(), bounds(F.concat(group(year, 1), F.lit("01")), F.concat(group(year, 1), F.lit("12"))))


def period_filter(question: str, col: str = "ym", weekly: bool = False) -> str:
    """SQL predicate of the period that one question names; weekly columns (yyyyWnn) get week bounds."""
    m = re.search(r"(20\d{2})\s*년\s*([1-4])\s*분기", question)
    year, first, last = None, 1, 12
    if m:
        year, k = int(m[1]), int(m[2])
        first, last = k * 3 - 2, k * 3
    elif m := re.search(r"([1-4])Q\s*(\d{2})", question):
        year, k = 2000 + int(m[2]), int(m[1])
        first, last = k * 3 - 2, k * 3
    elif m := re.search(r"(20\d{2})\s*년\s*(\d{1,2})\s*월", question):
        year, first = int(m[1]), int(m[2])
        last = first
    elif m := re.search(r"(20\d{2})\s*년", question):
        year = int(m[1])
    if year is None:
        return ""
    if weekly:  # weeks that touch the months
        lo, hi = int((first - 1) * 52 / 12) + 1, min(53, int(last * 52 / 12) + 1)
        return f"{col} BETWEEN '{year}W{lo:02d}' AND '{year}W{hi:02d}'"
    return f"{col} BETWEEN '{year}{first:02d}' AND '{year}{last:02d}'"


def make_sql(question: str, catalog: Catalog, limit: int = MAX_ROWS) -> str:
    """The rule-made query of the first metric the question names, '' if it names none. Codes restrict the column the catalog gives them."""
    low = question.lower()
    named = lambda entry: any(a.strip() and a.strip().lower() in low for a in (entry.name, *entry.aliases))
    metric = next((m for m in catalog.metrics if named(m)), None)
    if metric is None:
        return ""
    where = [w for w in (metric.filter, period_filter(question, metric.period_col, metric.period == "주")) if w]
    by_column: dict[str, list[str]] = {}
    for c in catalog.codes:
        if named(c):
            by_column.setdefault(c.column, []).append(c.code)
    where += [f"{column} IN ({', '.join(repr(c) for c in codes)})" for column, codes in by_column.items()]
    return f"SELECT {metric.period_col}, {metric.expr} AS {metric.id} FROM {metric.view}" + (" WHERE " + " AND ".join(where) if where else "") + f" GROUP BY {metric.period_col} ORDER BY {metric.period_col} LIMIT {limit}"


#: Plan roots and inner nodes a query may have; anything else (commands, inserts, drops) is refused.
READ_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "Distinct", "GlobalLimit", "LocalLimit", "UnresolvedWith", "SubqueryAlias", "Join", "Union", "Intersect", "Except", "UnresolvedRelation", "UnresolvedHaving", "OneRowRelation", "UnresolvedSubqueryColumnAliases",
    "WithCTE", "CTERelationDef", "UnresolvedInlineTable", "LateralJoin", "Pivot", "UnresolvedOrderBy", "Offset", "WithWindowDefinition",
}


@dataclass
class Verdict:
    ok: bool
    problems: list[str]
    tables: set[str]


def validate(spark: SparkSession, sql: str, catalog: Catalog) -> Verdict:
    """Static check on the parsed plan: one statement, read-only nodes, allowed tables and columns.

    Tables are found wherever they stand (comma joins, subqueries, common table expressions); names inside string
    literals are no matter. Columns are checked by analysing the query where only allowed columns exist.
    """
    if not (sql or "").strip():
        return Verdict(False, ["no SQL"], set())
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.rstrip().rstrip(";"))
    except ParseException as error:
        return Verdict(False, [f"does not parse: {str(error).splitlines()[0][:120]}"], set())
    kinds, tables, names = set(), set(), set()

    def walk(node) -> None:
        kinds.add(node.nodeName().split(" ")[0].lstrip("'"))
        if node.getClass().getSimpleName() == "UnresolvedRelation":
            tables.add(node.tableName().lower().strip("`"))
        if node.getClass().getSimpleName() == "UnresolvedWith":
            ctes = node.cteRelations()
            for i in range(ctes.size()):
                names.add(ctes.apply(i)._1().lower())
                walk(ctes.apply(i)._2())
        for seq in (node.children(), node.subqueries()):
            for i in range(seq.size()):
                walk(seq.apply(i))
        exprs = node.expressions()
        for i in range(exprs.size()):
            inner(exprs.apply(i))

    def inner(e) -> None:
        if hasattr(e, "plan") and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "UnresolvedExistsSubquery"):
            try:
                walk(e.plan())
            except Exception:  # an expression of that name without a plan
                pass
        kids = e.children()
        for i in range(kids.size()):
            inner(kids.apply(i))

    walk(plan)
    problems = [f"not a query: {k}" for k in sorted(kinds - READ_NODES)]
    allow = catalog.allow_map()
    outside = sorted(t for t in tables - names if t not in allow)
    if outside:
        problems.append("tables not allowed: " + ", ".join(outside))
    if not problems and tables - names:
        problems += _columns(spark, sql, {t: allow[t] for t in tables - names})
    return Verdict(not problems, problems, tables - names)


def _guarded(spark: SparkSession, allow: dict[str, set[str] | None]) -> SparkSession:
    """A session of its own that sees the allowed columns of the allowed tables and no other view."""
    session = spark.newSession()
    rows_of = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, columns in allow.items():
        df = spark.table(name)
        kept = df.select(*(c for c in df.columns if columns is None or c.lower() in columns))
        rows_of(session._jsparkSession, kept._jdf.logicalPlan()).createOrReplaceTempView(name.split(".")[-1])
    return session


def _columns(spark: SparkSession, sql: str, allow: dict[str, set[str] | None]) -> list[str]:
    try:
        _guarded(spark, allow).sql(sql.rstrip().rstrip(";")).schema
    except Exception as error:
        return [f"columns not allowed or unknown: {str(error).splitlines()[0][:160]}"]
    return []


def run_sql(spark: SparkSession, sql: str, catalog: Catalog, limit: int = MAX_ROWS) -> DataFrame:
    """The result of a query that the guard lets pass, at most ``limit`` rows; else an error that names the problems.

    It runs in the guarded session, so a star too reaches the allowed columns only.
    """
    verdict = validate(spark, sql, catalog)
    if not verdict.ok:
        raise PermissionError("; ".join(verdict.problems))
    allow = catalog.allow_map()
    return _guarded(spark, {t: allow[t] for t in verdict.tables if t in allow}).sql(sql.rstrip().rstrip(";")).limit(limit)


def explain(spark: SparkSession, sql: str) -> tuple[bool, str]:
    """Dry run: whether the query analyses, and why not."""
    try:
        spark.sql(sql.rstrip().rstrip(";")).schema
        return True, ""
    except Exception as error:
        return False, f"{type(error).__name__}: {str(error).splitlines()[0]}"


def _normal(df: DataFrame, digits: int) -> DataFrame:
    """Columns by position, numbers rounded, all as trimmed strings."""
    cols = [F.trim(F.coalesce((F.format_string(f"%.{digits}f", F.round(F.col(f"`{n}`").cast("double"), digits)) if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") else F.col(f"`{n}`").cast("string")), F.lit("(null)"))).alias(f"c{i}") for i, (n, t) in enumerate(df.dtypes)]
    return df.select(*cols)


def exec_match(pred: DataFrame | None, gold: DataFrame | None, digits: int = 2, strict: bool = False) -> bool:
    """Whether two results hold the same rows; names do not count, order of columns does; two empty results do not match.

    As sets by default; ``strict`` compares how often each row stands.
    """
    if pred is None or gold is None or len(pred.columns) != len(gold.columns):
        return False
    a, b = _normal(pred, digits), _normal(gold, digits)
    if not strict:
        a, b = a.distinct(), b.distinct()
    if a.isEmpty() or b.isEmpty():
        return False
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def schema_prompt(spark: SparkSession, catalog: Catalog) -> str:
    """What a model is told: allowed tables with columns, metrics and codes."""
    tables = [f"- {t}: {'; '.join(sorted(c) if c else spark.table(t).columns)}" for t, c in catalog.allow_map().items()]
    metrics = [f"- {m.name}({';'.join(m.aliases)}) = {m.expr} FROM {m.view}{' WHERE ' + m.filter if m.filter else ''} [{m.unit}]" for m in catalog.metrics]
    codes = [f"- {c.kind} {c.name}({';'.join(c.aliases)}) = {c.column} {c.code}" for c in catalog.codes]
    return "[views]\n" + "\n".join(tables) + "\n\n[metrics]\n" + "\n".join(metrics) + "\n\n[codes]\n" + "\n".join(codes)


def result_table(df: DataFrame, label: str = "", rows: int = 20) -> str:
    """The first rows of a result as a labelled Markdown table."""
    found = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in found)]
    return f"[{label}]\n" + "\n".join(lines)


def hybrid_context(df: DataFrame, label: str, texts: list[str]) -> str:
    """A metric result and the first three text chunks as one context."""
    return "\n\n".join([result_table(df, label), *(f"[{i}]\n{t}" for i, t in enumerate(texts[:3], 1))])


def make_sql_with(question: str, catalog: Catalog, spark: SparkSession, ask: Callable[[str], str] | None = None, prompt: str | None = None) -> tuple[str, str]:
    """(sql, how): by rule where a rule gives one, else by the model ``ask``, whose fences are taken off; ("", "none") without either.

    ``prompt`` holds {schema} and {question}. What a model writes must pass ``validate`` like any other query.
    """
    made = make_sql(question, catalog)
    if made:
        return made, "rule"
    if ask is None:
        return "", "none"
    from millrace.sources.services import SQL_PROMPT

    filled = (prompt or SQL_PROMPT).replace("{schema}", schema_prompt(spark, catalog)).replace("{question}", question)
    try:
        reply = str(ask(filled) or "")
    except Exception:
        reply = ""
    sql = re.sub(r"(?m)^```(?:sql)?|```$", "", reply.strip()).strip()
    return (sql, "model") if sql else ("", "none")


def sql_scores(spark: SparkSession, cases: list[tuple[str, str, str]], catalog: Catalog, ask: Callable[[str], str] | None = None) -> DataFrame:
    """One row: questions, share of valid SQL among those that should have SQL, share of these whose result is that of the given query.

    ``cases``: (question, wanted route, wanted SQL or blank), a set that people wrote. A query that fails counts as wrong.
    """
    valid, exact = [], []
    for question, _, gold in cases:
        if not gold.strip():
            continue
        made, _ = make_sql_with(question, catalog, spark, ask)
        valid.append(bool(made) and validate(spark, made, catalog).ok)
        try:
            exact.append(valid[-1] and exec_match(run_sql(spark, made, catalog), spark.sql(gold)))
        except Exception:
            exact.append(False)
    asked = spark.createDataFrame([(q, w) for q, w, _ in cases], "question string, wanted string").withColumn("qid", F.monotonically_increasing_id().cast("string"))
    routed = route(asked, catalog).join(asked.select("qid", "wanted"), "qid").agg(F.round(F.avg((F.col("route") == F.col("wanted")).cast("double")), 3).alias("r")).first().r
    share = lambda xs: round(sum(xs) / len(xs), 3) if xs else None
    return spark.createDataFrame([(len(cases), routed, share(valid), share(exact))], "n_questions bigint, routing_accuracy double, valid_sql double, execution_accuracy double")
