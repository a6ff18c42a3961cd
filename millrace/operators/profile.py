"""Column profiles derived from maintained value counts.

The state is one table of value counts, ``(load_no, col_name, value, flags, n)``. A load, or its retraction, is a table
of signed deltas of the same shape; applying deltas adds counts and drops what falls to zero. Every figure, entropy
included, is derived from the counts, never from the rows. ``ValueCounts`` keeps the table on disk; ``maintain`` applies
the delta of each load that is new or has changed and leaves the others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.keys import is_blank
from millrace.operators.counts import CountStore, added_up

#: Bits of ``flags``: what a value's row says beyond the value itself.
MISSING, OUT_OF_RANGE, HAS_BOTH, STALE = 1, 2, 4, 8
KEYS = ["load_no", "col_name", "value", "flags"]
#: Columns whose values are times.
DATES = ("published_at", "collected_at")
EARLIEST = "2000-01-01 00:00:00"
STALE_AFTER = "INTERVAL 30 DAYS"
TITLE_SHORTEST, TITLE_LONGEST = 8, 90
#: Any character that a title should not hold.
TITLE_ILL = r"""[^가-힣A-Za-z0-9 .,:%()\[\]/+\-'"?!·…]"""
THRESHOLD = 0.2
_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _bit(cond: Column, bit: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), bit).otherwise(0)


def load_deltas(raw: DataFrame, loads: DataFrame, sign: int = 1) -> DataFrame:
    """Signed value-count deltas of the rows of ``raw``; ``sign=-1`` retracts them.

    Rows without load_no belong to no load and give none. Null values count as missing, for titles blank ones too.
    Extra columns of either table are ignored. An empty ``raw`` gives an empty table.
    """
    spans = loads.where("load_no is not null").groupBy("load_no").agg(F.min("started_at").alias("__from"), F.max("finished_at").alias("__to"))
    rows = raw.select("load_no", "published_at", "collected_at", "title").where("load_no is not null").join(spans, "load_no", "left")
    published, collected = F.col("published_at"), F.col("collected_at")
    both = published.isNotNull() & collected.isNotNull()
    entries = {
        "published_at": (
            F.date_format(published, _MICROS),
            _bit(published.isNull(), MISSING)
            + _bit((published < F.lit(EARLIEST).cast("timestamp_ntz")) | (published > collected), OUT_OF_RANGE)
            + _bit(both, HAS_BOTH)
            + _bit(published < collected - F.expr(STALE_AFTER), STALE),
        ),
        "collected_at": (
            F.date_format(collected, _MICROS),
            _bit(collected.isNull(), MISSING) + _bit((collected < F.col("__from")) | (collected > F.col("__to")), OUT_OF_RANGE),
        ),
        "title": (F.col("title"), _bit(is_blank("title"), MISSING)),
    }
    packed = F.array(*(F.struct(F.lit(name).alias("col_name"), value.alias("value"), flags.alias("flags")) for name, (value, flags) in entries.items()))
    return (
        rows.select("load_no", F.explode(packed).alias("e"))
        .select("load_no", "e.*")
        .groupBy(*KEYS)
        .agg((F.count(F.lit(1)) * sign).alias("n"))
    )


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The value counts after the deltas: counts add up, zero counts leave the table."""
    return added_up(KEYS, *([state] if state is not None else []), *deltas)


COUNTS = "load_no bigint, col_name string, value string, flags int, n bigint"


class ValueCounts(CountStore):
    """The value-count table of a raw table, kept on disk."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, COUNTS)

    def maintain(self, raw: DataFrame, loads: DataFrame) -> DataFrame:
        """The state after the deltas of every load that is new or differs from what was applied; a changed or vanished load is retracted first.

        A load is known by the print of its rows and its span. Loads that stand in the state as they are cost one scan
        of the profiled columns.
        """
        ledger = self.ledger()
        changes = self.stale(load_prints(raw, loads).select(F.col("load_no").cast("string").alias("part"), "print"), ledger)
        if changes:
            changed = F.broadcast(self.spark.createDataFrame([(int(p),) for p, _, _ in changes], "load_no bigint"))  # one row a load
            deltas = [load_deltas(raw.join(changed, "load_no", "left_semi"), loads)]
            if any(former is not None for _, _, former in changes):
                deltas.append(self.state(ledger).join(changed, "load_no", "left_semi").withColumn("n", -F.col("n")))
            return self.apply(*deltas, prints=[(p, now) for p, now, _ in changes], ledger=ledger)
        return self.state(ledger)


def load_prints(raw: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_no, print): rows, hashes and span of each load that has rows; equal prints mean equal deltas."""
    spans = loads.where("load_no is not null").groupBy("load_no").agg(F.min("started_at").alias("__from"), F.max("finished_at").alias("__to"))
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "published_at", "collected_at", "title").cast("decimal(20,0)")).cast("string")
    rows = raw.where("load_no is not null").groupBy("load_no").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), h(1), h(2)).alias("p"))
    return rows.join(spans, "load_no", "left").select(F.col("load_no").cast("long").alias("load_no"), F.concat_ws("/", "p", F.coalesce(F.col("__from").cast("string"), F.lit("-")), F.coalesce(F.col("__to").cast("string"), F.lit("-"))).alias("print"))


def _per_value(counts: DataFrame) -> DataFrame:
    """One row per (load, column, value) with its count and the counts that carry each flag."""
    has = lambda bit: F.sum(F.when(F.col("flags").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return counts.groupBy("load_no", "col_name", "value").agg(
        F.sum("n").alias("n"), has(MISSING).alias("n_missing"), has(OUT_OF_RANGE).alias("n_out"), has(HAS_BOTH).alias("n_both"), has(STALE).alias("n_stale")
    )


def profile(counts: DataFrame) -> DataFrame:
    """(load_no, col_name) with rows, missing values, distinct values, least and greatest value and entropy in bits."""
    present = F.col("n_missing") == 0
    n = F.when(present, F.col("n"))
    out = _per_value(counts).groupBy("load_no", "col_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.count(F.when(present, F.col("value"))).alias("n_distinct"),
        F.sum(F.coalesce(n, F.lit(0))).alias("n_values"),
        F.min(F.when(present, F.col("value"))).alias("min_value"),
        F.max(F.when(present, F.col("value"))).alias("max_value"),
        F.sum(n * F.log2(n)).alias("__nlogn"),
    )
    bits = F.when(F.col("n_values") > 0, F.log2(F.col("n_values").cast("double")) - F.col("__nlogn") / F.col("n_values")).otherwise(0.0)
    return out.withColumn("entropy_bits", F.round(F.greatest(bits, F.lit(0.0)), 6)).drop("__nlogn")


def drift(counts: DataFrame, buckets: Column | None = None) -> DataFrame:
    """(load_no, col_name, distance): total variation between the value shapes of a load and of the load before it.

    The shape of a date is its day, that of any other value its whole text with digit runs as 9, so moves within a day
    and moves of numbers alone give 0. Loads are ordered by number; the first load of a column has no predecessor and
    gives a null distance.
    """
    text = F.when(F.col("col_name").isin(*DATES), F.substring("value", 1, 10)).otherwise(F.regexp_replace("value", "[0-9]+", "9"))
    shape = F.coalesce(text, F.lit("(none)")) if buckets is None else buckets
    by_shape = counts.withColumn("shape", shape).groupBy("load_no", "col_name", "shape").agg(F.sum("n").alias("n"))
    totals = by_shape.groupBy("load_no", "col_name").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("col_name").orderBy("load_no")
    pairs = totals.select("load_no", "col_name", "total", F.lag("load_no").over(before).alias("prev_no"))
    share = by_shape.join(totals, ["load_no", "col_name"]).select("load_no", "col_name", "shape", (F.col("n") / F.col("total")).alias("share"))
    ours = pairs.join(share, ["load_no", "col_name"]).select("load_no", "col_name", "shape", F.col("share").alias("d"))
    prev = pairs.where("prev_no is not null").select(F.col("prev_no").alias("p"), "col_name", F.col("load_no").alias("q"))
    theirs = share.withColumnRenamed("load_no", "p").join(prev, ["p", "col_name"]).select(F.col("q").alias("load_no"), "col_name", "shape", (-F.col("share")).alias("d"))
    moved = ours.unionByName(theirs).groupBy("load_no", "col_name", "shape").agg(F.sum("d").alias("d"))
    dist = moved.groupBy("load_no", "col_name").agg(F.round(F.sum(F.abs("d")) / 2, 6).alias("tv"))
    return pairs.join(dist, ["load_no", "col_name"], "left").select("load_no", "col_name", F.when(F.col("prev_no").isNotNull(), F.col("tv")).alias("distance"))


def shares(counts: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_no, col_name, check_name, share) of every check for every load of ``loads``; no rows give share 0."""
    value, n = F.col("value"), F.col("n")
    present = F.col("n_missing") == 0
    some = lambda cond: F.sum(F.when(present & cond, n).otherwise(0))
    facts = _per_value(counts).groupBy("load_no", "col_name").agg(
        F.sum("n").alias("rows"),
        F.sum("n_missing").alias("missing"),
        F.sum(F.when(present, n).otherwise(0)).alias("vals"),
        F.count(F.when(present, value)).alias("dist"),
        F.sum("n_out").alias("out"),
        F.sum("n_both").alias("both"),
        F.sum("n_stale").alias("stale"),
        some((F.length("value") < TITLE_SHORTEST) | (F.length("value") > TITLE_LONGEST)).alias("ill_length"),
        some(value.rlike(TITLE_ILL)).alias("ill_chars"),
        some(F.substring("value", 12, 15) == "00:00:00.000000").alias("midnight"),
        some(F.substring("value", 15, 12) == "00:00.000000").alias("on_hour"),
    )
    wanted = {
        "published_at": {"missing": ("missing", "rows"), "distinct": ("dist", "vals"), "out_of_range": ("out", "vals"), "midnight": ("midnight", "vals"), "stale": ("stale", "both")},
        "collected_at": {"missing": ("missing", "rows"), "distinct": ("dist", "vals"), "out_of_range": ("out", "vals"), "on_hour": ("on_hour", "vals")},
        "title": {"missing": ("missing", "rows"), "distinct": ("dist", "vals"), "length": ("ill_length", "vals"), "charset": ("ill_chars", "vals")},
    }
    share = lambda top, base: F.when(F.col(base) > 0, F.col(top) / F.col(base)).otherwise(0.0)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("check_col"), F.lit(k).alias("check_name"), share(*v).alias("share")) for c, ks in wanted.items() for k, v in ks.items())))
    measured = facts.select("load_no", "col_name", rows.alias("s")).where("s.check_col = col_name").select("load_no", "col_name", "s.check_name", "s.share")
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("col_name"), F.lit(k).alias("check_name")) for c, ks in wanted.items() for k in ks)))
    grid = loads.where("load_no is not null").select("load_no").distinct().select("load_no", names.alias("g")).select("load_no", "g.*")
    return grid.join(measured, ["load_no", "col_name", "check_name"], "left").na.fill(0.0, ["share"])


def departures(counts: DataFrame, loads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Checks of a load whose share lies more than ``threshold`` from the median share of that check over all loads."""
    of = shares(counts, loads)
    middle = of.groupBy("col_name", "check_name").agg(F.percentile("share", F.lit(0.5)).alias("middle"))
    far = F.round(F.abs(F.col("share") - F.col("middle")), 6) > threshold
    return of.join(middle, ["col_name", "check_name"]).where(far).select("load_no", "col_name", "check_name")
