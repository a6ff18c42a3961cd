"""Tables of signed counts, kept on disk and maintained by deltas."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LEDGER = "generation int, seq bigint, batch string, part string, print string"
#: Batches of deltas that are added up when the state is read; beyond so many they are merged into one.
MOST_BATCHES = 32


def added_up(keys: list[str], *deltas: DataFrame) -> DataFrame:
    """One row per key with the sum of its counts ``n``; what falls to zero leaves the table."""
    return reduce(DataFrame.unionByName, deltas).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


class CountStore:
    """A table of counts on disk: batches of signed deltas, and a ledger of the batches that are complete.

    ``path``/batch-* holds the counts of one batch of deltas. A batch belongs to the state once it stands in the ledger, an
    append-only table that is written after the counts, so a batch that was cut short is never read. A batch whose name
    the ledger has is not applied again, so replays change nothing. Any number of objects may be opened on one folder one
    after another; each reads the ledger when it is asked. Writers must not run at once. ``compact`` merges the batches
    into one, which opens the next generation of the ledger. The ledger has one row a batch and one a part of the source
    (a load, a table) in it, so the driver holds it. ``schema`` names the key columns and, last, ``n bigint``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = [tuple(c.split()) for c in schema.split(", ")]
        self.keys = [c for c, _ in self.columns if c != "n"]

    def ledger(self) -> list[Row]:
        """The rows of the last generation in order: what was applied; part and print are null for a batch as a whole."""
        try:
            rows = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = max(r.generation for r in rows)
        return sorted((r for r in rows if r.generation == last), key=lambda r: r.seq)

    def _enter(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def batches(self, ledger: list[Row] | None = None) -> list[str]:
        """Names of the batches whose sum is the state; ``compact`` keeps them few."""
        return list(dict.fromkeys(r.batch for r in (self.ledger() if ledger is None else ledger) if r.seq > 0))

    def read(self, ledger: list[Row] | None = None) -> DataFrame | None:
        """The state, None before anything was applied."""
        names = self.batches(ledger)
        if not names:
            return None
        stored = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/batch-{b}" for b in names))
        return stored if len(names) == 1 else added_up(self.keys, stored)  # one batch is added up already

    def state(self, ledger: list[Row] | None = None) -> DataFrame:
        """The state, an empty table before anything was applied."""
        found = self.read(ledger)
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def apply(self, *deltas: DataFrame, batch: str | None = None, prints: list[tuple[str, str | None]] = (), ledger: list[Row] | None = None) -> DataFrame:
        """Adds the deltas and returns the state. ``batch`` names them, so that applying them again does nothing.

        ``prints``: (part, print) of the parts of the source that the deltas bring up to date.
        """
        name = batch or uuid.uuid4().hex
        entries = self.ledger() if ledger is None else ledger
        if all(r.batch != name for r in entries):
            if len(self.batches(entries)) >= MOST_BATCHES:
                self.compact()
                entries = self.ledger()
            counts = added_up(self.keys, *(d.select(*self.keys, "n") for d in deltas))
            counts.select(*(F.col(c).cast(t).alias(c) for c, t in self.columns)).write.mode("overwrite").parquet(f"{self.path}/batch-{name}")
            generation, seq = (entries[-1].generation, entries[-1].seq + 1) if entries else (0, 1)
            rows = [Row(generation=generation, seq=seq, batch=name, part=p, print=x) for p, x in [(None, None), *prints]]
            self._enter(rows)
            entries = [*entries, *rows]
        return self.read(entries)

    def compact(self) -> None:
        """Merges all batches into one; the former ones are read until the next generation of the ledger stands."""
        entries = self.ledger()
        state = self.read(entries)
        if state is None:
            return
        name, generation = uuid.uuid4().hex, entries[-1].generation + 1
        state.write.parquet(f"{self.path}/batch-{name}")
        # merged batches stay in the ledger as 0, so that they are not applied again
        merged = [(generation, 0, b, None, None) for b in dict.fromkeys(r.batch for r in entries)]
        self._enter([*merged, (generation, 1, name, None, None), *((generation, 1, name, p, x) for p, x in self.parts(entries).items())])

    def parts(self, ledger: list[Row]) -> dict[str, str | None]:
        """The parts of the source in the state and their prints, as last applied."""
        return {r.part: r.print for r in ledger if r.part is not None}

    def stale(self, prints: DataFrame, ledger: list[Row]) -> list[tuple[str, str | None, str | None]]:
        """(part, print now, print applied) of the parts, as few as a source has loads or tables, that are not in the state as they are."""
        now, known = {r.part: r.print for r in prints.select("part", "print").collect()}, self.parts(ledger)
        return [(p, now.get(p), known.get(p)) for p in sorted({*now, *known}) if now.get(p) != known.get(p)]
