"""Sinks for reports and result tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

#: Reports up to so many rows may also be written as one workbook on the driver.
WORKBOOK_ROWS = 50_000


def save(df: DataFrame, folder: str, name: str, run_id: str | None = None, formats: tuple[str, ...] = ("csv",), partition_by: tuple[str, ...] = ()) -> dict[str, str]:
    """Writes ``df`` below ``folder/name/run_id=...`` in each format and returns the paths.

    csv, parquet, json and orc are written in parallel; xlsx only for reports, as it is built on the driver.
    """
    run_id = run_id or datetime.now().strftime("%Y%m%d_%H%M%S")
    paths = {}
    for kind in formats:
        path = f"{folder.rstrip('/')}/{name}/run_id={run_id}/{kind}"
        if kind == "xlsx":
            rows = df.limit(WORKBOOK_ROWS + 1).toPandas()
            if len(rows) > WORKBOOK_ROWS:
                raise ValueError(f"{name}: more than {WORKBOOK_ROWS} rows for a workbook")
            rows.to_excel(path + ".xlsx", index=False)
            paths[kind] = path + ".xlsx"
            continue
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
        paths[kind] = path
    return paths
