"""Table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests, a laptop) a temporary folder stands in where the session names none; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept_dir(spark: SparkSession, name: str, of: str) -> str:
    """The folder of a table that outlives the application: ``name`` for the data ``of``."""
    return f"{shared_dir(spark)}/{name}/{hashlib.md5(of.rstrip('/').encode(), usedforsecurity=False).hexdigest()}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, survives lost executors.

    The tables of an application lie in one folder, which ``clean`` removes; it also runs when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"
    _made.add(path.rsplit("/", 1)[0])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clean() -> None:
    """Removes the cut tables of this driver's applications, where the shared folder is mounted here; object stores expire them by rule."""
    while _made:
        path = _made.pop().removeprefix("file://").removeprefix("file:")
        if path.startswith("/"):
            shutil.rmtree(path, ignore_errors=True)
