"""What the jobs share: configuration, logging, and reading tables that may not be there yet.  All paths go through Spark and may be remote."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path with a fixed schema; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def made(spark: SparkSession, path: str, schema: str, *partitions: str) -> None:
    """An empty table at a path where there is nothing."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(path)


def named(column: str, missing: str = "unknown") -> F.Column:
    """A value that can name a partition: null and blank ones read back as they were written."""
    return F.coalesce(F.when(F.trim(column) != "", F.col(column)), F.lit(missing))


def read_config(spark: SparkSession, path: str) -> dict:
    found = spark.read.json(path, multiLine=True).first()
    return {} if found is None else found.asDict(recursive=True)


def command_line(name: str, paths: Sequence[str], run: Callable[..., DataFrame], argv: Sequence[str] | None = None) -> None:
    """``--config FILE`` and a flag for each path, which goes before the file's; makes a session, runs, and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    parser.add_argument("--config", help="a JSON file with paths and settings")
    for path in paths:
        parser.add_argument(f"--{path}")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = read_config(spark, given["config"]) if given["config"] else {}
        config |= {k: given[k] for k in paths if given[k]}
        missing = [k for k in paths if not config.get(k)]
        if missing:
            parser.error(f"no path for {', '.join(missing)}")
        run(spark, **config)
    finally:
        spark.stop()
