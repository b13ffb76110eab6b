"""What the command lines of the jobs share: arguments, the session, the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import session

log = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str) -> dict:
    """A config file: one JSON object, read by Spark, so the path may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def command(about: str, run: Callable[..., DataFrame], paths: dict[str, str], argv: list[str] | None = None) -> None:
    """Run a job from the command line. paths: its path arguments, with what they are."""
    p = argparse.ArgumentParser(description=about)
    for name, what in paths.items():
        p.add_argument(f"--{name}", required=True, help=what)
    p.add_argument("--config", required=True, help="a JSON file of the job's settings")
    p.add_argument("--master", help="Spark master; none where spark-submit gives it")
    args = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("jobs").setLevel(logging.INFO)
    logging.getLogger("gridloom").setLevel(logging.INFO)
    spark = session(args["master"])
    try:
        run(spark, *(args[name] for name in paths), configured(spark, args["config"]))
    finally:
        spark.stop()
