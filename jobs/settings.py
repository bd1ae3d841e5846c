"""What both command lines share: the config file and the session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def load(job: str, path: str | None = None) -> dict:
    """The job's own settings, overlaid by those of a file on the driver."""
    own = json.loads(Path(__file__).with_name(f"{job}.json").read_text())
    return own | json.loads(Path(path).read_text()) if path else own


def main(job: str, paths: dict[str, str], run: Callable[..., object]) -> None:
    """Parses --config and one option a path, creates the session, runs and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}")
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a JSON file whose entries replace the job's own")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = load(job, given.pop("config"))
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, settings=settings, **given)
    finally:
        spark.stop()
