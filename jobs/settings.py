"""Settings of a job: a JSON file, and what the command line says over it."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

Settings = dict[str, Any]


def read(path: str, known: Settings) -> Settings:
    """``known`` with what the file says; a name that is not known is an error."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    strange = sorted(set(said) - set(known))
    if strange:
        raise ValueError(f"{path}: unknown settings {', '.join(strange)}")
    return known | said


def command_line(doc: str, known: Settings, run: Callable[[SparkSession, Settings], Any], argv: list[str] | None = None) -> int:
    """Run a job in a session of its own: ``--config FILE``, and ``--NAME VALUE`` for any setting."""
    parser = argparse.ArgumentParser(description=doc.split("\n\n")[0])
    parser.add_argument("--config", help="a JSON file of settings")
    for name, value in known.items():
        parser.add_argument(f"--{name}", type=type(value), default=None)
    given = vars(parser.parse_args(argv))
    config = given.pop("config")
    settings = read(config, known) if config else dict(known)
    settings |= {k: v for k, v in given.items() if v is not None}
    missing = [k for k, v in settings.items() if v == ""]
    if missing:
        parser.error(f"no value for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, settings)
    finally:
        spark.stop()
    return 0
