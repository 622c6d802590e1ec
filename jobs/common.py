"""What the jobs share: their config files, sessions and logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"loomquest.jobs.{name}")


def settings(name: str, file: str | None = None) -> dict:
    """The job's own config file, with what file, another one, states instead. Names that the job does not know are refused."""
    known = json.loads((HERE / f"{name}.json").read_text(encoding="utf-8"))
    given = json.loads(Path(file).read_text(encoding="utf-8")) if file else {}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | given


def main(name: str, doc: str, inputs: dict[str, str], run: Callable, argv: list[str] | None = None) -> None:
    """The command line of a job: --out, --config and a path for each input. Starts a session, runs the job in it and stops it."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for k, what in inputs.items():
        p.add_argument(f"--{k}", required=True, help=what)
    p.add_argument("--out", required=True, help="folder of the output")
    p.add_argument("--config", help="JSON file with settings that differ")
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **{k: a[k] for k in inputs}, out=a["out"], config=settings(name, a["config"]))
    finally:
        spark.stop()
