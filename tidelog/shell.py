"""Commands: ``python -m tidelog.shell [--data FOLDER] [-e SQL]`` runs SQL and prints tab-separated rows without a header;
``python -m tidelog.shell verify --root FOLDER`` writes to timelines, reads back and reports what does not hold."""

from __future__ import annotations

import argparse
import sys
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidOptions
from .functions import rendered

OPTIONS = {"data", "master"}
QUIT = {"quit", "exit", "\\q"}


def lines(rows: DataFrame):
    """Each row as text, formatted on the executors and fetched piece by piece."""
    text = rows.select(F.concat_ws("\t", *[rendered(F.col(f"`{c}`"), t) for c, t in rows.dtypes]).alias("line"))
    return (r["line"] for r in text.toLocalIterator())


def load_options(path: str | None) -> dict:
    if path is None:
        return {}
    options = tomllib.loads(Path(path).read_text())
    if unknown := set(options) - OPTIONS:
        raise InvalidOptions(f"unknown options: {', '.join(sorted(unknown))}")
    return options


def register(spark: SparkSession, folder: str) -> None:
    """Every Parquet table of a folder as a view."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
        name = s.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(s.getPath().toString()).createOrReplaceTempView(name.removesuffix(".parquet"))


def session(options: dict) -> SparkSession:
    return SparkSession.builder.master(options.get("master", "local[*]")).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["verify"]:
        from .verify import main as verify

        return verify(argv[1:])
    parser = argparse.ArgumentParser(prog="tidelog.shell")
    parser.add_argument("--config")
    parser.add_argument("--data")
    parser.add_argument("-e", "--execute")
    args = parser.parse_args(argv)
    options = load_options(args.config)
    spark = session(options)
    if folder := args.data or options.get("data"):
        register(spark, folder)
    if args.execute is not None:
        for line in lines(spark.sql(args.execute)):
            print(line)
        return 0
    while True:
        try:
            text = input("tidelog> ").strip()
        except EOFError:
            return 0
        if text.lower() in QUIT:
            return 0
        if text:
            try:
                for line in lines(spark.sql(text)):
                    print(line)
            except Exception as error:
                print(error, file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
