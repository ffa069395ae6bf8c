"""python -m quire [--wrap ...] [--out FOLDER | --in-place] [FILE ...]: normalise files, or standard input, with Spark.

Good documents are printed in input order, written under --out, or put in place of their files with --in-place; what can't be read is reported on
standard error, and the exit status tells of the first such file."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from . import __version__
from .plans.pipeline import Options, normalize_texts
from .sources import files


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description="Normalise Markdown documents.")
    for f in fields(Options):
        parser.add_argument("--" + f.name.replace("_", "-"), action="store_true")
    parser.add_argument("--version", action="version", version=f"quire {__version__}")
    where = parser.add_mutually_exclusive_group()
    where.add_argument("--out", help="folder for the results; printed without it")
    where.add_argument("--in-place", action="store_true", help="overwrite the files")
    parser.add_argument("files", nargs="*")
    given = parser.parse_args(arguments)
    if given.in_place and not given.files:
        parser.error("--in-place needs at least one file")
    options = Options(**{f.name: getattr(given, f.name) for f in fields(Options)})
    spark = SparkSession.builder.getOrCreate()
    if not given.files:
        text = normalize_texts(files.from_text(spark, sys.stdin.read()).select("doc_id", "text"), options).first()["text"]
        print(text.removesuffix("\n"))
        return 0
    results = files.rewrite(spark, given.files, options)
    failed = results.where("not ok").orderBy("doc_id").select("path", "error").collect()
    if given.in_place:
        files.write_in_place(results)
    elif given.out:
        files.write_texts(results, given.out)
    else:
        for row in results.where("ok").orderBy("doc_id").select("text").toLocalIterator():
            sys.stdout.write(row.text)
    for path, error in failed:
        print(f"{path}: {error}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
