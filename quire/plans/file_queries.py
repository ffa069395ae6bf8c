"""Queries that go through files: documents of a table are written, read again, rewritten and read once more."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .queries import query

_LINES = """
WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS n, CAST(greatest(length(n_name), 3) AS INT) AS w FROM nation)
"""


def _files(spark: SparkSession, sf_dir: str) -> list[str]:
    """A file for each nation: a table, and two lines of a paragraph."""
    text = F.concat(F.lit("|name|\n|:-|\n|"), "n_name", F.lit("|\n\nThe é of\n"), "n_name", F.lit(" is 漢.\n"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    folder = f"{files.shared_dir(spark)}/nations-{uuid.uuid4().hex}"
    files.write_texts(nations.select(F.col("n_nationkey").alias("doc_id"), F.lit(True).alias("ok"), text.alias("text")), folder)
    return files.written_files(spark, folder)


def _shown(results: DataFrame) -> DataFrame:
    """Lines of the good documents, and errors as line -1."""
    text = F.when(F.col("ok"), F.split(F.regexp_replace("text", "\n\\z", ""), "\n", -1))
    found = results.select("doc_id", F.posexplode_outer(text).alias("line_no", "line"), "error")
    return found.select("doc_id", F.coalesce(F.col("line_no").cast("long"), F.lit(-1).cast("long")).alias("line_no"), F.coalesce("line", "error").alias("line"))


@query(_LINES + """SELECT doc_id, CAST(v.i AS BIGINT) AS line_no, CASE v.i WHEN 0 THEN '| ' || rpad('name', greatest(w, 4), ' ') || ' |' WHEN 1 THEN '| :' || repeat('-', greatest(w, 4) - 1) || ' |'
  WHEN 2 THEN '| ' || rpad(n, greatest(w, 4), ' ') || ' |' WHEN 3 THEN '' ELSE 'The é of ' || n || ' is 漢.' END AS line FROM t CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(i)
UNION ALL SELECT 25, -1, 'no such file'
""")  # fmt: skip
def files_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read in the order of their paths, tables reflowed and paragraphs wrapped, with an error row for one that isn't there."""
    paths = _files(spark, sf_dir)
    return _shown(files.rewrite(spark, [*paths, paths[0] + ".missing"]))


@query(_LINES + """SELECT doc_id, CAST(v.i AS BIGINT) AS line_no, CASE v.i WHEN 0 THEN '| ' || rpad('name', greatest(w, 4), ' ') || ' |' WHEN 1 THEN '| :' || repeat('-', greatest(w, 4) - 1) || ' |'
  WHEN 2 THEN '| ' || rpad(n, greatest(w, 4), ' ') || ' |' WHEN 3 THEN '' WHEN 4 THEN 'The é of' ELSE n || ' is 漢.' END AS line FROM t CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(i)
""")  # fmt: skip
def files_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files rewritten without wrapping, put in the place of their sources, and read again."""
    paths = _files(spark, sf_dir)
    files.write_in_place(files.rewrite_no_wrap(spark, paths))
    return _shown(files.read_texts(spark, paths))
