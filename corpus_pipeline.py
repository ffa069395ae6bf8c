"""The corpus pipeline: quality, near duplicates, contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and
returns the documents that it keeps with their columns; the last returns pieces of sequences. Between
stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, neardup, packing, quality, secret_scan
from quire.llm.queries import KEEP_SCORE, word_bpe_path
from quire.llm.store import materialize, scratch, table

#: Shingles, in percent, that two documents of the pipeline share at least when one of them goes.
NEAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is trained, when this is called, on the
    labelled rows among docs. Null and empty texts are scored like texts without words, repeated rows
    each; without labels every score is 0.5 and nothing stays. An empty table gives no rows."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    score = scratch(docs, "quality_score")
    return quality.scored(docs, model, score).where(F.col(score) >= KEEP_SCORE).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates; the groups are found when
    this is called. Documents without words (null, empty, blank) and without an id all stay; rows of
    one doc_id stay or go together, so repeated rows of a kept document stay. An empty table gives no
    rows."""
    found = neardup.near_duplicates(docs, NEAR_PERCENT)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, which is read when this is called. Null and empty
    texts and an empty benchmark have no windows, so these documents stay; repeated rows are judged
    each. An empty table gives no rows."""
    # by position, as docs may have columns of the names that contamination() gives
    own = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*own).select("*", F.col(own[docs.columns.index("text")]).alias("text"))
    found = decontaminate.contamination(renamed, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*own).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark of its kind, and n_chars, where
    there is one, that of the new text. Null texts stay null with a null n_chars, empty ones empty;
    repeated rows are redacted each. An empty table gives no rows."""
    redacted = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences. Null and empty texts are one piece of the end id;
    repeated rows are packed each, columns beside doc_id and text are left out, an empty table gives no
    rows."""
    return packing.pack(docs, word_bpe_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: A classifier and a tokenizer have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table. All of them but the last are run when this is called."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
